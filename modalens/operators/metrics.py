"""Scores of stored predictions (model, sample_id, outer_fold, y, score, pred, group_id) as aggregates, never as lists."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalens.functions.rank import average_ranks, running_counts, running_sums
from modalens.storage import written


def auroc(pred: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Per key: Mann-Whitney AUROC of a 0/1 truth with average ranks for ties; null for one class."""
    one = F.col(y).cast("long")
    counts = pred.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("_p"), F.count(F.when(F.col(y) == 1, 1)).alias("_one"))
    counts = written(counts, "score-counts")  # predictions are read once; what follows goes with the different scores
    ranked = running_counts(counts.filter(F.col(score).isNotNull()), keys, score)
    s = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("_one") > 0, F.col("_one") * (F.col("before") + (F.col("n") + 1) / 2))).alias("_s"))
    out = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("_p").alias("n_pos"))
    out = out.join(s, keys, "left") if keys else out.join(F.broadcast(s))
    p, q = F.col("n_pos"), F.col("n") - F.col("n_pos")
    return out.select(*keys, "n", "n_pos", ((F.col("_s") - p * (p + 1) / 2) / F.when((p > 0) & (q > 0), p * q)).alias("auroc"))


def weighted_auroc(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: AUROC of (keys, y, score, w) rows that stand for w samples each; for many keys of moderate size."""
    per = counts.groupBy(*keys, "score").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = per.withColumn("_b", below).groupBy(*keys).agg(F.sum(F.col("p") * (F.col("_b") + F.col("q") / 2)).alias("_u"), F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    return out.select(*keys, (F.col("_u") / F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.col("_p") * F.col("_q"))).alias("auroc"))


def macro_auroc(probs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: mean one-vs-rest AUROC of (keys, cls, y, score) rows, one for each sample and class."""
    rows = probs.withColumn("y", (F.col("y") == F.col("cls")).cast("int"))
    return auroc(rows, [*keys, "cls"]).groupBy(*keys).agg(F.avg("auroc").alias("macro_auroc"))


def average_precision(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: sum over falling scores of recall gained times precision; tied scores count together."""
    per = pred.groupBy(*keys, "score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"))
    run = per.select(*keys, "p", F.sum("p").over(w).alias("tp"), F.sum("m").over(w).alias("k"))
    return run.groupBy(*keys).agg((F.sum(F.col("p") * F.col("tp") / F.col("k")) / F.sum("p")).alias("average_precision"))


def confusion_scores(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: accuracy, balanced accuracy, F1, macro F1 and the multiclass Matthews coefficient, from confusion counts.

    `f1` is that of the larger class where the truth has two, else the macro one.
    """
    c = pred.groupBy(*keys, "y", "pred").agg(F.count(F.lit(1)).alias("c"))
    t = c.groupBy(*keys, F.col("y").alias("k")).agg(F.sum("c").alias("t"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("c")).otherwise(0)).alias("hit"))
    p = c.groupBy(*keys, F.col("pred").alias("k")).agg(F.sum("c").alias("p"))
    each = t.join(p, [*keys, "k"], "full").na.fill(0, ["t", "hit", "p"])
    f1 = F.when(F.col("t") + F.col("p") > 0, 2 * F.col("hit") / (F.col("t") + F.col("p"))).otherwise(0.0)
    out = each.groupBy(*keys).agg(
        F.sum("hit").alias("s"), F.sum("t").alias("n"), F.avg(F.when(F.col("t") > 0, F.col("hit") / F.col("t"))).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"),
        F.max_by(f1, F.when(F.col("t") > 0, F.col("k"))).alias("_f1"), F.sum((F.col("t") > 0).cast("int")).alias("_classes"),
        F.sum(F.col("t") * F.col("p")).cast("double").alias("tp"), F.sum(F.col("t") * F.col("t")).cast("double").alias("tt"), F.sum(F.col("p") * F.col("p")).cast("double").alias("pp"),
    )
    n = F.col("n").cast("double")
    down = F.sqrt((n * n - F.col("tt")) * (n * n - F.col("pp")))
    f1 = F.when(F.col("_classes") == 2, F.col("_f1")).otherwise(F.col("macro_f1"))
    return out.select(*keys, "n", (F.col("s") / n).alias("accuracy"), "balanced_accuracy", f1.alias("f1"), "macro_f1", F.coalesce((F.col("s") * n - F.col("tp")) / F.when(down > 0, down), F.lit(0.0)).alias("mcc"))


def regression_scores(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: R squared (null for a constant truth), RMSE, MAE, Pearson, Spearman (average ranks)."""
    pred = average_ranks(average_ranks(pred.select(*keys, "y", "score"), keys, "y", "_ry"), keys, "score", "_rs")
    gap = F.col("y") - F.col("score")
    out = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(gap * gap).alias("_e"), F.var_pop("y").alias("_v"), F.avg(F.abs(gap)).alias("mae"), F.corr("y", "score").alias("pearson"), F.corr("_ry", "_rs").alias("spearman")
    )
    return out.select(*keys, "n", (1 - F.col("_e") / F.when(F.col("_v") > 0, F.col("_v") * F.col("n"))).alias("r2"), F.sqrt(F.col("_e") / F.col("n")).alias("rmse"), "mae", "pearson", "spearman")


def calibration(pred: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Per key: Brier score and expected calibration error of the finite scores.

    Null with fewer than ten of them, with other than two classes, or where all scores are the same.
    """
    pred = pred.filter(~F.isnan("score") & (F.abs("score") < float("inf")))
    per = reliability(pred, keys, bins).groupBy(*keys).agg(F.sum(F.col("m") * F.abs(F.col("mean_y") - F.col("mean_score"))).alias("_g"))
    gap = F.col("score") - F.col("y")
    out = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(gap * gap).alias("_brier"), F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    out = out.join(per, keys) if keys else out.join(F.broadcast(per))
    ok = (F.col("n") >= 10) & (F.col("_lo") < F.col("_hi")) & (F.col("_y0") < F.col("_y1"))
    return out.select(*keys, "n", F.when(ok, F.col("_brier")).alias("brier"), F.when(ok, F.col("_g") / F.col("n")).alias("ece"))


def reliability(pred: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """(keys, bin, m, mean_score, mean_y)."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return pred.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("m"), F.avg("score").alias("mean_score"), F.avg("y").alias("mean_y"))


def calibration_line(pred: DataFrame, keys: list[str], least: int = 20, steps: int = 40) -> DataFrame:
    """(keys, events, nonevents, intercept, slope) of logistic recalibration on the score's logit.

    The slope comes with an intercept of its own; the given intercept takes the logit as offset. Both are null with fewer
    than `least` events or non-events, and where they don't converge (separable scores). Scores are held within 1e-9 of 0
    and 1. Equal scores are counted first; a Newton step is one aggregation to a row per key.
    """
    from modalens.storage import dropped, written

    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("score")))
    rows = pred.filter("score IS NOT NULL AND y IS NOT NULL AND NOT isnan(score)").groupBy(*keys, F.ln(p / (1 - p)).alias("x")).agg(F.sum(F.col("y").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    rows = written(rows, "logits")
    spark = rows.sparkSession
    size = rows.groupBy(*keys).agg(F.sum("k").alias("events"), F.sum(F.col("n") - F.col("k")).alias("nonevents")).collect()  # a row per key
    now = {tuple(r[c] for c in keys): [0.0, 0.0, 0.0, False] for r in size if min(r.events, r.nonevents) >= least}
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    w = lambda q: F.col("n") * q * (1 - q)
    for _ in range(steps):
        if all(v[3] for v in now.values()):
            break
        at = spark.createDataFrame([(*k, *v[:3]) for k, v in now.items()], f"{shape}, a double, b double, c double")
        q, o = (1 / (1 + F.exp(-e)) for e in (F.col("a") + F.col("b") * F.col("x"), F.col("c") + F.col("x")))
        x = F.col("x")
        sums = rows.join(F.broadcast(at), keys).groupBy(*keys).agg(
            F.sum(F.col("k") - F.col("n") * q).alias("g0"), F.sum((F.col("k") - F.col("n") * q) * x).alias("g1"), F.sum(w(q)).alias("h00"), F.sum(w(q) * x).alias("h01"),
            F.sum(w(q) * x * x).alias("h11"), F.sum(F.col("k") - F.col("n") * o).alias("g"), F.sum(w(o)).alias("h"),
        )
        for r in sums.collect():
            v, det = now[tuple(r[c] for c in keys)], r.h00 * r.h11 - r.h01 * r.h01
            if v[3]:
                continue
            if not det > 1e-12 * max(1.0, r.h00 * r.h11) or not r.h > 1e-12:
                v[:] = [None, None, None, True]
                continue
            step = ((r.h11 * r.g0 - r.h01 * r.g1) / det, (r.h00 * r.g1 - r.h01 * r.g0) / det, r.g / r.h)
            short = min(1.0, 2 / max(1e-300, *map(abs, step)))
            v[:3] = [u + short * s for u, s in zip(v[:3], step, strict=True)]
            v[3] = max(map(abs, step)) < 1e-8
    out = [(*(r[c] for c in keys), r.events, r.nonevents, *(now[k][2:0:-1] if (k := tuple(r[c] for c in keys)) in now and now[k][3] else (None, None))) for r in size]
    dropped(rows)
    return spark.createDataFrame(out, f"{shape}, events long, nonevents long, intercept double, slope double")


def prevalence(pred: DataFrame, keys: list[str]) -> DataFrame:
    """The average precision of a score that knows nothing."""
    return pred.groupBy(*keys).agg(F.avg(F.col("y").cast("double")).alias("prevalence"))


#: Parts that a stretch of times is cut into at each level of the concordance.
FAN = 16


def concordance(rows: DataFrame, time: str = "time", event: str = "event", risk: str = "risk") -> DataFrame:
    """Harrell's C: over pairs (event at i, time j > time i) the share with risk i > risk j, ties one half; 0.5 if no pair.

    Times are numbered and cut into FAN parts, these again, and so on, until a part is one time. Two times meet at just
    one level: where they are in different parts of the same stretch. There running sums over risk, one for each part,
    count the rows of later parts with smaller risks, so the work is that of sorting the rows once for each level.
    """
    d = rows.groupBy(time, risk).agg(F.sum(F.col(event).cast("long")).alias("e"), F.count(F.lit(1)).alias("n"))
    times = d.groupBy(time).agg(F.sum("e").alias("e"), F.sum("n").alias("n")).withColumn("_one", F.lit(1).cast("long"))
    numbered_ = written(running_counts(times, [], time, "_one").select(time, "e", "n", F.col("before").alias("pos")), "times")
    k, total = numbered_.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    later = running_counts(numbered_.drop("pos"), [], time, "n").agg(F.coalesce(F.sum(F.col("e") * (F.lit(total) - F.col("before") - F.col("n"))), F.lit(0)).alias("pairs"))
    placed = written(d.join(numbered_.select(time, "pos"), time).select("pos", risk, "e", "n"), "times-risks")
    good, width = [], FAN
    while width // FAN < max(k, 1):
        part = F.floor(F.col("pos") * FAN / width) % FAN
        of = lambda c, i, part=part: F.sum(F.when(part == i, F.col(c)).otherwise(0))
        level = placed.groupBy(F.floor(F.col("pos") / width).alias("stretch"), risk).agg(*[of(c, i).alias(f"{c}{i}") for i in range(FAN) for c in ("e", "n")])
        level = level.select("stretch", risk, *[f"e{i}" for i in range(FAN)], *[(F.col(f"n{i}") / 2).alias(f"h{i}") for i in range(1, FAN)], *[F.col(f"n{i}").cast("double").alias(f"n{i}") for i in range(1, FAN)])
        below = running_sums(level, ["stretch"], risk, [f"n{i}" for i in range(1, FAN)])
        behind, sums = F.lit(0.0), F.lit(0.0)
        for i in range(FAN - 1, 0, -1):
            behind = behind + F.col(f"n{i}") + F.col(f"h{i}")
            sums = sums + F.col(f"e{i - 1}") * behind
        good.append(below.agg(F.sum(sums).alias("good")))
        width *= FAN
    if not good:
        good = [rows.limit(0).agg(F.lit(0.0).alias("good"))]
    all_ = functools.reduce(DataFrame.unionAll, good).agg(F.sum("good").alias("good"))
    return later.join(all_).select("pairs", F.coalesce(F.col("good") / F.when(F.col("pairs") > 0, F.col("pairs")), F.lit(0.5)).alias("c_index"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of Wilson's interval."""
    p, m = k / n, 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / m, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / m
    return centre - half, centre + half
