"""Survival: k-sample log-rank scores with permutations, ridge Cox regression and its benchmark grid."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalens.functions.rank import numbered, ranged, running_counts
from modalens.operators.groups import permuted
from modalens.operators.metrics import concordance
from modalens.operators.models import _together, grid, prepared
from modalens.operators.projection import SMALL, product_strips
from modalens.storage import matched, written

#: Times whose hazards may be broadcast (job, time and two numbers each: some 40 MB).
BROADCAST_TIMES = 1_000_000
#: Past steps that shape the next one.
MEMORY = 10


def log_rank_scores(rows: DataFrame, reps: int = 199, group: str = "group_id", seed: int = 31) -> DataFrame:
    """(rep, statistic) of (group, time, event, batch), one row per group; rep 0 is the study, the others permute batches.

    Risk sets are a batch's size less the running count of earlier leavers, by ranges of time. Events and risk totals of
    a time don't depend on the permutation. What is left of a replicate for its pseudo-inverse is batches^2 sums. A
    replicate without information across batches scores 0.
    """
    base = written(rows.select(F.col(group).alias("g"), "time", F.col("event").cast("long").alias("event"), "batch").filter("batch IS NOT NULL"), "log-rank")
    labels = base.select(F.lit(0).alias("rep"), "g", "batch")
    if reps:
        labels = labels.unionByName(permuted(base.select("g", "batch"), ["batch"], reps, seed, "g").select("rep", "g", "batch"))
    times = base.groupBy("time").agg(F.sum("event").alias("deaths"), F.count(F.lit(1)).alias("left"))
    all_ = base.groupBy().count().first()[0]
    at = running_counts(times.withColumn("_all", F.lit(0)), ["_all"], "time", "left").filter("deaths > 0")
    at = at.select("time", "deaths", (F.lit(all_) - F.col("before")).alias("at_risk")).filter("at_risk > 1")
    sizes = base.groupBy("batch").agg(F.count(F.lit(1)).alias("size"))  # a row per batch
    own = labels.join(base.select("g", "time", "event"), "g").groupBy("rep", "batch", "time").agg(F.sum("event").alias("d"), F.count(F.lit(1)).alias("m"))
    blank = at.select("time").join(F.broadcast(sizes.select("batch"))).join(F.broadcast(labels.select("rep").distinct()))
    zero = F.lit(0).cast("long")
    filled = own.unionByName(blank.select("rep", "batch", "time", zero.alias("d"), zero.alias("m"))).groupBy("rep", "batch", "time").agg(F.sum("d").alias("d"), F.sum("m").alias("m"))
    risk = running_counts(filled, ["rep", "batch"], "time", "m").join(at, "time").join(F.broadcast(sizes), "batch")
    p = (F.col("size") - F.col("before")) / F.col("at_risk")
    per = risk.groupBy("rep", "time", "deaths", "at_risk").agg(F.array_sort(F.collect_list(F.struct("batch", p.alias("p"), F.col("d").cast("double").alias("d")))).alias("b"))
    factor = F.col("deaths") * (F.col("at_risk") - F.col("deaths")) / (F.col("at_risk") - 1)
    one = per.select("rep", "deaths", factor.alias("f"), "b", F.posexplode("b").alias("i", "x"))
    both = one.select("rep", "deaths", "f", "i", "x", F.posexplode("b").alias("j", "y"))
    same = (F.col("i") == F.col("j")).cast("int")
    sums = both.groupBy("rep", "i", "j").agg(
        F.sum(F.col("f") * (F.col("x.p") * same - F.col("x.p") * F.col("y.p"))).alias("v"), F.sum(F.when(F.col("i") == F.col("j"), F.col("x.d") - F.col("deaths") * F.col("x.p")).otherwise(0.0)).alias("u")
    )

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["i"].max()) + 1
        v, u = np.zeros((k, k)), np.zeros(k)
        v[pdf["i"], pdf["j"]] = pdf["v"]
        on = pdf[pdf["i"] == pdf["j"]]
        u[on["i"]] = on["u"]
        known = np.linalg.matrix_rank(v, tol=1e-12) > 0
        return pd.DataFrame({"rep": [pdf["rep"].iloc[0]], "statistic": [max(0.0, float(u @ np.linalg.pinv(v, rcond=1e-12) @ u)) if known else 0.0]})

    return sums.groupBy("rep").applyInPandas(score, "rep int, statistic double")


def batch_association(rows: DataFrame, reps: int = 199, group: str = "group_id") -> DataFrame:
    """(process, statistic, reps, p): log-rank of events, and of censoring where a group is censored, with plus-one p."""
    out = []
    for process, event in (("event", F.col("event").cast("long")), ("censoring", 1 - F.col("event").cast("long"))):
        scores = written(log_rank_scores(rows.withColumn("event", event), reps, group), "scores")
        seen = scores.filter("rep = 0").select(F.col("statistic").alias("statistic"))
        p = (1 + F.sum((F.col("null") >= F.col("statistic") - 1e-12).cast("long"))) / (1 + F.count("null"))
        null = scores.filter("rep > 0").select(F.col("statistic").alias("null"))
        out.append(null.join(F.broadcast(seen)).groupBy("statistic").agg(F.count("null").alias("reps"), p.alias("p")).select(F.lit(process).alias("process"), "statistic", "reps", "p"))
    return functools.reduce(DataFrame.unionByName, out)


def cox_fits(rows: DataFrame, l2: float = 10.0, steps: int = 100, tolerance: float = 1e-6) -> dict[str, np.ndarray]:
    """Coefficients by job of (job, time, event, x), x an array as long as its job's others: ridge on Breslow's likelihood.

    All jobs, such as the folds of all models, take their steps together: limited-memory quasi-Newton steps that start
    from each column's own curvature. The slope needs no risk set of vectors: with C(t) the sum of deaths over risk
    totals of the times up to t, it is the sum of (e^eta C(time) - event) x. So a step is one aggregation of e^eta by
    time, running sums of numbers inside ranges of times, and one pass that adds up rows in the tasks. The driver holds
    a few dozen numbers for each coefficient, whatever the rows, and there is no bound on the coefficients. A job
    without events has the coefficients 0.
    """
    rows = rows.select(F.col("job").cast("string").alias("job"), F.col("time").cast("double").alias("time"), F.col("event").cast("double").alias("event"), "x")
    per = rows.groupBy("job", "time").agg(F.sum("event").alias("deaths"), F.count(F.lit(1)).alias("n"))
    times = written(ranged(per, ["job"], "time"), "cox-times")
    few = times.count() <= BROADCAST_TIMES
    sizes = rows.groupBy("job").agg(F.max(F.size("x")).alias("d"), F.sum("event").alias("deaths")).collect()  # a row per job
    beta = {r.job: np.zeros(r.d) for r in sizes}

    def at(points: dict[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
        """Loss, slope and every column's curvature (without the part of the risk sets' means) of some jobs."""
        own = rows.filter(F.col("job").isin(list(points)))
        hazard = _hazards(own.mapInPandas(lambda it: _risks(it, points), "job string, time double, w double"), times)
        joined = own.join(F.broadcast(hazard), ["job", "time"]) if few else matched(own, hazard, ["job", "time"])
        parts = joined.mapInPandas(lambda it: _slopes(it, points), "job string, sums array<double>")
        out = {}
        for r in parts.groupBy("job").applyInPandas(_added, "job string, sums array<double>").collect():  # a row per job
            b, v = points[r.job], np.array(r.sums)
            d = len(b)
            out[r.job] = float(v[0] + l2 * b @ b), v[1 : d + 1] + 2 * l2 * b, v[d + 1 :] + 2 * l2
        return out

    now = {job: (*state, []) for job, state in at({r.job: beta[r.job] for r in sizes if r.deaths}).items()} if any(r.deaths for r in sizes) else {}
    scale, length = {job: s[2] for job, s in now.items()}, dict.fromkeys(now, 1.0)
    for _ in range(steps):
        moves = {job: length[job] * _direction(slope, pairs, scale[job]) for job, (_, slope, _, pairs) in now.items()}
        for job in [j for j, m in moves.items() if np.abs(m).max() < tolerance]:
            del moves[job], now[job]
        if not moves:
            break
        for job, (loss, slope, curve) in at({job: beta[job] - m for job, m in moves.items()}).items():
            old, before, _, pairs = now[job]
            if not loss <= old - 1e-4 * float(before @ moves[job]):  # the loss is convex: a shorter step is better in the end
                length[job] /= 2
                continue
            beta[job] = beta[job] - moves[job]
            length[job], now[job] = 1.0, (loss, slope, curve, [*pairs, (-moves[job], slope - before)][-MEMORY:])
    return beta


def _risks(batches: Iterator[pd.DataFrame], points: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    """(job, time, w): sums of e^eta by time inside a batch."""
    for part in batches:
        for job, own in part.groupby("job"):
            w = pd.DataFrame({"time": own.time, "w": np.exp(np.stack(own.x) @ points[job])}).groupby("time", as_index=False).sum()
            yield w.assign(job=job)[["job", "time", "w"]]


def _hazards(weights: DataFrame, times: DataFrame) -> DataFrame:
    """(job, time, n, c, log_risk): deaths over risk totals summed up to a time, and the log of its own risk total."""
    own = weights.groupBy("job", "time").agg(F.sum("w").alias("w")).join(times, ["job", "time"])
    ends = Window.partitionBy("job").orderBy("_range")
    later = F.coalesce(F.sum("_w").over(Window.partitionBy("job").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = own.groupBy("job", "_range").agg(F.sum("w").alias("_w")).select("job", "_range", later.alias("_later"))
    inside = Window.partitionBy("job", "_range")
    risk = F.sum("w").over(inside.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("_risk", risk).join(above, ["job", "_range"]).withColumn("_risk", F.col("_risk") + F.col("_later")).withColumn("_step", F.col("deaths") / F.col("_risk"))
    earlier = F.coalesce(F.sum("_c").over(ends.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    below = own.groupBy("job", "_range").agg(F.sum("_step").alias("_c")).select("job", "_range", earlier.alias("_earlier"))
    c = F.sum("_step").over(inside.orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("c", c).join(below, ["job", "_range"]).select("job", "time", "n", (F.col("c") + F.col("_earlier")).alias("c"), F.log("_risk").alias("log_risk"))


def _slopes(batches: Iterator[pd.DataFrame], points: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    """(job, sums) of a task's rows: the loss, the slope and the columns' curvature, one after the other."""
    total: dict[str, np.ndarray] = {}
    for part in batches:
        for job, own in part.groupby("job"):
            x = np.stack(own.x)
            eta, event = x @ points[job], own.event.to_numpy()
            w = np.exp(eta) * own.c.to_numpy()
            sums = np.concatenate([[event @ (own.log_risk.to_numpy() - eta)], x.T @ (w - event), (x * x).T @ w])
            total[job] = total[job] + sums if job in total else sums
    if total:
        yield pd.DataFrame({"job": list(total), "sums": list(total.values())})


def _added(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"job": part.job.iloc[:1], "sums": [np.sum(np.stack(part.sums), axis=0)]})


def _direction(slope: np.ndarray, pairs: list, scale: np.ndarray) -> np.ndarray:
    """The slope times the inverse curvature that the past (step, change of slope) pairs and the columns' own tell."""
    q, shares = slope.copy(), []
    for s, y in reversed(pairs):
        shares.append(s @ q / (s @ y))
        q = q - shares[-1] * y
    q = q / scale
    for (s, y), a in zip(pairs, reversed(shares), strict=True):
        q = q + (a - y @ q / (s @ y)) * s
    return q


def cox(data: DataFrame, l2: float = 10.0) -> np.ndarray:
    """The coefficients of (time, event, x), x an array of numbers."""
    return cox_fits(data.withColumn("job", F.lit("")), l2)[""]


def fold_components(data: DataFrame, k: int | None = None) -> DataFrame:
    """(sample_id, side, time, event, x) with x, an array, in the principal components of the rows with side = train.

    As many as a quarter of the training rows (two at least), and at most the columns, the training rows less one and k.
    The eigenvectors are those of the columns' products or, with more columns than SMALL, of the rows'.
    """
    train = data.filter("side = 'train'")
    p, n, rows = len(train.select(vector_to_array("x").alias("x")).first()["x"]), train.count(), data.count()
    k = max(1, min(p, n - 1, max(2, n // 4), k or p))
    keep = [c for c in data.columns if c != "x"]
    if p <= SMALL:
        fitted = PCA(k=k, inputCol="x", outputCol="_z").fit(train)
        return fitted.transform(data).select(*keep, vector_to_array("_z").alias("x"))
    if rows > SMALL:
        raise ValueError(f"{rows} rows of {p} columns: one of them may be {SMALL} at most, so select columns first (top=)")
    z = data.select("sample_id", F.posexplode(vector_to_array("x")).alias("feature", "z"))
    places = written(numbered(data.select("sample_id").distinct(), "sample_id"), "cox-places")
    strips = written(product_strips(z, places, rows, "sample_id"), "cox-products")
    known = np.array(sorted(r.ix for r in places.join(train.select("sample_id"), "sample_id").collect()))  # SMALL at most
    table = np.zeros((n, n))
    for r in strips.toLocalIterator():
        own = np.frombuffer(r["sums"]).reshape(-1, rows)
        on = np.flatnonzero((known >= r["strip"]) & (known < r["strip"] + len(own)))
        table[on] = own[known[on] - r["strip"]][:, known]
    values, vectors = np.linalg.eigh(table)
    good = [i for i in range(n - 1, n - 1 - k, -1) if values[i] > 1e-10 * values[-1]]
    loads = vectors[:, good] / np.sqrt(values[good])

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for strip, sums in zip(part.strip, part.sums, strict=True):
                x = np.frombuffer(sums).reshape(-1, rows)[:, known] @ loads
                yield pd.DataFrame({"ix": np.arange(strip, strip + len(x)), "x": list(x)})

    return data.select(*keep).join(places.join(strips.mapInPandas(scores, "ix int, x array<double>"), "ix").drop("ix"), "sample_id")


def fold_tables(cells: DataFrame, samples: DataFrame, folds: DataFrame, k: int | None = None, top: int | None = None) -> DataFrame:
    """(sample_id, outer_fold, side, time, event, x): medians, scale and components of every fold's training side.

    `top` keeps that many features, those most alike to the event in training. A fold with fewer than two training
    events, or none to assess, is left out.
    """
    data = written(prepared(cells, samples.withColumn("y", F.col("event")), folds, top).join(samples.select("sample_id", "time", "event"), "sample_id"), "cox-data")
    n = F.sum(F.when(F.col("side") == "train", F.col("event")).otherwise(0))
    sides = data.groupBy("outer_fold").agg(n.alias("train"), F.sum(F.when(F.col("side") != "train", F.col("event")).otherwise(0)).alias("seen"))
    usable = sorted(r.outer_fold for r in sides.collect() if r.train >= 2 and r.seen >= 1)  # a row per fold
    if not usable:
        raise ValueError("no fold has two training events and one to assess")
    return _together(lambda fold: fold_components(data.filter(F.col("outer_fold") == fold).drop("y"), k), usable, 4)


def _risk(tables: DataFrame, l2: float) -> DataFrame:
    """(model, sample_id, outer_fold, time, event, risk) of (model, outer_fold, side, ...): all models and folds in one fit."""
    tables = written(tables.withColumn("job", F.concat_ws("|", "model", "outer_fold")), "cox-tables")
    beta = cox_fits(tables.filter("side = 'train'"), l2)
    known = tables.sparkSession.createDataFrame([(job, b.tolist()) for job, b in beta.items()], "job string, beta array<double>")  # a row per job
    rows = tables.filter("side <> 'train'").join(F.broadcast(known), "job")
    risk = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return rows.select("model", "sample_id", "outer_fold", "time", "event", risk.alias("risk"))


def out_of_fold_cox(cells: DataFrame, samples: DataFrame, folds: DataFrame, model: str = "cox", k: int | None = None, l2: float = 10.0, top: int | None = None) -> DataFrame:
    """(model, sample_id, outer_fold, time, event, risk), every row by a Cox model of the other folds' components."""
    return _risk(fold_tables(cells, samples, folds, k, top).withColumn("model", F.lit(model)), l2)


def cox_grid(cells: DataFrame, samples: DataFrame, folds: DataFrame, k: int | None = None, l2: float = 10.0, top: int | None = None) -> DataFrame:
    """(model, pairs, c_index) of every modality alone, the fusion and the fusion without each."""
    cells = written(cells, "grid-cells")
    names = [r[0] for r in cells.select("modality").distinct().collect()]
    seen = grid(sorted(names), "cox")
    tables = _together(lambda name: fold_tables(cells.filter(F.col("modality").isin(seen[name])), samples, folds, k, top).withColumn("model", F.lit(name)), list(seen), 4)
    risks = written(_risk(tables, l2), "risks")
    return _together(lambda name: concordance(risks.filter(F.col("model") == name)).select(F.lit(name).alias("model"), "pairs", "c_index"), list(seen), 4)
