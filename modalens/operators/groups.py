"""Tests on one row per subject. Permutations are a column `rep` whose labels come from hashes, shared by all features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalens.functions.rank import average_ranks, numbered, window_ranks
from modalens.storage import written

#: Features and groups whose ranks one task multiplies with label vectors.
FEATURES, GROUPS = 256, 1024
#: Groups of a block of distances.
BLOCK_GROUPS = 512


def missing_profile(cells: DataFrame, samples: DataFrame, features: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, modality, feature, missing): share of a group's rows without the feature, so each group weighs the same."""
    size = samples.groupBy(group).agg(F.countDistinct("sample_id").alias("_n"))
    seen = cells.filter(F.col("value").isNotNull()).join(samples.select("sample_id", group), "sample_id").groupBy(group, "modality", "feature").agg(F.countDistinct("sample_id").alias("_s"))
    grid = size.join(F.broadcast(features.select("modality", "feature").distinct()))
    out = grid.join(seen, [group, "modality", "feature"], "left")
    return out.select(group, "modality", "feature", (1 - F.coalesce("_s", F.lit(0)) / F.col("_n")).alias("missing"))


def representation(cells: DataFrame, samples: DataFrame, reducer: str = "mean", group: str = "group_id") -> DataFrame:
    """(group, modality, feature, value): mean or median of a group's rows."""
    rows = cells.join(samples.select("sample_id", group), "sample_id")
    value = F.avg("value") if reducer == "mean" else F.percentile("value", F.lit(0.5))
    return rows.groupBy(group, "modality", "feature").agg(value.alias("value"))


def standardized(rep: DataFrame, how: str = "z") -> DataFrame:
    """rep by feature: z-scores (population) or (value - median) / IQR. A feature without spread is refused: it raises."""
    if how == "z":
        scale = rep.groupBy("modality", "feature").agg(F.avg("value").alias("_c"), F.stddev_pop("value").alias("_s"))
    else:
        q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        scale = rep.groupBy("modality", "feature").agg(q.alias("_q")).select("modality", "feature", F.col("_q")[1].alias("_c"), (F.col("_q")[2] - F.col("_q")[0]).alias("_s"))
    if flat := scale.filter("NOT coalesce(_s, 0) > 0").select("modality", "feature").take(3):
        raise ValueError(f"no spread over groups: {[tuple(r) for r in flat]}")
    return rep.join(scale, ["modality", "feature"]).withColumn("value", (F.col("value") - F.col("_c")) / F.col("_s")).drop("_c", "_s")


def distances(rep: DataFrame, kind: str = "mean_abs", group: str = "group_id") -> DataFrame:
    """(a, b, d) for a < b: mean absolute or root mean square difference over features. A missing value is refused: it raises.

    Groups are cut into blocks of about BLOCK_GROUPS; a task holds one pair of blocks as two matrices and adds up their
    differences some features at a time.
    """
    shape = rep.filter(F.col("value").isNotNull()).agg(F.count(F.lit(1)), F.countDistinct(group), F.countDistinct("modality", "feature")).first()
    if shape[0] != shape[1] * shape[2]:
        raise ValueError(f"{shape[1]} groups of {shape[2]} features have {shape[0]} values, not one each")
    blocks = max(8, -(-shape[1] // BLOCK_GROUPS))
    rows = rep.select(F.col(group).alias("g"), F.concat_ws("::", "modality", "feature").alias("f"), "value").withColumn("_b", F.pmod(F.xxhash64("g"), F.lit(blocks)))
    pair = F.explode(F.expr(f"transform(sequence(0, {blocks - 1}), x -> struct(least(x, _b) AS p, greatest(x, _b) AS q))"))
    dealt = rows.withColumn("_pair", pair).select("g", "f", "value", "_b", "_pair.p", "_pair.q")

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index=["g", "_b"], columns="f", values="value")
        names, block, x = wide.index.get_level_values(0).to_numpy(), wide.index.get_level_values(1).to_numpy(), wide.to_numpy()
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        i, j = np.flatnonzero(block == p), np.flatnonzero(block == q)
        total = np.zeros((len(i), len(j)))
        for k in range(0, x.shape[1], 32):
            gap = np.abs(x[i, None, k : k + 32] - x[None, j, k : k + 32])
            total += (gap if kind == "mean_abs" else gap * gap).sum(-1)
        d = total / x.shape[1] if kind == "mean_abs" else np.sqrt(total / x.shape[1])
        a, b = np.repeat(names[i], len(j)), np.tile(names[j], len(i))
        out = pd.DataFrame({"a": a, "b": b, "d": d.ravel()})
        out = out[a != b] if p != q else out[a < b]
        return pd.DataFrame({"a": np.minimum(out["a"], out["b"]), "b": np.maximum(out["a"], out["b"]), "d": out["d"]}) if len(out) else out

    return dealt.groupBy("p", "q").applyInPandas(between, "a string, b string, d double")


def distance_correlation(one: DataFrame, two: DataFrame) -> DataFrame:
    """(n, dcor): correlation of two distance tables (a, b, d) after double centring, the global scale of the association.

    Sums over pairs give row means, so centring is a join on the group table; no matrix is built.
    """
    both = one.join(two.withColumnRenamed("d", "e"), ["a", "b"])
    full = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "d", "e"))
    rows = full.groupBy("a").agg(F.sum("d").alias("sd"), F.sum("e").alias("se"))
    all_ = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("sd").alias("td"), F.sum("se").alias("te"))
    meta = rows.join(F.broadcast(all_))
    n = F.col("n")
    m = meta.select(F.col("a"), n, (F.col("sd") / n).alias("md"), (F.col("se") / n).alias("me"), (F.col("td") / (n * n)).alias("gd"), (F.col("te") / (n * n)).alias("ge"))
    off = full.join(m, "a").join(m.select(F.col("a").alias("b"), F.col("md").alias("md2"), F.col("me").alias("me2")), "b")
    x, y = F.col("d") - F.col("md") - F.col("md2") + F.col("gd"), F.col("e") - F.col("me") - F.col("me2") + F.col("ge")
    moments = lambda t, a, b: t.agg(F.sum(a * b).alias("xy"), F.sum(a * a).alias("xx"), F.sum(b * b).alias("yy"), F.max("n").alias("n"))
    diag = moments(m, F.col("gd") - 2 * F.col("md"), F.col("ge") - 2 * F.col("me"))
    out = moments(off, x, y).unionByName(diag).agg(F.sum("xy").alias("xy"), F.sum("xx").alias("xx"), F.sum("yy").alias("yy"), F.max("n").alias("n"))
    down = F.sqrt(F.col("xx") * F.col("yy"))
    return out.select("n", F.when(down > 0, F.col("xy") / down).alias("dcor"))


def permuted(groups: DataFrame, columns: list[str], reps: int, seed: int = 31, group: str = "group_id", stay: tuple[str, ...] = ()) -> DataFrame:
    """(rep, group, stay, columns): for every replicate the columns move together to other groups, in the order of a hash; `stay` are the group's own."""
    base = groups.select(group, *columns)
    every = F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")
    left = numbered(groups, group, "_i")
    left = (left.join(groups.select(group, *stay), group) if stay else left).select(group, *stay, "_i", every)
    order = base.select("*", every).withColumn("_o", F.xxhash64(F.lit(seed), "rep", group)).withColumn("_s", F.pmod("_o", F.lit(64)))
    counts = order.groupBy("rep", "_s").agg(F.count(F.lit(1)).alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy("rep").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over the shards
    own = F.row_number().over(Window.partitionBy("rep", "_s").orderBy("_o", group)) - 1
    right = order.withColumn("_r", own).join(counts.select("rep", "_s", before.alias("_b")), ["rep", "_s"])
    right = right.select("rep", *columns, (F.col("_b") + F.col("_r")).cast("int").alias("_i"))
    # groups times replicates: an estimate from before the explode would have the driver collect and broadcast them
    return left.hint("merge").join(right.hint("merge"), ["rep", "_i"]).select("rep", group, *stay, *columns)


def class_by_batch(groups: DataFrame, label: str, batch: str, reps: int = 199, group: str = "group_id") -> DataFrame:
    """(n, chi2, cramers_v, p): Pearson's table statistic without correction, p by permuting labels with fixed margins.

    With one label or one batch only there is no cramers_v.
    """
    n = groups.agg(F.count(F.lit(1)).alias("n"))
    shape = groups.agg(F.least(F.countDistinct(label), F.countDistinct(batch)).alias("k"))
    margins = lambda c, name: groups.groupBy(c).agg(F.count(F.lit(1)).alias(name))

    def statistic(rows: DataFrame, keys: list[str]) -> DataFrame:
        """sum of o^2 / e - n, from the table's non-empty cells only."""
        cell = rows.groupBy(*keys, label, batch).agg(F.count(F.lit(1)).alias("o"))
        e = cell.join(F.broadcast(margins(label, "a")), label).join(F.broadcast(margins(batch, "b")), batch).join(F.broadcast(n))
        return e.groupBy(*keys, "n").agg((F.sum(F.col("o") * F.col("o") * F.col("n") / (F.col("a") * F.col("b"))) - F.max("n")).alias("chi2"))

    seen = statistic(groups, [])
    moved = permuted(groups, [label], reps, group=group).join(groups.select(group, batch), group)
    null = statistic(moved, ["rep"]).select("rep", F.col("chi2").alias("null"))
    out = seen.join(F.broadcast(shape)).join(null).groupBy("n", "k", "chi2").agg(((1 + F.sum((F.col("null") >= F.col("chi2") - 1e-9).cast("long"))) / (1 + F.count("rep"))).alias("p"))
    return out.select("n", "chi2", F.when(F.col("k") > 1, F.sqrt(F.try_divide("chi2", F.col("n") * (F.col("k") - 1)))).alias("cramers_v"), "p")


def log_rank(rows: DataFrame, time: str = "time", event: str = "event", batch: str = "batch", keys: list[str] = ()) -> DataFrame:
    """(keys, batch, observed, expected): events of each batch and those expected under equal hazards.

    Events and leavers are counted by time first; risk sets are reverse running sums over distinct times.
    """
    keys = list(keys)
    per = rows.groupBy(*keys, time, batch).agg(F.sum(F.col(event).cast("long")).alias("d"), F.count(F.lit(1)).alias("m"))
    times = per.groupBy(*keys, time).agg(F.sum("d").alias("D"), F.sum("m").alias("M"))
    back = Window.partitionBy(*keys).orderBy(F.desc(time))
    at_risk = times.select(*keys, time, "D", F.sum("M").over(back).alias("N"))
    grid = at_risk.filter("D > 0").join(rows.select(*keys, batch).distinct(), keys) if keys else at_risk.filter("D > 0").join(F.broadcast(rows.select(batch).distinct()))
    own = per.groupBy(*keys, batch, time).agg(F.sum("m").alias("m"))
    steps = grid.select(*keys, batch, time, F.lit(0).cast("long").alias("m"), "D", "N").unionByName(own.select(*keys, batch, time, "m", F.lit(None).cast("long").alias("D"), F.lit(None).cast("long").alias("N")))
    risk = F.sum("m").over(Window.partitionBy(*keys, batch).orderBy(F.desc(time)))
    expected = steps.withColumn("_r", risk).filter("D IS NOT NULL").groupBy(*keys, batch).agg(F.sum(F.col("_r") * F.col("D") / F.col("N")).alias("expected"))
    return rows.groupBy(*keys, batch).agg(F.sum(F.col(event).cast("long")).alias("observed")).join(expected, [*keys, batch], "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))


def families(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(family, n_tests, min_p, min_p_holm, warning) of (family, test, p): a family warns if any Holm-adjusted p is below alpha.

    A test without p doesn't count; a family of those alone has null p and no warning. The smallest adjusted p is that of
    the smallest p, so no window is needed.
    """
    low = F.least(F.lit(1.0), F.min("p") * F.count("p"))
    return tests.groupBy("family").agg(F.count("p").alias("n_tests"), F.min("p").alias("min_p"), low.alias("min_p_holm"), F.coalesce(low < alpha, F.lit(False)).alias("warning")).withColumn(
        "min_p_holm", F.when(F.col("n_tests") > 0, F.col("min_p_holm"))
    )


def feature_association(profile: DataFrame, groups: DataFrame, target: str, reps: int = 99, seed: int = 31, group: str = "group_id", kind: str = "continuous") -> DataFrame:
    """Per feature its statistic against a group-level target, p by permuting whole groups, and p_max.

    `observed` is |Spearman| with a continuous target, Kruskal-Wallis' H with a categorical one; p_max counts replicates
    whose largest statistic over all features reaches the feature's own. A feature without spread has the statistic 0.
    Values are ranked once. Ranks times labels, for all replicates together, are products of matrices: a task has the
    ranks of some features and groups and the label vectors of these groups, and its sums are added over groups.
    """
    ranked = profile.select(group, "modality", "feature", window_ranks("missing", "modality", "feature").alias("_x"))
    label = groups.select(group, target).filter(F.col(target).isNotNull())
    if kind == "continuous":
        y = average_ranks(label.withColumn("_all", F.lit(0)), ["_all"], target, "_y").select(group, F.col("_y").cast("double"))
    else:
        names = label.select(target).distinct().withColumn("_y", (F.row_number().over(Window.orderBy(target)) - 1).cast("double"))  # a row per class
        y = label.join(F.broadcast(names), target).select(group, "_y")
    y = written(y, "labels")
    every = y.withColumn("rep", F.lit(0)).unionByName(permuted(y, ["_y"], reps, seed, group=group))
    vectors = every.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", "_y"))), lambda e: e["_y"]).alias("v"))  # replicates + 1 labels
    sizes = y.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).orderBy("_y")
    counts = np.array([r.n for r in sizes.collect()], float) if kind != "continuous" else np.zeros(0)  # a row per class
    n, y_mean, y_var = y.agg(F.count(F.lit(1)), F.avg("_y"), F.var_pop("_y")).first()
    if not n or not y_var:
        raise ValueError("a target needs two values at least")
    classes = len(counts) or 1
    features = profile.select("modality", "feature").distinct().count()
    parts, blocks = -(-features // FEATURES), -(-n // GROUPS)
    own = ranked.join(y.select(group), group).withColumn("_p", F.pmod(F.xxhash64("modality", "feature"), F.lit(parts))).withColumn("_b", F.pmod(F.xxhash64(group), F.lit(blocks)))
    lent = vectors.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).withColumn("_b", F.pmod(F.xxhash64(group), F.lit(blocks)))

    def products(ranks: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        if not len(ranks) or not len(labels):
            return pd.DataFrame({"modality": [], "feature": [], "cls": [], "n": [], "q": [], "sums": []})
        wide = ranks.pivot(index=["modality", "feature"], columns=group, values="_x").reindex(columns=labels[group])
        x, v = wide.fillna(0.0).to_numpy(), np.stack(labels["v"].tolist())
        names = wide.index.to_frame(index=False)
        seen = [x @ (v if kind == "continuous" else (v == c).astype(float)) for c in range(classes)]
        return pd.concat([names.assign(cls=c, n=wide.notna().sum(axis=1).to_numpy(), q=(x * x).sum(axis=1), sums=list(s)) for c, s in enumerate(seen)])

    def statistics(part: pd.DataFrame) -> pd.DataFrame:
        one = part[part.cls == 0]
        m, q = float(one.n.sum()), float(one.q.sum())
        per = [np.sum(part[part.cls == c].sums.tolist(), axis=0) for c in range(classes)]
        spread = q - m * ((m + 1) / 2) ** 2
        if spread <= 1e-9:
            value = np.zeros(reps + 1)
        elif kind == "continuous":
            value = np.abs(per[0] - m * (m + 1) / 2 * y_mean) / np.sqrt(spread * y_var * m)
        else:
            ties = m * (m + 1) * (2 * m + 1) / 6 - q
            h = 12 / (m * (m + 1)) * sum(s * s / k for s, k in zip(per, counts, strict=True)) - 3 * (m + 1)
            value = h / (1 - 12 * ties / (m**3 - m))
        return one[["modality", "feature"]].iloc[:1].assign(v=[value])

    sums = own.groupBy("_p", "_b").cogroup(lent.groupBy("_p", "_b")).applyInPandas(products, "modality string, feature string, cls int, n long, q double, sums array<double>")
    found = written(sums.groupBy("modality", "feature").applyInPandas(statistics, "modality string, feature string, v array<double>"), "statistics")
    top = found.select(F.posexplode("v").alias("rep", "x")).groupBy("rep").agg(F.max("x").alias("x"))
    largest = top.filter("rep > 0").agg(F.collect_list("x").alias("_top"))  # one number per replicate
    at_least = lambda values, x: F.size(F.filter(values, lambda e: e >= x - 1e-12))
    seen = F.col("v")[0]
    return found.join(F.broadcast(largest)).select(
        "modality", "feature", seen.alias("observed"), (at_least(F.col("v"), seen) / (reps + 1)).alias("p"), ((1 + at_least(F.col("_top"), seen)) / (reps + 1)).alias("p_max")
    )


def association_summary(tested: DataFrame) -> DataFrame:
    """(n_features, maximum, min_p, min_p_max) of per-feature tests: what a claim shows of them, none of it decides."""
    return tested.agg(F.count(F.lit(1)).alias("n_features"), F.max("observed").alias("maximum"), F.min("p").alias("min_p"), F.min("p_max").alias("min_p_max"))


def claims(tests: DataFrame, expected: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row per claim of (claim, modality, method, evidence, p), with `expected` (claim, modality, n) primary tests.

    Only tests of primary evidence decide: Holm's adjustment runs over a claim's primary tests of all modalities, and a
    claim warns if one of them is at most alpha. Secondary tests are counted and shown. A claim is refused, without
    numbers, if a primary test is lacking or extra, or its p is missing or no probability.
    """
    first = tests.filter("evidence = 'primary'")
    bad = first.groupBy("claim").agg(F.sum((F.col("p").isNull() | F.isnan("p") | ~F.col("p").between(0, 1)).cast("long")).alias("_bad"))
    each = first.groupBy("claim", "modality").agg(F.count(F.lit(1)).alias("_n"))
    gap = expected.join(each, ["claim", "modality"], "full").groupBy("claim").agg(F.sum((F.coalesce("n", F.lit(0)) != F.coalesce("_n", F.lit(0))).cast("long")).alias("_gap"), F.sum("n").alias("eligible"))
    down = Window.partitionBy("claim").orderBy("p", "modality", "method")  # a row per modality and method
    k = F.count(F.lit(1)).over(Window.partitionBy("claim"))
    raw = F.least(F.lit(1.0), F.col("p") * (k - F.row_number().over(down) + 1))
    adjusted = first.withColumn("_raw", raw).withColumn("_holm", F.max("_raw").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    primary = adjusted.groupBy("claim").agg(F.count(F.lit(1)).alias("n_primary"), F.sum((F.col("_holm") <= alpha).cast("long")).alias("warnings"), F.min("_holm").alias("min_holm"), F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods"))
    second = tests.filter("evidence <> 'primary'").groupBy("claim").agg(F.count(F.lit(1)).alias("n_secondary"), F.min("p").alias("min_p_secondary"))
    all_ = gap.join(bad, "claim", "left").join(primary, "claim", "left").join(second, "claim", "left")
    refused = (F.col("_gap") > 0) | (F.coalesce("_bad", F.lit(0)) > 0)
    told = lambda c: F.when(~refused, F.col(c))
    return all_.select(
        "claim", F.when(refused, "refused").otherwise("tested").alias("status"), "eligible", F.coalesce("n_primary", F.lit(0)).alias("n_primary"), told("warnings").alias("warnings"),
        (told("warnings") > 0).alias("any_warning"), told("min_holm").alias("min_holm"), told("methods").alias("methods"), F.coalesce("n_secondary", F.lit(0)).alias("n_secondary"), "min_p_secondary",
    )
