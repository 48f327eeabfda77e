"""Missingness diagnostics on the long layout, where a missing cell is the absence of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalens.functions.rank import average_ranks, running_counts, running_extremes
from modalens.functions.tails import chi2_sf, t_sf2

#: Upper edges of the histogram's bins, in percent.
EDGES = (0, 1, 5, 10, 25, 50, 100)


def sample_missing(cells: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """(sample_id, modality, n_features, n_missing, missing_fraction); wholly missing samples appear too."""
    widths = features.groupBy("modality").agg(F.countDistinct("feature").alias("n_features"))
    seen = cells.filter(F.col("value").isNotNull()).groupBy("sample_id", "modality").agg(F.countDistinct("feature").alias("n_seen"))
    grid = samples.select("sample_id").distinct().join(F.broadcast(widths))  # one row per modality on the right
    out = grid.join(seen, ["sample_id", "modality"], "left").withColumn("n_missing", F.col("n_features") - F.coalesce("n_seen", F.lit(0)))
    return out.select("sample_id", "modality", "n_features", "n_missing", (F.col("n_missing") / F.col("n_features")).alias("missing_fraction"))


def feature_missing(cells: DataFrame, samples: DataFrame, top: int = 25) -> DataFrame:
    """The `top` features of each modality by missing fraction, ties by name."""
    n = samples.agg(F.countDistinct("sample_id").alias("n"))
    seen = cells.filter(F.col("value").isNotNull()).groupBy("modality", "feature").agg(F.countDistinct("sample_id").alias("seen"))
    out = seen.join(F.broadcast(n)).withColumn("missing_fraction", 1 - F.col("seen") / F.col("n"))
    rn = F.row_number().over(Window.partitionBy("modality").orderBy(F.desc("missing_fraction"), "feature"))
    return out.withColumn("place", rn).filter(F.col("place") <= top).select("modality", "feature", "missing_fraction", "place")


def totals(missing: DataFrame) -> DataFrame:
    """Per modality: cells, missing ones, samples with any, the largest fraction."""
    return missing.groupBy("modality").agg(
        F.sum("n_features").alias("n_cells"), F.sum("n_missing").alias("n_missing"), F.sum((F.col("n_missing") > 0).cast("long")).alias("samples_with_missing"),
        F.max("missing_fraction").alias("max_fraction"), F.avg("missing_fraction").alias("mean_fraction"),
    )


def kruskal(values: DataFrame, keys: list[str], value: str, group: str, drop_single: bool = True) -> DataFrame:
    """Per key: Kruskal-Wallis H with tie correction, its degrees of freedom and p.

    Groups of one are dropped unless told otherwise; H is null if all values are equal or fewer than two groups are left.
    """
    rows = values.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*keys, value, group)
    if drop_single:
        several = rows.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").drop("_m")
        rows = rows.join(several, [*keys, group], "left_semi")
    ranked = average_ranks(rows, keys, value, "_r")
    parts = ranked.groupBy(*keys, group).agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("_m"))
    h = parts.groupBy(*keys).agg(F.sum(F.col("_s") * F.col("_s") / F.col("_m")).alias("_q"), F.sum("_m").alias("n"), F.count(F.lit(1)).alias("k"))
    t = F.col("_t").cast("double")
    ties = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_t")).groupBy(*keys).agg(F.sum(t * t * t - t).alias("_ties"))
    out = h.join(ties, keys)
    n = F.col("n").cast("double")
    tie = 1 - F.col("_ties") / (n * n * n - n)
    stat = (12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)) / F.when(tie > 1e-12, tie)
    out = out.select(*keys, "n", "k", F.when((F.col("k") > 1) & (F.col("n") > 1), stat).alias("h"))
    return out.withColumn("p", chi2_sf("h", (F.col("k") - 1).cast("double")))


def contingency_chi2(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Per key: chi-square of a by b (with Yates' correction on 2 by 2 tables), degrees of freedom, p, Cramér's V."""
    cell = rows.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("o"))
    ra, rb = (cell.groupBy(*keys, x).agg(F.sum("o").alias(f"n_{i}")) for x, i in ((a, "a"), (b, "b")))
    shape = lambda x, i: x.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"k_{i}"))
    n = cell.groupBy(*keys).agg(F.sum("o").alias("n"))
    on = lambda x, y, k: x.join(y, k) if k else x.join(F.broadcast(y))
    meta = on(on(n, shape(ra, "a"), keys), shape(rb, "b"), keys)
    grid = on(ra, rb, keys).join(cell, [*keys, a, b], "left")  # the margins' product: one row per cell of the table
    grid = on(grid, meta, keys)
    e = F.col("n_a") * F.col("n_b") / F.col("n")
    gap = F.abs(F.coalesce("o", F.lit(0)) - e)
    gap = F.when((F.col("k_a") == 2) & (F.col("k_b") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = grid.groupBy(*keys, "n", "k_a", "k_b").agg(F.sum(gap * gap / e).alias("chi2"))
    k = F.least("k_a", "k_b")
    out = out.withColumn("chi2", F.when(k > 1, F.col("chi2"))).withColumn("df", ((F.col("k_a") - 1) * (F.col("k_b") - 1)).cast("double"))
    return out.select(*keys, "n", "chi2", "df", F.sqrt(F.col("chi2") / (F.col("n") * F.when(k > 1, k - 1))).alias("cramers_v")).withColumn("p", chi2_sf("chi2", "df"))


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Per key: rank correlation of two columns and its p by Student's t."""
    both = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_ranks(average_ranks(both, keys, a, "_ra"), keys, b, "_rb")
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("rho"))
    rho = F.col("rho")
    t = F.abs(rho) * F.sqrt((F.col("n") - 2) / F.when(1 - rho * rho > 0, 1 - rho * rho))
    return out.withColumn("p", F.when(F.col("n") > 2, t_sf2(t, (F.col("n") - 2).cast("double"))))


def histogram(missing: DataFrame) -> DataFrame:
    """(modality, bin, n_samples): samples by percent missing; bin is the upper edge."""
    pct = F.col("missing_fraction") * 100
    edge = F.coalesce(*[F.when(pct <= x, F.lit(x)) for x in EDGES])
    return missing.groupBy("modality", edge.alias("bin")).agg(F.count(F.lit(1)).alias("n_samples"))


def adjusted(tests: DataFrame, family: list[str], p: str = "p", order: str = "test") -> DataFrame:
    """tests with Benjamini-Hochberg, Benjamini-Yekutieli and Holm adjusted p by family; null p stays null.

    Equal p have the same adjusted ones, so the work is on counts of distinct p: places come from running counts, the
    step-up minimum and step-down maximum from running extremes, and no task holds a family.
    """
    counts = tests.filter(F.col(p).isNotNull()).groupBy(*family, p).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(*family).agg(F.sum("n").alias("_m"))
    placed = running_counts(counts, family, p).join(sizes, family)
    up = placed.withColumn("_up", F.col(p) * F.col("_m") / (F.col("before") + F.col("n"))).withColumn("_down", F.col(p) * (F.col("_m") - F.col("before")))
    capped = lambda x: F.least(F.lit(1.0), x)
    out = running_extremes(up, family, p, "_up", "_down").select(
        *family, p, capped(F.col("least")).alias("p_bh"), capped(F.col("least") * harmonic(F.col("_m"))).alias("p_by"), capped(F.col("most")).alias("p_holm")
    )
    return tests.join(out, [*family, p], "left")


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: term by term up to 32, by its expansion with an error below 1e-12 from there on."""
    x = m.cast("double")
    exact = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(32), m.cast("int"))), F.lit(0.0), lambda s, j: s + 1 / j.cast("double"))
    return F.when(m <= 32, exact).otherwise(F.ln(x) + 0.57721566490153286 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6))
