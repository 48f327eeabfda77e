"""Size factors for count tables. Both need the whole matrix; `samples` restricts what they learn from."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalens.functions.rank import window_ranks


@F.pandas_udf(T.DoubleType())
def _log(x: pd.Series) -> pd.Series:
    """The C library's logarithm: Java's may differ in its last bit, and so in which sums of logarithms tie."""
    return x.map(math.log)


def median_of_ratios(cells: DataFrame, least_features: int = 100, learn: DataFrame | None = None) -> DataFrame:
    """(sample_id, factor): median ratio to the geometric mean, over features that are positive in every sample.

    All factors are null when fewer than `least_features` features qualify. Geometric means come from the samples of
    `learn` (sample_id) alone, if given; a sample's own zeros count for nothing then.
    """
    own = cells.join(learn.select("sample_id").distinct(), "sample_id", "left_semi") if learn is not None else cells
    n = own.agg(F.countDistinct("sample_id").alias("_n"))
    per = own.groupBy("feature").agg(F.avg(F.ln(F.when(F.col("value") > 0, F.col("value")))).alias("lg"), F.min("value").alias("lo"), F.count(F.lit(1)).alias("m"))
    good = per.join(F.broadcast(n)).filter("lo > 0 AND m = _n").select("feature", "lg")
    enough = good.agg((F.count(F.lit(1)) >= least_features).alias("_enough"))
    out = cells.filter("value > 0").join(good, "feature").groupBy("sample_id").agg(F.exp(F.percentile(F.ln("value") - F.col("lg"), F.lit(0.5))).alias("factor"))
    return out.join(F.broadcast(enough)).select("sample_id", F.when(F.col("_enough"), F.col("factor")).alias("factor"))


def tmm(cells: DataFrame, ratio_trim: float = 0.3, sum_trim: float = 0.05, learn: DataFrame | None = None) -> DataFrame:
    """(sample_id, factor): trimmed mean of log ratios against the sample whose upper quartile is nearest to the mean.

    Log ratios and abundances are trimmed by average rank, the rest is weighted by inverse variance, and the factors are
    centred to a geometric mean of one. The reference sample and the centre come from the samples of `learn` (sample_id)
    alone, if given.
    """
    known = (lambda d: d.join(learn.select("sample_id").distinct(), "sample_id", "left_semi")) if learn is not None else (lambda d: d)
    rows = cells.filter("value > 0").select("sample_id", "feature", "value")
    lib = rows.groupBy("sample_id").agg(F.sum("value").alias("lib"), (F.percentile("value", F.lit(0.75)) / F.sum("value")).alias("q"))
    mean = known(lib).agg(F.avg("q").alias("mq"))
    ref = known(lib).join(F.broadcast(mean)).agg(F.min_by(F.struct("sample_id", "lib"), F.struct(F.abs(F.col("q") - F.col("mq")), "sample_id")).alias("r")).select("r.sample_id", F.col("r.lib").alias("rlib"))
    base = rows.join(F.broadcast(ref), "sample_id").select("feature", F.col("value").alias("rv"), "rlib")
    x, y = F.col("value") / F.col("lib"), F.col("rv") / F.col("rlib")
    two = F.lit(math.log(2))  # in the order of the SQL, as its roundings decide which abundances tie
    pairs = rows.join(lib.select("sample_id", "lib"), "sample_id").join(base, "feature").select(
        "sample_id", (_log(x) / two - _log(y) / two).alias("m"), ((_log(x) + _log(y)) / two / 2).alias("a"),
        ((F.col("lib") - F.col("value")) / F.col("lib") / F.col("value") + (F.col("rlib") - F.col("rv")) / F.col("rlib") / F.col("rv")).alias("v"),
    )
    n = pairs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = pairs.select("*", window_ranks("m", "sample_id").alias("rm"), window_ranks("a", "sample_id").alias("ra")).join(n, "sample_id")
    inside = lambda r, t: (F.col(r) >= F.floor(F.col("n") * t) + 1) & (F.col(r) <= F.col("n") - F.floor(F.col("n") * t))
    kept = ranked.filter(inside("rm", ratio_trim) & inside("ra", sum_trim) & (F.col("v") > 0))
    logs = kept.groupBy("sample_id").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("l"))
    every = lib.select("sample_id").join(logs, "sample_id", "left").withColumn("l", F.coalesce("l", F.lit(0.0)))
    centre = known(every).agg(F.avg("l").alias("c"))
    return every.join(F.broadcast(centre)).select("sample_id", F.pow(F.lit(2.0), F.col("l") - F.col("c")).alias("factor"))


def normalised(cells: DataFrame, method: str = "log2cpm", learn: DataFrame | None = None, least_features: int = 100) -> DataFrame:
    """cells as log2 of scaled counts, with `normalization` and `whole_matrix`: does a value depend on other samples?

    log2cpm scales by the sample's own total, tmm by total and factor to a million, median_of_ratios by the factor.
    Samples without a factor (a total of zero, too few features) have null values.
    """
    if method not in ("log2cpm", "tmm", "median_of_ratios"):
        raise ValueError(f"no normalisation of the name {method}")
    total = cells.groupBy("sample_id").agg((F.sum("value") / 1e6).alias("_t"))
    if method == "log2cpm":
        scale = total.select("sample_id", F.col("_t").alias("_scale"))
    elif method == "tmm":
        scale = total.join(tmm(cells, learn=learn), "sample_id").select("sample_id", (F.col("_t") * F.col("factor")).alias("_scale"))
    else:
        scale = median_of_ratios(cells, least_features, learn).select("sample_id", F.col("factor").alias("_scale"))
    value = F.when(F.col("_scale") > 0, F.log2(F.col("value") / F.col("_scale") + 1)).alias("value")
    kept = [c for c in cells.columns if c != "value"]
    return cells.join(scale, "sample_id", "left").select(*kept, value, F.lit(method).alias("normalization"), F.lit(method != "log2cpm").alias("whole_matrix"))


def normalised_by_fold(cells: DataFrame, folds: DataFrame, k: int, method: str, least_features: int = 100) -> DataFrame:
    """(outer_fold, ...): the same for every outer fold, where all that needs several samples is learned in training."""
    out = None
    for fold in range(k):
        one = normalised(cells, method, folds.filter(F.col("outer_fold") != fold), least_features).withColumn("outer_fold", F.lit(fold)).withColumn("whole_matrix", F.lit(False))
        out = one if out is None else out.unionByName(one)
    return out
