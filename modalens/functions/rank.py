"""Average ranks and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges where a fixed number is enough.
RANGES = 32
#: Rows of a key that one task orders, and the most ranges that a key is cut into.
RANGE_ROWS, MOST_RANGES = 200_000, 1024


def ranged(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with `_range`: keys of more than RANGE_ROWS rows are cut into ranges of their own values, the others are one.

    Larger values have larger ranges. The edges, one array for each large key, are all that is moved besides the rows.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    top, n_large = sizes.agg(F.max("_m"), F.count(F.when(F.col("_m") > RANGE_ROWS, 1))).first()
    if not n_large:
        return rows.withColumn("_range", F.lit(0))
    parts = min(MOST_RANGES, -(-top // RANGE_ROWS))
    large = sizes.filter(F.col("_m") > RANGE_ROWS).drop("_m")
    own = rows.join(F.broadcast(large) if n_large <= 4096 else large, keys, "left_semi") if keys else rows
    edges = own.groupBy(*keys).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("_edges"))
    edges = F.broadcast(edges) if n_large <= 4096 else edges  # up to 1,023 numbers for each large key
    placed = rows.join(edges, keys, "left") if keys else rows.join(edges)
    at = F.size(F.filter("_edges", lambda e: F.col(value) > e))
    return placed.withColumn("_range", F.when(F.col("_edges").isNull(), 0).otherwise(at)).drop("_edges")


def running_counts(counts: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """counts (keys, value, n), one row per key and value, with `before`: rows of the key with a smaller value.

    A window inside (key, range) and the totals of the lower ranges give the running count, so a key with a third of all
    rows is the work of many tasks.
    """
    placed = ranged(counts, keys, value)
    sums = placed.groupBy(*keys, "_range").agg(F.sum(n).alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "_range", F.coalesce(below, F.lit(0)).alias("_below"))
    inside = F.sum(n).over(Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    out = placed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums, [*keys, "_range"])
    return out.withColumn("before", F.col("_inside") + F.col("_below")).drop("_range", "_inside", "_below")


def running_sums(rows: DataFrame, keys: list[str], value: str, columns: list[str]) -> DataFrame:
    """rows (one per key and value) with each column's sum over the key's smaller values in its place."""
    placed = ranged(rows, keys, value)
    sums = placed.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    lower = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_range", *[F.coalesce(F.sum(f"_{c}").over(lower), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}).join(sums, [*keys, "_range"])
    return out.withColumns({c: F.col(f"_in_{c}") + F.col(f"_{c}") for c in columns}).drop("_range", *[f"_in_{c}" for c in columns], *[f"_{c}" for c in columns])


def running_extremes(rows: DataFrame, keys: list[str], value: str, low: str, high: str) -> DataFrame:
    """rows (one per key and value) with the smallest `low` from the value up, as `least`, and the largest `high` up to it, as `most`."""
    placed = ranged(rows, keys, value)
    by = Window.partitionBy(*keys)
    ends = placed.groupBy(*keys, "_range").agg(F.min(low).alias("_l"), F.max(high).alias("_h"))
    above = F.min("_l").over(by.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))
    below = F.max("_h").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*keys, "_range", above.alias("_above"), below.alias("_below"))
    own = Window.partitionBy(*keys, "_range")
    up = F.min(low).over(own.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0))
    down = F.max(high).over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("_up", up).withColumn("_down", down).join(ends, [*keys, "_range"])
    return out.withColumn("least", F.least("_up", "_above")).withColumn("most", F.greatest("_down", "_below")).drop("_range", "_up", "_down", "_above", "_below")


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """df with the average rank of `value` among the rows of its keys; null values get a null rank."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranks = running_counts(counts, keys, value).select(*keys, value, (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, [*keys, value], "left")


def window_ranks(value: str, *keys: str) -> Column:
    """The same as a column, for many keys of moderate size."""
    ties = Window.partitionBy(*keys, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def numbered(ids: DataFrame, column: str, out: str = "ix", shards: int = 64) -> DataFrame:
    """ids (distinct values of a column) with a number from 0 on, in order of their hash, ranked shard by shard."""
    rows = ids.select(column, F.xxhash64(column).alias("_o")).withColumn("_s", F.pmod("_o", F.lit(shards)))
    counts = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over the shards
    own = F.row_number().over(Window.partitionBy("_s").orderBy("_o", column))
    return rows.withColumn("_r", own).join(F.broadcast(counts.select("_s", before.alias("_b"))), "_s").select(column, (F.col("_b") + F.col("_r") - 1).cast("int").alias(out))
