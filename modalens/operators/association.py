"""Association of batches with a distance between groups, by sums: no table of pairs of batches is built.

Both statistics are distance correlations after double centring (the global scale), of the distance "other batch" with
a second one. All that depends on the batches are the distances inside them and each group's number of partners, so a
permutation costs sums over groups (ranks) or one pass over the given pairs (representations).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalens.functions.rank import average_ranks, running_counts
from modalens.operators.groups import permuted
from modalens.storage import written


def labels(groups: DataFrame, batch: str, reps: int, least: int, group: str, stay: tuple[str, ...] = ()) -> DataFrame:
    """(rep, group, stay, batch, nb): the labels as they are (rep 0) and permuted, with their batch's number of groups.

    Fewer than two batches, or one of fewer than `least` groups, is refused. Without replicates there is no p.
    """
    sizes = groups.groupBy(batch).agg(F.count(F.lit(1)).alias("nb"))
    n, small = sizes.agg(F.count(F.lit(1)), F.min("nb")).first()
    if n < 2 or small < least:
        raise ValueError(f"{n} batches, the smallest of {small} groups: two batches of {least} groups are needed")
    every = groups.select(F.lit(0).alias("rep"), group, *stay, batch)
    if reps:
        every = every.unionByName(permuted(groups, [batch], reps, group=group, stay=stay))
    return every.join(sizes, batch)


def tested(sums: DataFrame, sizes: DataFrame, within: DataFrame, total: DataFrame) -> DataFrame:
    """(n, dcor, p) from sums (rep, partners): of partners times distance sums, within (rep, w), total (n, t, row2, d2).

    `sizes` (rep, nb, n) has a row per group or, with k, one for k groups.
    """
    n, t = F.col("n"), F.col("t")
    nb = F.col("nb").cast("double")
    k = F.col("k") if "k" in sizes.columns else F.lit(1)
    batches = sizes.filter("rep = 0").agg(F.sum(k * nb).alias("nb2"), F.sum(k * (F.col("n") - nb) * (F.col("n") - nb)).alias("part2"))
    apart = n * n - F.col("nb2")
    xy = t - F.col("w") - 2 / n * F.col("partners") + apart * t / (n * n)
    xx = apart - 2 / n * F.col("part2") + apart * apart / (n * n)
    yy = F.col("d2") - 2 / n * F.col("row2") + t * t / (n * n)
    down = F.sqrt(xx * yy)
    value = sums.join(within, "rep").join(F.broadcast(total)).join(F.broadcast(batches)).select("rep", "n", F.when(down > 0, xy / down).alias("dcor"))
    hits = F.count(F.when((F.col("rep") > 0) & (F.col("dcor") >= F.col("_seen") - 1e-12), 1))
    seen = value.filter("rep = 0").select(F.col("dcor").alias("_seen"))  # one row
    return value.join(F.broadcast(seen)).groupBy("n", F.col("_seen").alias("dcor")).agg(F.count(F.when(F.col("rep") > 0, 1)).alias("_reps"), hits.alias("_hits")).select("n", "dcor", F.when((F.col("_reps") > 0) & F.col("dcor").isNotNull(), (1 + F.col("_hits")) / (1 + F.col("_reps"))).alias("p"))


def structure_by_batch(pairs: DataFrame, groups: DataFrame, batch: str, reps: int = 199, least: int = 2, group: str = "group_id") -> DataFrame:
    """(n, dcor, p) of distances (a, b, d), a < b, between groups' representations with their batches."""
    every = labels(groups, batch, reps, least, group)
    rows = pairs.select(F.col("a").alias(group), "d").unionByName(pairs.select(F.col("b").alias(group), "d")).groupBy(group).agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"))
    total = groups.agg(F.count(F.lit(1)).alias("n")).join(rows.agg(F.sum("s").alias("t"), F.sum(F.col("s") * F.col("s")).alias("row2"), F.sum("q").alias("d2")))
    sizes = every.join(F.broadcast(total.select("n")))
    sums = sizes.join(rows, group).groupBy("rep").agg(F.sum((F.col("n") - F.col("nb")) * F.col("s")).alias("partners"))
    carried = every.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", batch))), lambda x: x[batch]).alias("l"))  # reps + 1 labels
    both = pairs.join(carried.select(F.col(group).alias("a"), F.col("l").alias("la")), "a").join(carried.select(F.col(group).alias("b"), F.col("l").alias("lb")), "b")
    same = both.select("d", F.posexplode(F.zip_with("la", "lb", lambda x, y: x == y)).alias("rep", "same"))
    within = same.groupBy("rep").agg((2 * F.sum(F.when(F.col("same"), F.col("d")).otherwise(0.0))).alias("w"))
    return tested(sums, sizes, within, total)


def continuous_by_batch(groups: DataFrame, target: str, batch: str, reps: int = 199, least: int = 2, group: str = "group_id") -> DataFrame:
    """(n, dcor, p) of the differences of a target's midranks with the batches; groups without a target are left out.

    A group's summed differences follow from its rank and ties; those inside a batch from running counts.
    """
    ranked = average_ranks(groups.filter(F.col(target).isNotNull()).withColumn("_all", F.lit(0)), ["_all"], target, "r").select(group, batch, "r")
    ties = ranked.groupBy("r").agg(F.count(F.lit(1)).alias("m"))
    n = ranked.agg(F.count(F.lit(1)).cast("double").alias("n"))
    r, m, size = F.col("r"), F.col("m"), F.col("n")
    lower = r - (m + 1) / 2
    below = lower * (lower + 1) / 2
    rows = ranked.join(ties, "r").join(F.broadcast(n)).select(group, "r", (r * (lower - (size - lower - m)) + size * (size + 1) / 2 - 2 * below - m * r).alias("s"))
    sums = rows.agg(F.sum("s").alias("t"), F.sum(F.col("s") * F.col("s")).alias("row2"), F.sum(r * r).alias("_rr"), F.sum("r").alias("_r"))
    total = sums.join(n).select(size.cast("long").alias("n"), "t", "row2", (2 * size * F.col("_rr") - 2 * F.col("_r") * F.col("_r")).alias("d2"))
    # groups of one rank, batch and replicate differ in nothing that is summed: counted once, what follows is sums over them
    own = labels(rows.join(ranked.select(group, batch), group), batch, reps, least, group, ("r", "s"))
    counts = written(own.groupBy("rep", batch, "nb", "r").agg(F.count(F.lit(1)).alias("k"), F.max("s").alias("s")), "ranks-by-batch").join(F.broadcast(total.select("n")))
    partners = counts.groupBy("rep").agg(F.sum(F.col("k") * (F.col("n") - F.col("nb")) * F.col("s")).alias("partners"))
    k = F.col("k")
    inside = r * (2 * k * F.col("before") + k * (k + 1) - k * (F.col("nb") + 1))
    within = running_counts(counts, ["rep", batch], "r", "k").groupBy("rep").agg((2 * F.sum(inside)).alias("w"))
    return tested(partners, counts, within, total)
