"""Permuted targets of whole groups inside training folds, and the audit of such a permutation."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalens.functions.tails import log_factorial
from modalens.storage import dropped, written


def training_groups(samples: DataFrame, folds: DataFrame, label: str, stratum: str, group: str = "group_id") -> DataFrame:
    """(outer_fold, group, stratum, y): the groups of every outer training side, one target each.

    A group whose rows differ in target or stratum, or that a fold divides, has no target of its own and is refused.
    """
    kinds = F.countDistinct(F.struct(label, stratum, "outer_fold")).alias("kinds")
    own = samples.join(folds, "sample_id").groupBy(group).agg(F.min(label).alias("y"), F.min(stratum).alias("stratum"), F.min("outer_fold").alias("own"), kinds)
    if own.filter("kinds > 1").limit(1).count():
        raise ValueError("a group has several targets, strata or folds")
    return own.join(F.broadcast(folds.select("outer_fold").distinct())).filter("own <> outer_fold").select("outer_fold", group, "stratum", "y")


def attainable(train: DataFrame) -> DataFrame:
    """(outer_fold, n_groups, log_assignments): natural logarithm of the number of distinct assignments inside strata.

    That is the sum over strata of ln n! less ln c! of each target's count.
    """
    cells = train.groupBy("outer_fold", "stratum", "y").agg(F.count(F.lit(1)).alias("c"))
    strata = cells.groupBy("outer_fold", "stratum").agg(F.sum("c").alias("n"))
    wanted = cells.select(F.col("c").alias("k")).unionByName(strata.select(F.col("n").alias("k"))).distinct()
    logs = wanted.select("k", log_factorial("k").alias("lf"))
    up = strata.join(logs, strata["n"] == logs["k"]).select("outer_fold", F.col("n"), "lf")
    down = cells.join(logs, cells["c"] == logs["k"]).select("outer_fold", F.lit(0).cast("long").alias("n"), (-F.col("lf")).alias("lf"))
    return up.unionByName(down).groupBy("outer_fold").agg(F.sum("n").alias("n_groups"), F.sum("lf").alias("log_assignments"))


def permuted_targets(train: DataFrame, seed: int = 41, tries: int = 16, group: str = "group_id") -> DataFrame:
    """(outer_fold, group, stratum, y, permuted): targets moved between the groups of a stratum, never all left in place.

    Groups are ordered twice by hash inside (fold, stratum), shard by shard, and exchange targets by place. The first of
    `tries` orders that changes a fold somewhere is taken; if none does, which one attainable assignment always causes,
    the targets are rotated by one place in the order of targets. A fold that allows no change has null targets.

    An order is worked out only for the folds that no earlier one has changed, and only where a stratum has several targets.
    """
    cell = ["outer_fold", "stratum"]
    train = written(train.select("outer_fold", group, "stratum", "y"), "training-groups")  # each is read by every try
    mixed = train.groupBy(*cell).agg(F.countDistinct(F.struct("y")).alias("_k")).filter("_k > 1").select(*cell)
    movable, still = train.join(mixed, cell, "left_semi"), train.join(mixed, cell, "left_anti")

    def placed(rows: DataFrame, order) -> DataFrame:
        rows = rows.withColumn("_o", order).withColumn("_s", F.pmod("_o", F.lit(64)))
        counts = rows.groupBy(*cell, "_s").agg(F.count(F.lit(1)).alias("_m"))
        before = F.coalesce(F.sum("_m").over(Window.partitionBy(*cell).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = F.row_number().over(Window.partitionBy(*cell, "_s").orderBy("_o", group))
        return rows.withColumn("_r", own).join(counts.select(*cell, "_s", before.alias("_b")), [*cell, "_s"]).withColumn("_i", F.col("_b") + F.col("_r")).drop("_o", "_s", "_m", "_b", "_r")

    def names(rows: DataFrame) -> list:
        return sorted(r[0] for r in rows.select("outer_fold").distinct().collect())  # folds

    left, done, parts = names(movable), [], []
    for turn in range(1, tries + 1):
        if not left:
            break
        rows = movable.filter(F.col("outer_fold").isin(left))
        to = placed(rows, F.xxhash64(F.lit(seed), group))
        of = placed(rows, F.xxhash64(F.lit(seed), F.lit(turn), group, "outer_fold")).select(*cell, "_i", F.col("y").alias("permuted"))
        moved = written(to.join(of, [*cell, "_i"]).select("outer_fold", group, "stratum", "y", "permuted"), "permuted")
        if good := names(moved.filter("y <> permuted")):
            parts.append(moved.filter(F.col("outer_fold").isin(good)))
            done, left = done + good, [fold for fold in left if fold not in good]
        else:
            dropped(moved)
    lead = Window.partitionBy(*cell).orderBy("y", group)
    turned = movable.filter(F.col("outer_fold").isin(left)).withColumn("permuted", F.coalesce(F.lead("y").over(lead), F.first("y").over(lead)))
    able = names(turned.filter("y <> permuted")) if left else []
    if able:
        parts.append(turned.filter(F.col("outer_fold").isin(able)).select("outer_fold", group, "stratum", "y", "permuted"))
    changed = F.col("outer_fold").isin(done + able)
    parts.append(still.filter(changed).select("outer_fold", group, "stratum", "y", F.col("y").alias("permuted")))
    parts.append(train.filter(~changed).withColumn("permuted", F.lit(None).cast(train.schema["y"].dataType)))
    return functools.reduce(DataFrame.unionByName, parts)


def audit(train: DataFrame, candidate: DataFrame, group: str = "group_id") -> DataFrame:
    """(outer_fold, rule, n): breaches by a candidate (outer_fold, group, permuted), which may have a row per sample.

    Rules: a target that is not one per group, a training group without a target (or one that is not in training), targets
    of a stratum that are not its own ones in another order, and a fold where nothing moves. Rules that hold have no row.
    """
    per = candidate.groupBy("outer_fold", group).agg(F.count_distinct("permuted").alias("kinds"), F.min("permuted").alias("permuted"))
    both = train.join(per, ["outer_fold", group], "full")
    seen = both.filter("stratum IS NOT NULL AND permuted IS NOT NULL")
    old = both.filter("stratum IS NOT NULL").select("outer_fold", "stratum", F.col("y").alias("v"), F.lit(1).alias("k"))
    new = seen.select("outer_fold", "stratum", F.col("permuted").alias("v"), F.lit(-1).alias("k"))
    balance = old.unionByName(new).groupBy("outer_fold", "stratum", "v").agg(F.sum("k").alias("k")).filter("k <> 0").select("outer_fold", "stratum").distinct()
    still = train.select("outer_fold").distinct().join(seen.filter("y <> permuted").select("outer_fold").distinct(), "outer_fold", "left_anti")
    rules = {"not one per group": per.filter("kinds > 1"), "other groups": both.filter("stratum IS NULL OR permuted IS NULL"), "other targets": balance, "nothing moves": still}
    out = None
    for rule, rows in rules.items():
        one = rows.groupBy("outer_fold").agg(F.count(F.lit(1)).alias("n")).select("outer_fold", F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out
