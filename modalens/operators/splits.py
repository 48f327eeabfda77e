"""Fold tables (sample_id, outer_fold). Every choice is a hash, so folds don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalens.functions.rank import running_counts


def clamp(samples: DataFrame, wanted: int, label: str | None = None, group: str | None = None) -> DataFrame:
    """(folds): the wanted number, at most the groups and the smallest class, at least 2."""
    parts = [F.lit(wanted).cast("long")]
    one = samples.agg(F.countDistinct(group).alias("g")) if group else samples.agg(F.count(F.lit(1)).alias("g"))
    if label:
        smallest = samples.groupBy(label).agg(F.countDistinct(group).alias("m") if group else F.count(F.lit(1)).alias("m")).agg(F.min("m").alias("c"))
        one, parts = one.join(F.broadcast(smallest)), [*parts, F.col("c")]
    return one.select(F.greatest(F.lit(2).cast("long"), F.least(*parts, F.col("g"))).alias("folds"))


def stratified(samples: DataFrame, k: int, label: str, seed: int = 5, shards: int = 64) -> DataFrame:
    """Folds whose class counts differ by at most one, in the order of a hash of the id.

    A class is ranked in shards by hash, with the counts of lower shards added, so no task holds a class.
    """
    rows = samples.select("sample_id", label).withColumn("_o", F.xxhash64(F.lit(seed), "sample_id")).withColumn("_s", F.pmod("_o", F.lit(shards)))
    counts = rows.groupBy(label, "_s").agg(F.count(F.lit(1)).alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(label).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_s").orderBy("_o", "sample_id")))
    on = F.col("r._s").eqNullSafe(F.col("c._s")) & F.col(f"r.{label}").eqNullSafe(F.col(f"c.{label}"))
    placed = ranked.alias("r").join(counts.withColumn("_b", before).alias("c"), on)
    return placed.select("r.sample_id", ((F.col("_b") + F.col("_r") - 1) % k).cast("int").alias("outer_fold"))


def k_fold(samples: DataFrame, k: int, seed: int = 5) -> DataFrame:
    """Folds of equal size."""
    return stratified(samples.select("sample_id", F.lit(0).alias("_all")), k, "_all", seed)


def grouped(samples: DataFrame, k: int, label: str | None = None, group: str = "group_id", seed: int = 5, shards: int = 64) -> DataFrame:
    """Folds that never divide a group.

    Groups are dealt in turn, there and back: by the set of their classes, then largest first, then by their class
    counts. Their places come from the counts of each such kind and from hash shards inside it, so no task ranks all.
    """
    folds = _dealt(samples, k, label, group, seed, shards)
    return samples.select("sample_id", group).join(folds, group).select("sample_id", "outer_fold")


def _dealt(samples: DataFrame, k: int, label: str | None, group: str, seed: int, shards: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, group, outer_fold): the deal of `grouped`, on its own for every key of `by`."""
    per = samples.groupBy(*by, group, *([label] if label else [])).agg(F.count(F.lit(1)).alias("m"))
    names = F.sort_array(F.collect_list(F.struct(*([F.col(label).cast("string").alias("c")] if label else [F.lit("").alias("c")]), "m")))  # an entry per class
    kind = per.groupBy(*by, group).agg(F.sum("m").alias("size"), names.alias("x"))
    sign = lambda f: F.array_join(F.transform("x", lambda e: F.coalesce(e[f].cast("string"), F.lit(""))), ",")
    kind = kind.select(*by, group, "size", sign("c").alias("classes"), sign("m").alias("counts"), F.xxhash64(F.lit(seed), *by, group).alias("_o")).withColumn("_s", F.pmod("_o", F.lit(shards)))
    cell = [*by, "classes", "size", "counts"]
    counts = kind.groupBy(*cell, "_s").agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.groupBy(*cell).agg(F.sum("n").alias("n"))
    later = Window.partitionBy(*by, "classes").orderBy(F.desc("size"), "counts").rowsBetween(Window.unboundedPreceding, -1)  # over kinds of groups
    sets = kinds.groupBy(*by, "classes").agg(F.sum("n").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("classes").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over sets of classes
    starts = kinds.select(*cell, F.coalesce(F.sum("n").over(later), F.lit(0)).alias("_k")).join(sets.select(*by, "classes", first.alias("_set")), [*by, "classes"])
    own = F.coalesce(F.sum("n").over(Window.partitionBy(*cell).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*cell, "_s", own.alias("_b")).join(starts, cell)
    at = F.row_number().over(Window.partitionBy(*cell, "_s").orderBy("_o", group)) - 1
    placed = kind.withColumn("_r", at).join(starts, [*cell, "_s"]).withColumn("_at", F.col("_set") + F.col("_k") + F.col("_b") + F.col("_r"))
    lap, place = F.floor(F.col("_at") / k), F.col("_at") % k
    return placed.select(*by, group, F.when(lap % 2 == 0, place).otherwise(k - 1 - place).cast("int").alias("outer_fold"))


def blocked(samples: DataFrame, k: int, batch: str = "batch") -> DataFrame:
    """Folds that never divide a batch; at least three batches are needed."""
    n = samples.filter(F.col(batch).isNotNull()).agg(F.countDistinct(batch)).first()[0]
    if n < 3:
        raise ValueError(f"a split by batches needs three of them, here are {n}")
    return grouped(samples, min(k, n), group=batch)


def naive(samples: DataFrame, k: int, label: str, seed: int = 5) -> DataFrame:
    """(sample_id, outer_fold, arm): the unsafe arm, stratified by rows whatever their groups."""
    return stratified(samples, k, label, seed).withColumn("arm", F.lit("naive"))


def inner(samples: DataFrame, folds: DataFrame, k: int, label: str | None, seed: int = 6, group: str = "group_id") -> DataFrame:
    """(sample_id, outer_fold, inner_fold): folds inside every outer training set that never divide a group.

    All outer folds are dealt at once, each on its own.
    """
    train = _training(samples, folds, group, *([label] if label else []))
    dealt = _dealt(train, k, label, group, seed, 64, ("_outer",))
    return train.join(dealt.withColumnRenamed("outer_fold", "inner_fold"), ["_outer", group]).select("sample_id", F.col("_outer").alias("outer_fold"), "inner_fold")


def _training(samples: DataFrame, folds: DataFrame, *columns: str) -> DataFrame:
    """(_outer, sample_id, columns): the training samples of every outer fold _outer."""
    outer = folds.select(F.col("outer_fold").alias("_outer")).distinct()
    return samples.select("sample_id", *columns).join(folds, "sample_id").join(F.broadcast(outer)).filter("_outer <> outer_fold").drop("outer_fold")  # a row per fold


def naive_inner(samples: DataFrame, folds: DataFrame, k: int, label: str, seed: int = 6) -> DataFrame:
    """(sample_id, outer_fold, inner_fold): the unsafe arm's folds inside its training sets, by rows whatever their groups."""
    outer = folds.select("outer_fold").distinct()
    train = samples.select("sample_id", label).join(folds, "sample_id").withColumnRenamed("outer_fold", "own").join(F.broadcast(outer)).filter("own <> outer_fold")
    o = F.xxhash64(F.lit(seed), "outer_fold", "sample_id")
    rows = train.select("sample_id", "outer_fold", F.col(label).alias("_l"), o.alias("_o")).withColumn("_s", F.pmod("_o", F.lit(64)))
    own = F.row_number().over(Window.partitionBy("outer_fold", "_l", "_s").orderBy("_o", "sample_id")) - 1
    counts = rows.groupBy("outer_fold", "_l", "_s").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("outer_fold", "_l").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("outer_fold").alias("_outer"), F.col("_l").alias("_m"), F.col("_s").alias("_t"), before.alias("_b"))
    on = (F.col("outer_fold") == F.col("_outer")) & F.col("_l").eqNullSafe(F.col("_m")) & (F.col("_s") == F.col("_t"))
    return rows.withColumn("_r", own).join(counts, on).select("sample_id", "outer_fold", ((F.col("_r") + F.col("_b")) % k).cast("int").alias("inner_fold"))


def violations(samples: DataFrame, folds: DataFrame, group: str = "group_id") -> DataFrame:
    """(rule, n): groups in several folds, samples in no fold or in several, folds of unknown samples."""
    joined = samples.select("sample_id", group).join(folds, "sample_id")
    rules = [
        ("divided group", joined.groupBy(group).agg(F.countDistinct("outer_fold").alias("k")).filter("k > 1")),
        ("not covered", samples.select("sample_id").join(folds, "sample_id", "left_anti")),
        ("covered twice", folds.groupBy("sample_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")),
        ("unknown sample", folds.join(samples, "sample_id", "left_anti")),
    ]
    out = None
    for name, rows in rules:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def support(samples: DataFrame, folds: DataFrame, label: str, group: str = "group_id") -> DataFrame:
    """(outer_fold, side, n, classes, groups) of the assessment and the training side."""
    rows = samples.join(folds, "sample_id").withColumnRenamed("outer_fold", "own").join(F.broadcast(folds.select("outer_fold").distinct()))
    side = F.when(F.col("own") == F.col("outer_fold"), "assessment").otherwise("train").alias("side")
    return rows.groupBy("outer_fold", side).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("classes"), F.countDistinct(group).alias("groups"))


def inner_violations(samples: DataFrame, folds: DataFrame, inner_folds: DataFrame, group: str = "group_id") -> DataFrame:
    """(outer_fold, rule, n) of inner folds (sample_id, outer_fold, inner_fold): every rule for every outer fold.

    Rules: a sample of the assessment side or of no fold inside, a training sample left out, one placed twice, a group in
    several inner folds, an inner fold that is the whole training side.
    """
    outer = folds.select("outer_fold").distinct()
    own = folds.withColumnRenamed("outer_fold", "own")
    train = own.join(F.broadcast(outer)).filter("own <> outer_fold").select("sample_id", "outer_fold")
    rules = {
        "outside of training": inner_folds.join(train, ["sample_id", "outer_fold"], "left_anti"),
        "left out": train.join(inner_folds, ["sample_id", "outer_fold"], "left_anti"),
        "placed twice": inner_folds.groupBy("outer_fold", "sample_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"),
        "divided group": inner_folds.join(samples.select("sample_id", group), "sample_id").groupBy("outer_fold", group).agg(F.countDistinct("inner_fold").alias("k")).filter("k > 1"),
        "empty side": inner_folds.groupBy("outer_fold").agg(F.countDistinct("inner_fold").alias("k")).filter("k < 2"),
    }
    out = None
    for name, rows in rules.items():
        one = rows.groupBy("outer_fold").agg(F.count(F.lit(1)).alias("n"))
        one = outer.join(one, "outer_fold", "left").select("outer_fold", F.lit(name).alias("rule"), F.coalesce("n", F.lit(0)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def regression_support(samples: DataFrame, folds: DataFrame, target: str, group: str = "group_id") -> DataFrame:
    """(outer_fold, groups, variance): groups of the assessment side and the population variance of their targets."""
    per = samples.join(folds, "sample_id").groupBy("outer_fold", group).agg(F.min(target).alias("_y"))
    return per.groupBy("outer_fold").agg(F.count(F.lit(1)).alias("groups"), F.var_pop("_y").alias("variance"))


def survival_support(samples: DataFrame, folds: DataFrame, time: str = "time", event: str = "event", group: str = "group_id") -> DataFrame:
    """(outer_fold, training_events, pairs): training groups with an event, comparable pairs of assessment groups."""
    per = samples.join(folds, "sample_id").groupBy(F.col("outer_fold").alias("own"), group).agg(F.min(time).alias("_t"), F.max(event).cast("long").alias("_e"))
    outer = folds.select("outer_fold").distinct()
    trained = outer.join(per.groupBy("own").agg(F.sum("_e").alias("e"))).filter("own <> outer_fold").groupBy("outer_fold").agg(F.sum("e").alias("training_events"))
    counts = per.groupBy(F.col("own").alias("outer_fold"), "_t").agg(F.sum("_e").alias("e"), F.count(F.lit(1)).alias("m"))
    total = counts.groupBy("outer_fold").agg(F.sum("m").alias("total"))
    later = F.col("total") - F.col("before") - F.col("m")
    pairs = running_counts(counts, ["outer_fold"], "_t", "m").join(F.broadcast(total), "outer_fold").groupBy("outer_fold").agg(F.sum(F.col("e") * later).alias("pairs"))
    return outer.join(trained, "outer_fold", "left").join(pairs, "outer_fold", "left").select("outer_fold", F.coalesce("training_events", F.lit(0)).alias("training_events"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def comparable_pairs(groups: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """(pairs): for every group with an event, the groups with a larger time, by one suffix sum over distinct times."""
    per = groups.groupBy(time).agg(F.sum(F.col(event).cast("long")).alias("e"), F.count(F.lit(1)).alias("m"))
    total = per.agg(F.sum("m").alias("total"))
    later = F.col("total") - F.col("before") - F.col("m")
    return running_counts(per, [], time, "m").join(F.broadcast(total)).withColumn("later", later).agg(F.coalesce(F.sum(F.col("e") * F.col("later")), F.lit(0)).alias("pairs"))


def digest(folds: DataFrame) -> DataFrame:
    """(digest) of a fold table, whatever the order of its rows: sums of row hashes, then one hash."""
    h = F.sha2(F.concat_ws("|", "sample_id", F.col("outer_fold").cast("string")), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return folds.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[part(i) for i in range(5)]), 256).alias("digest"))
