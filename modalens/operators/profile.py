"""Column profiles and checks before an audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalens.operators.clean import na_masked, number
from modalens.operators.provenance import bits


def clinical(table: DataFrame) -> DataFrame:
    """Per column: rows, distinct and missing values, numbers, numeric (0.8 or more), looks like an id.

    An id has a value of its own in every row that has one, more than one value, and isn't numeric.
    """
    text = table.select(*[F.col(c).cast("string").alias(c) for c in table.columns])
    long = text.unpivot([], text.columns, "column", "raw").withColumn("v", na_masked(F.col("raw")))
    out = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("n_distinct"), F.sum(F.col("v").isNull().cast("long")).alias("n_missing"),
        F.sum(number(F.col("v")).isNotNull().cast("long")).alias("n_numeric"),
    )
    present = F.col("n") - F.col("n_missing")
    return out.withColumn("numeric", F.col("n_numeric") >= 0.8 * F.greatest(present, F.lit(1))).withColumn("looks_like_id", (F.col("n_distinct") == present) & (F.col("n_distinct") > 1) & ~F.col("numeric"))


def examples(table: DataFrame, k: int = 4) -> DataFrame:
    """(column, value, place): the first k distinct values of every column, in order."""
    text = table.select(*[F.col(c).cast("string").alias(c) for c in table.columns])
    seen = text.unpivot([], text.columns, "column", "raw").select("column", na_masked(F.col("raw")).alias("value")).filter("value IS NOT NULL").distinct()
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy("value"))).filter(F.col("place") <= k)


def target_counts(samples: DataFrame, label: str, k: int = 10) -> DataFrame:
    """(label, n, place): the k commonest values of a target, ties in order."""
    per = samples.select(F.col(label).cast("string").alias("label")).filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label"))).filter(F.col("place") <= k)


def target_preview(samples: DataFrame, label: str, task: str = "auto") -> DataFrame:
    """What a column means as a target: task, n_missing, n_distinct, smallest and largest class or low and high, balanced, ok.

    Numbers in 0.8 of the rows and more than 12 distinct values make a regression. A classification needs two classes, a
    regression ten numbers.
    """
    raw = samples.select(na_masked(F.col(label).cast("string")).alias("v"))
    per = raw.groupBy("v").agg(F.count(F.lit(1)).alias("m")).withColumn("x", number(F.col("v")))
    given, is_number = F.col("v").isNotNull(), F.col("x").isNotNull()
    out = per.agg(
        F.coalesce(F.sum(F.when(~given, F.col("m"))), F.lit(0)).alias("n_missing"), F.count("v").alias("n_distinct"), F.min(F.when(given, F.col("m"))).alias("smallest"), F.max(F.when(given, F.col("m"))).alias("largest"),
        F.coalesce(F.sum(F.when(is_number, F.col("m"))), F.lit(0)).alias("n_numeric"), F.coalesce(F.sum(F.when(given, F.col("m"))), F.lit(0)).alias("_present"), F.min("x").alias("low"), F.max("x").alias("high"),
    )
    inferred = F.when((F.col("n_numeric") >= 0.8 * F.greatest("_present", F.lit(1))) & (F.col("n_distinct") > 12), "regression").otherwise("classification")
    out = out.withColumn("task", inferred if task == "auto" else F.lit(task))
    classes = F.col("task") == "classification"
    balanced = F.when(classes & (F.col("n_distinct") > 1), F.col("smallest") >= 0.4 * F.col("largest"))
    ok = F.when(classes, F.col("n_distinct") > 1).otherwise(F.col("n_numeric") >= 10)
    of = lambda c, when: F.when(when, F.col(c)).alias(c)
    return out.select("task", "n_missing", "n_distinct", of("smallest", classes), of("largest", classes), balanced.alias("balanced"), of("low", ~classes), of("high", ~classes), "n_numeric", ok.alias("ok"))


def target(samples: DataFrame, label: str) -> DataFrame:
    """Classes, smallest and largest, balanced if the smallest has 0.4 of the largest."""
    per = samples.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest"), F.max("n").alias("largest"))
    return out.withColumn("balanced", F.col("smallest") >= 0.4 * F.col("largest"))


def groups(samples: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups, the largest one's size, whether any repeats."""
    per = samples.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest")).withColumn("repeated", F.col("largest") > 1)


def crosstab(samples: DataFrame, batch: str, label: str) -> DataFrame:
    """Counts of batch by label with the share inside the batch; a batch of one class by over 0.9 is flagged."""
    cell = samples.groupBy(batch, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(batch)
    return cell.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("one_class", F.max("share").over(w) > 0.9)


def grouping(samples: DataFrame, label: str, group: str = "group_id") -> DataFrame:
    """n, groups, the fewest groups of a class; no_op if every row is a group, an error if a class lives in one group."""
    per = samples.groupBy(label).agg(F.countDistinct(group).alias("g")).agg(F.min("g").alias("fewest_groups"))
    every = samples.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(group).alias("n_groups"))
    return every.join(F.broadcast(per)).withColumn("no_op", F.col("n") == F.col("n_groups")).withColumn("error", F.col("fewest_groups") < 2)


def impure(samples: DataFrame, columns: list[str], group: str = "group_id") -> DataFrame:
    """Per column: groups in which it varies, and groups in which it is missing somewhere; no group is named."""
    per = samples.groupBy(group).agg(
        *[(F.countDistinct(c) > 1).cast("long").alias(f"v_{c}") for c in columns], *[(F.sum(F.col(c).isNull().cast("long")) > 0).cast("long").alias(f"m_{c}") for c in columns]
    )
    one = per.agg(*[F.sum(x).alias(x) for x in per.columns if x != group])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v_{c}").alias("n_varying"), F.col(f"m_{c}").alias("n_missing")) for c in columns]))
    return one.select(rows.alias("x")).select("x.*")


def exclusions(rules: list[tuple[str, DataFrame]]) -> DataFrame:
    """(rule, n): rows that each rule shuts out."""
    out = None
    for name, rows in rules:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def exclusion_rules(cells: DataFrame, samples: DataFrame, label: str, group: str = "group_id", min_class: int = 10) -> DataFrame:
    """(rule, n) of a study's five rules for samples; one that breaks several counts for each.

    No outcome, no subject, not in every table (of those that have cells), the same cells as a sample with a smaller id,
    and an outcome of fewer than min_class samples. Two samples are copies if the digests of their cells (modality,
    feature and the value's bits, sorted) are equal; samples without cells are no copies.
    """
    cell = F.sha2(F.concat_ws("\u0001", "modality", "feature", bits("value")), 256)
    known = cells.filter("value IS NOT NULL").select("sample_id", "modality", cell.alias("h"))
    per = known.groupBy("sample_id").agg(F.countDistinct("modality").alias("tables"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("h"))), 256).alias("digest"))
    sizes = samples.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    rows = samples.join(per, "sample_id", "left").join(sizes, label, "left").join(F.broadcast(known.agg(F.countDistinct("modality").alias("all"))))
    copies = rows.filter("digest IS NOT NULL").groupBy("digest").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate rows"))
    small = F.col(label).isNotNull() & (F.col("size") < min_class)
    rules = {"no outcome": F.col(label).isNull(), "no subject": F.col(group).isNull(), "not in every table": F.coalesce(F.col("tables"), F.lit(0)) < F.col("all"), "small class": small}
    counts = rows.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in rules.items()]).join(copies)
    return counts.unpivot([], [*rules, "duplicate rows"], "rule", "n")


def class_balance(samples: DataFrame, label: str) -> DataFrame:
    per = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = samples.agg(F.count(F.lit(1)).alias("total"))
    return per.join(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("total")).alias("share"))
