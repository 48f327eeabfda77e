"""Alignment of tables on sample ids, all on the long layout, with equi, semi and anti joins only."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def orientation(labels: DataFrame, reference: DataFrame) -> DataFrame:
    """(row_share, column_share, transpose) of a table's labels (axis row/column, label) among the reference ids."""
    known = labels.distinct().join(reference.select(F.col("sample_id").alias("label"), F.lit(1).alias("_hit")).distinct(), "label", "left")
    share = lambda axis: F.avg(F.when(F.col("axis") == axis, F.coalesce("_hit", F.lit(0))))
    out = known.agg(share("row").alias("row_share"), share("column").alias("column_share"))
    return out.withColumn("transpose", F.col("column_share") > F.col("row_share"))


def common_samples(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Ids that every modality and the sample table have: one shuffle for any number of modalities."""
    m = cells.agg(F.countDistinct("modality").alias("m"))
    per = cells.groupBy("sample_id").agg(F.countDistinct("modality").alias("k"))
    return per.join(F.broadcast(m)).filter("k = m").select("sample_id").join(samples.select("sample_id").distinct(), "sample_id", "left_semi")


def collapsed(cells: DataFrame) -> DataFrame:
    """Mean of the rows that share a sample, modality and feature; missing values are left out."""
    return cells.groupBy("sample_id", "modality", "feature").agg(F.avg("value").alias("value"))


def first_kept(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row of each key: the one with the smallest position."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("_x")).select(*keys, "_x.*")


def unmatched_batches(sample_batches: DataFrame, modalities: DataFrame) -> DataFrame:
    """(modality, problem): modalities without batch labels and batch labels without a modality."""
    a, b = modalities.select("modality").distinct(), sample_batches.select("modality").distinct()
    return a.join(b, "modality", "left_anti").withColumn("problem", F.lit("no batch")).unionByName(b.join(a, "modality", "left_anti").withColumn("problem", F.lit("no modality")))


def sample_batches(clinical: DataFrame, columns: dict[str, str], modalities: DataFrame, key: str = "sample_id") -> DataFrame:
    """(sample_id, modality, batch) from one clinical column for each modality.

    The columns must cover the modalities exactly and exist; else it raises, naming what is wrong.
    """
    names = {r[0] for r in modalities.select("modality").distinct().collect()}  # modalities
    if names != set(columns):
        raise ValueError(f"batch columns must cover every modality exactly: {sorted(names ^ set(columns))}")
    if gone := sorted(set(columns.values()) - set(clinical.columns)):
        raise ValueError(f"no clinical column {gone}")
    pairs = F.array(*[F.struct(F.lit(m).alias("modality"), F.col(c).cast("string").alias("batch")) for m, c in sorted(columns.items())])
    return clinical.select(F.col(key).alias("sample_id"), F.explode(pairs).alias("x")).select("sample_id", "x.*")


def overall_preview(cells: DataFrame, samples: DataFrame, least: int = 10) -> DataFrame:
    """(n_clinical, n_layers, matched_all, low_overlap, hint, ok): samples that every layer has, and what may be wrong with few.

    Under half of the clinical ids is low; the hint names three unmatched ids of the first layer that has any.
    """
    ids = cells.select("modality", "sample_id").distinct()
    layers = ids.agg(F.countDistinct("modality").alias("n_layers"))
    known = samples.select("sample_id").distinct()
    everywhere = ids.join(known, "sample_id", "left_semi").groupBy("sample_id").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(layers)).filter("k = n_layers").agg(F.count(F.lit(1)).alias("matched_all"))
    place = F.row_number().over(Window.partitionBy("modality").orderBy("sample_id"))
    odd = ids.join(known, "sample_id", "left_anti").withColumn("rn", place).filter("rn <= 3")
    first = odd.groupBy("modality").agg(F.array_join(F.array_sort(F.collect_list("sample_id")), ", ").alias("odd")).agg(F.min_by("odd", "modality").alias("odd"))
    n = known.agg(F.count(F.lit(1)).alias("n_clinical"))
    low = F.col("matched_all") < 0.5 * F.greatest(F.lit(1), F.col("n_clinical"))
    hint = F.when(low & F.col("odd").isNotNull(), F.concat(F.lit("low overlap, ids like "), "odd"))
    return n.join(layers).join(everywhere).join(first).select("n_clinical", "n_layers", "matched_all", low.alias("low_overlap"), hint.alias("hint"), (F.col("matched_all") >= least).alias("ok"))  # one row each


def preview(cells: DataFrame, samples: DataFrame, examples: int = 8, least: int = 10) -> DataFrame:
    """Per modality: ids, matched ids, unmatched examples in order, and whether enough match."""
    ids = cells.select("modality", "sample_id").distinct()
    known = ids.join(samples.select("sample_id", F.lit(1).alias("hit")).distinct(), "sample_id", "left")
    counts = known.groupBy("modality").agg(F.count(F.lit(1)).alias("n_ids"), F.count("hit").alias("n_matched"))
    rn = F.row_number().over(Window.partitionBy("modality").orderBy("sample_id"))
    odd = known.filter("hit IS NULL").withColumn("rn", rn).filter(F.col("rn") <= examples)
    odd = odd.groupBy("modality").agg(F.array_join(F.array_sort(F.collect_list("sample_id")), ",").alias("unmatched"))
    return counts.join(odd, "modality", "left").select("modality", "n_ids", "n_matched", F.coalesce("unmatched", F.lit("")).alias("unmatched"), (F.col("n_matched") >= least).alias("ok"))


def outstanding(expected: DataFrame, observed: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with their problem: expected ones with neither a row nor a failure, and rows that nobody expects."""
    said = lambda rows, **flags: rows.select(*keys, *[F.lit(flags.get(c, False)).alias(c) for c in ("_want", "_seen", "_done")])
    rows = said(expected, _want=True).unionAll(said(observed, _seen=True, _done=True)).unionAll(said(failed, _done=True))
    one = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("_want", "_seen", "_done")])  # one shuffle, no join
    blank = functools.reduce(operator.or_, [F.col(k).isNull() for k in keys])  # a null key matches no other
    missing = F.when(F.col("_want") & (~F.col("_done") | blank), "missing")
    unexpected = F.when(F.col("_seen") & (~F.col("_want") | blank), "unexpected")
    return one.select(*keys, F.explode(F.array_compact(F.array(missing, unexpected))).alias("problem"))


def reindexed(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Cells of the listed samples only; a listed sample without a cell stays absent."""
    return cells.join(samples.select("sample_id").distinct(), "sample_id", "left_semi")


def attempts(rows: DataFrame, failures: DataFrame, index: DataFrame, keys: list[str], condition: list[str]) -> DataFrame:
    """(keys, condition, scored, failed, attempted): a failure names its dataset only, the task index its condition.

    Datasets that the index doesn't list are left out on either side.
    """
    at = index.select("dataset_id", *condition).dropDuplicates(["dataset_id"])
    both = rows.select("dataset_id", *keys, F.lit(1).alias("_s")).unionByName(failures.select("dataset_id", *keys, F.lit(0).alias("_s")))
    per = both.groupBy("dataset_id", *keys).agg(F.sum("_s").alias("_s"), F.count(F.lit(1)).alias("_n"))
    out = per.join(at, "dataset_id").groupBy(*keys, *condition).agg(F.sum("_s").alias("scored"), F.sum("_n").alias("attempted"))
    return out.select(*keys, *condition, "scored", (F.col("attempted") - F.col("scored")).alias("failed"), "attempted")


def result_sets(**tables: DataFrame) -> DataFrame:
    """Results of several families of models in one table, a column that one of them lacks being null there."""
    parts = [t.select(F.lit(name).alias("family"), "*") for name, t in tables.items()]
    out = parts[0]
    for t in parts[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def paired_arms(rows: DataFrame, keys: list[str], arm: str, value: str, unsafe: str, safe: str) -> DataFrame:
    """(keys, unsafe, safe, gap) where both arms have a value: one aggregation instead of a self-join."""
    mean = lambda a: F.avg(F.when(F.col(arm) == a, F.col(value)))
    out = rows.groupBy(*keys).agg(mean(unsafe).alias("unsafe"), mean(safe).alias("safe"))
    return out.filter("unsafe IS NOT NULL AND safe IS NOT NULL").withColumn("gap", F.col("unsafe") - F.col("safe"))
