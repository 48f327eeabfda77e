"""Delimited and tidy sources, read into the long layout."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modalens.operators.clean import gene_symbol, rescued

DELIMITERS = ("\t", ",", ";", "|")


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that the first 20 lines have equally often, else the header's most frequent one, else white space."""
    lines = [r[0] for r in spark.read.text(path).limit(20).collect() if r[0].strip()]
    if not lines:
        raise ValueError(f"{path} is empty")
    steady = [d for d in DELIMITERS if lines[0].count(d) and len({x.count(d) for x in lines}) == 1]
    best = max(steady or DELIMITERS, key=lines[0].count)
    return best if lines[0].count(best) else r"\s+"


def _parts(line: Column, sep: str) -> Column:
    return F.split(line, sep if sep == r"\s+" else re.escape(sep))


def read_matrix(spark: SparkSession, path: str, modality: str, transposed: bool = False, id_pattern: str | None = None) -> DataFrame:
    """(sample_id, modality, feature, value) of a matrix with a header and an id column; blank ids and missing cells have no row.

    Lines are split against the header, so a table of many thousand columns never becomes a plan of as many expressions.
    """
    sep = detect_delimiter(spark, path)
    text = spark.read.text(path)
    header = text.first()[0].lstrip("﻿")
    names = [n.strip().strip('"') for n in (re.split(sep, header.strip()) if sep == r"\s+" else header.split(sep))]
    line = F.trim("value") if sep == r"\s+" else F.col("value")
    rows = text.filter(F.ltrim(F.translate("value", "﻿", "")) != header.lstrip()).filter(F.trim("value") != "").select(_parts(line, sep).alias("p"))
    head = F.array(*[F.lit(n) for n in names])
    cells = rows.select(F.trim(F.translate(F.col("p")[0], '"', "")).alias("row"), F.posexplode(F.slice("p", 2, len(names))).alias("ix", "raw"))
    cells = cells.select("row", F.get(head, F.col("ix") + 1).alias("column"), rescued(F.translate("raw", '"', "")).alias("value"))
    cells = cells.filter(~F.lower("row").isin("", "nan", "none") & F.col("value").isNotNull() & F.col("column").isNotNull() & (F.col("column") != ""))
    sample, feature = ("column", "row") if transposed else ("row", "column")
    ident = F.trim(sample)
    if id_pattern:
        ident = F.when(ident.rlike(id_pattern), F.regexp_extract(ident, id_pattern, 1)).otherwise(ident)
    return cells.select(ident.alias("sample_id"), F.lit(modality).alias("modality"), F.trim(feature).alias("feature"), "value")


def read_clinical(spark: SparkSession, path: str) -> DataFrame:
    """All columns as stripped strings; a file with a header only is refused."""
    sep = detect_delimiter(spark, path)
    table = spark.read.csv(path, sep=sep if sep != r"\s+" else " ", header=True, inferSchema=False)
    table = table.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip().lstrip("﻿")) for c in table.columns])
    if table.isEmpty():
        raise ValueError(f"{path} has a header only")
    return table


def tidy_cells(records: DataFrame, sample: str, feature: str, value: str, modality: str) -> DataFrame:
    """Long cells of tidy records, the mean of repeated ones."""
    rows = records.select(F.col(sample).alias("sample_id"), F.lit(modality).alias("modality"), F.col(feature).alias("feature"), F.col(value).cast("double").alias("value"))
    return rows.filter("sample_id IS NOT NULL AND feature IS NOT NULL AND value IS NOT NULL").groupBy("sample_id", "modality", "feature").agg(F.avg("value").alias("value"))


def molecular_cells(records: DataFrame, modality: str, sample: str = "sampleId", value: str = "value") -> DataFrame:
    """Long cells of molecular records with a nested gene: its symbol, or the record's own Entrez number where it has none."""
    fields = records.schema["gene"].dataType.names if "gene" in records.columns else []
    named = [F.col("gene.hugoGeneSymbol")] if "hugoGeneSymbol" in fields else []
    number = [F.col("entrezGeneId").cast("string")] if "entrezGeneId" in records.columns else []
    return tidy_cells(records.withColumn("_gene", F.coalesce(*named, *number, F.lit(None).cast("string"))), sample, "_gene", value, modality)


def joined_clinical(samples: DataFrame, patients: DataFrame, position: str) -> DataFrame:
    """A row per sample of two tables of attributes (sampleId, patientId, attr, value) and (patientId, attr, value).

    Attributes of the patient are joined by the sample's first patient; where both tables have an attribute, the sample's
    stands. PATIENT_ID keeps the patient, the group of all of its samples.
    """
    own = tidy_clinical(samples, "sampleId", "attr", "value", position)
    bridge = samples.filter("patientId IS NOT NULL").groupBy("sampleId").agg(F.min_by("patientId", position).alias("PATIENT_ID"))
    known = {c.lower() for c in own.columns}
    wide = tidy_clinical(patients, "patientId", "attr", "value", position)
    more = wide.select(F.col("patientId").alias("PATIENT_ID"), *[c for c in wide.columns if c != "patientId" and c.lower() not in known])
    return own.join(bridge, "sampleId", "left").join(more, "PATIENT_ID", "left").select(*own.columns, *[c for c in more.columns if c != "PATIENT_ID"], "PATIENT_ID")


def json_document_cells(documents: DataFrame, json: str, modality: str) -> DataFrame:
    """Long cells of JSON documents: a list of records, a map from numbers to records, or one record.

    A record has `metabolite_name` (or `metabolite_id`) and DATA, a map sample -> value.
    """
    record = "struct<metabolite_name: string, metabolite_id: string, DATA: map<string, string>>"
    text = F.trim(F.col(json))
    single = F.from_json(text, record)
    listed = F.from_json(text, f"array<{record}>")
    keyed = F.map_values(F.from_json(text, f"map<string, {record}>"))
    rows = F.when(text.startswith("["), listed).when(single["DATA"].isNotNull(), F.array(single)).otherwise(keyed)
    each = documents.select(F.explode(rows).alias("r")).select(F.coalesce("r.metabolite_name", "r.metabolite_id").alias("feature"), F.explode("r.DATA").alias("sample_id", "raw"))
    return each.select("sample_id", F.lit(modality).alias("modality"), "feature", rescued(F.col("raw")).alias("value")).filter("value IS NOT NULL AND feature IS NOT NULL")


def tidy_clinical(records: DataFrame, key: str, attribute: str, value: str, position: str) -> DataFrame:
    """One row per key, one column per attribute; of repeated attributes the first by position."""
    return records.groupBy(key).pivot(attribute).agg(F.min_by(value, position))


def condensed_factors(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, factor columns) of a ragged condensed table: only lines whose fourth field is `factor` count."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).select(F.get(p, F.lit(2)).alias("sample_id"), F.get(p, F.lit(3)).alias("kind"), F.get(p, F.lit(4)).alias("name"), F.get(p, F.lit(5)).alias("v"))
    return rows.filter("kind = 'factor' AND name IS NOT NULL").groupBy("sample_id").pivot("name").agg(F.min("v"))


def json_map_cells(records: DataFrame, feature: str, json: str, modality: str) -> DataFrame:
    """Long cells of one JSON map sample -> value per feature."""
    pairs = records.select(F.col(feature).alias("feature"), F.explode(F.from_json(json, "map<string,string>")).alias("sample_id", "raw"))
    return pairs.select("sample_id", F.lit(modality).alias("modality"), "feature", rescued(F.col("raw")).alias("value")).filter("value IS NOT NULL")


def factor_string(records: DataFrame, key: str, factors: str) -> DataFrame:
    """One column per name of `name:value | name:value`."""
    pair = F.explode(F.split(factors, r"\s*\|\s*")).alias("pair")
    rows = records.select(key, pair).select(key, F.trim(F.split("pair", ":", 2)[0]).alias("name"), F.trim(F.split("pair", ":", 2)[1]).alias("v"))
    return rows.filter("name <> '' AND v IS NOT NULL").groupBy(key).pivot("name").agg(F.min("v"))


def fusion_cells(records: DataFrame, sample: str, fusion: str, modality: str = "fusion", least: int = 5) -> DataFrame:
    """A cell of 1 for every gene of a sample's fusions that at least `least` samples have."""
    genes = records.select(F.col(sample).alias("sample_id"), F.explode(F.split(F.replace(fusion, F.lit("::"), F.lit("--")), "--")).alias("feature")).filter("feature <> ''").distinct()
    often = genes.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return genes.join(often, "feature", "left_semi").select("sample_id", F.lit(modality).alias("modality"), "feature", F.lit(1.0).alias("value"))


def cleaned_symbols(cells: DataFrame, position: str) -> DataFrame:
    """Cells under gene symbols without numbers; of columns that meet, the first by position."""
    named = cells.withColumn("feature", gene_symbol(F.col("feature")))
    return named.groupBy("sample_id", "modality", "feature").agg(F.min_by("value", position).alias("value"))


def raw_counts(spark: SparkSession, path: str, modality: str, names: str = "Gene Name") -> tuple[DataFrame, DataFrame]:
    """Cells of a feature-by-sample matrix and (feature, symbol) of its column of gene names; without one, no symbols."""
    cells = read_matrix(spark, path, modality, transposed=True).filter(F.col("sample_id") != names)
    sep = detect_delimiter(spark, path)
    text = spark.read.text(path)
    header = [h.strip().strip('"') for h in re.split(sep if sep == r"\s+" else re.escape(sep), text.first()[0].lstrip("\ufeff"))]
    if names not in header:
        return cells, spark.createDataFrame([], "feature string, symbol string")
    part = lambda i: F.trim(F.translate(F.get(_parts(F.col("value"), sep), F.lit(i)), '"\ufeff', ""))
    rows = text.select(part(0).alias("feature"), part(header.index(names)).alias("symbol"))
    return cells, rows.filter(F.col("symbol").isNotNull() & (F.col("symbol") != names) & ~F.lower("feature").isin("", "nan", "none"))


def target_of(cells: DataFrame, feature: str) -> DataFrame:
    """(sample_id, target): an outcome that is a column of another matrix; samples without a value have no row."""
    return cells.filter((F.col("feature") == feature) & F.col("value").isNotNull()).select("sample_id", F.col("value").alias("target"))


def suffix_label(ident: Column, suffix: str = ".N", with_it: str = "Normal", without: str = "Tumor") -> Column:
    """A label from the end of the id, for studies whose outcome table has none."""
    return F.when(ident.endswith(suffix), with_it).otherwise(F.when(ident.isNotNull(), without))


def scan_records(spark: SparkSession, paths: dict[str, str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(source, columns) as strings from parquet, csv, json and jsonl paths, and (source, line, problem) of unreadable lines.

    Lines of jsonl are judged one by one: what isn't JSON, or isn't an object, is a problem, and blank lines don't count.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    problems = spark.createDataFrame([], "source string, line string, problem string")
    records = spark.createDataFrame([], f"source string, {schema}")
    for source, path in paths.items():
        if source == "jsonl":
            lines = spark.read.text(path).filter(F.trim("value") != "")
            row = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
            read = lines.withColumn("_r", row).withColumn("_object", F.ltrim("value").startswith("{"))
            known = F.expr("try_parse_json(value)").isNotNull()
            problem = F.when(~known, "invalid JSON").when(~F.col("_object"), "row is not an object")
            read = read.withColumn("problem", problem)
            problems = problems.unionByName(read.filter("problem IS NOT NULL").select(F.lit(source).alias("source"), F.col("value").alias("line"), "problem"))
            table = read.filter("problem IS NULL").select(*[F.col("_r")[c].alias(c) for c in columns])
        elif source == "parquet":
            table = spark.read.parquet(path)
        else:
            table = spark.read.csv(path, header=True) if source == "csv" else spark.read.schema(schema).json(path)
        records = records.unionByName(table.select(F.lit(source).alias("source"), *[F.col(c).cast("string").alias(c) for c in columns]))
    return records, problems


def write_reports(folder: str, **tables: DataFrame) -> None:
    """Tables of metrics, ledgers and tests as csv with a header, one folder each; numbers stay numbers."""
    for name, t in tables.items():
        t.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_dataset(cells: DataFrame, samples: DataFrame, folder: str) -> None:
    """The landing layout: cells by modality, samples, and a descriptor with a JSON line per modality."""
    about = cells.groupBy("modality").agg(F.countDistinct("feature").alias("n_features"), F.countDistinct("sample_id").alias("n_samples"))
    about.write.mode("overwrite").json(f"{folder}/descriptor")
    cells.write.mode("overwrite").partitionBy("modality").parquet(f"{folder}/cells")
    samples.write.mode("overwrite").parquet(f"{folder}/samples")


def public_view(missing: DataFrame) -> DataFrame:
    """Aggregates in place of row-level missingness: no sample id leaves."""
    return missing.groupBy("modality").agg(F.count(F.lit(1)).alias("n_samples"), F.avg("missing_fraction").alias("mean_fraction"), F.max("missing_fraction").alias("max_fraction"))


#: Columns of an audit's tables that name samples, places of samples or files, none of which is published.
PRIVATE = ("sample_id", "coordinates", "path", "output_dir", "batch_by_modality", "api_key_env")


def public_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables as they may be published: row-level missingness as aggregates, without private columns, and none that are only those."""
    out = {}
    for name, t in tables.items():
        if {"sample_id", "missing_fraction"} <= set(t.columns):
            out[f"{name}_summary"] = public_view(t)
        elif "coordinates" not in t.columns and (rest := [c for c in t.columns if c not in PRIVATE]):
            out[name] = t.select(*rest)
    return out
