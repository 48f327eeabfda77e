"""The corpus pipeline: language ID, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every document that its predecessor kept. All but the last return
the columns of `documents`; what stands between stages is a Parquet table, so a lost executor costs one stage's work,
and it goes once the next stage's rows are written.

Defined cases: a null or empty text has no language, so it goes first; null ids are kept by every other stage and linked
with nothing; rows that repeat an id stay or go together as near-duplicates and are documents of their own elsewhere; a
null source is a source, last in order; further columns, whatever their names, pass through every stage but the last;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalens.llm import lang_id, mixing, near_dup, packing, pii
from modalens.llm.common import documents, dropped_since, free_name, made, written

#: SQL has no trained context trees, sketches or knapsack programmes; tests hold the stages against brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: a text with a letter, and one language ahead of all others together."""
    model = lang_id.Model(lang_id.sample(docs, per_language=200, max_bytes=1 << 16))
    p = free_name(docs, "prediction")
    return lang_id.predicted(docs, model, name=p).filter((F.col(f"{p}.lang_pred") != lang_id.UNKNOWN) & (F.col(f"{p}.score") > 0.5)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one with the smallest id."""
    gone = near_dup.near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each stretch of personal data replaced by its kind; the number of characters follows."""
    clean = pii.redacted_documents(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight: a document stays once for each time that it is taken."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in the batches of their length buckets."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read again as the next one's documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        mark = made() - (name != STAGES[0][0])  # the stage's own tables and its predecessor's rows
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped_since(mark, docs)
    return docs
