"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modalens.storage import dropped, dropped_since, made, matched, shared_dir, written

__all__ = ["SPACE", "WORD", "documents", "dropped", "dropped_since", "free_name", "made", "matched", "shared_dir", "whole_text", "word_count", "words", "written"]

#: A word is a longest run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: str = "text") -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def words(col: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(col, SPACE), lambda w: w != "")


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of docs has it (names are alike whatever their case)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
