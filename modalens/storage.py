"""Intermediate tables in the folder that all machines of the cluster see."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import sys
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster see, named by spark.checkpoint.dir.

    Only a local session, whose executors are the driver's own process, may do without it: it gets a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors of {master} see")
    app = spark.sparkContext.applicationId
    return _FALLBACK.setdefault(app, tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))


def _deleted(path: str) -> None:
    jvm = SparkContext._active_spark_context._jvm if SparkContext._active_spark_context else getattr(SparkContext._gateway, "jvm", None)
    if jvm is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


_FOLDERS: set[str] = set()


@atexit.register
def _clear() -> None:
    """Intermediate tables that results may still have read until the program's end."""
    for path in _FOLDERS:
        try:
            _deleted(path)
        except Exception as e:  # the JVM may be gone before us; a folder that stays is named
            print(f"modalens: {path} is left: {e}", file=sys.stderr)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the program's own folder, which goes at its end."""
    folder = f"{shared_dir(spark)}/modalens-{spark.sparkContext.applicationId}"
    _FOLDERS.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: later stages read it, so a lost executor costs no recomputation.

    What the jobs before it shuffled is no longer referenced then; a collection lets Spark remove those files. All tables
    of a program lie in one folder, which goes at its end; `dropped` and `dropped_since` delete tables before that.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append(path)
    schema = df.schema
    del df
    gc.collect()
    spark.range(1).count()  # until another job runs, Spark's scheduler keeps hold of the last one and of its shuffles
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(schema).parquet(path)
    table._written_at = path
    if (own := getattr(_NOTES, "own", None)) is not None:
        own.append(table)
    return table


_MADE: list[str] = []
_NOTES = threading.local()


@contextlib.contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """The tables that this thread writes meanwhile: other threads' steps may need theirs."""
    outer, _NOTES.own = getattr(_NOTES, "own", None), []
    try:
        yield _NOTES.own
    finally:
        if outer is not None:
            outer += _NOTES.own
        _NOTES.own = outer


def made() -> int:
    """A mark for `dropped_since`."""
    return len(_MADE)


def dropped_since(mark: int, *but: DataFrame) -> None:
    """Deletes the tables written since the mark, but for those given: nothing may read them any more."""
    keep = {_path(t) for t in but}
    for path in [p for p in _MADE[mark:] if p not in keep]:
        _deleted(path)
        _MADE.remove(path)


def _path(table: DataFrame) -> str:
    return getattr(table, "_written_at", "")


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that nothing reads any more."""
    for path in filter(_MADE.__contains__, map(_path, tables)):
        _deleted(path)
        _MADE.remove(path)


def unlent(rows: DataFrame) -> DataFrame:
    """A table that grows with the input, as the side of a join which Spark doesn't broadcast.

    Rows in order make so small a file that Spark takes millions of them for few, and the driver would collect them all.
    """
    return rows.hint("merge")


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", n: str = "n", hot_rows: int = 20_000) -> DataFrame:
    """left joined to right, whose keys are unique and whose column n says how many rows of left a key has.

    A key with more than hot_rows of them and more than a thousandth of all is hot. There are fewer than a thousand hot
    keys, so their rows are broadcast and no task gets all rows of one; the other keys are joined by a shuffle.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = right.filter(F.col(n) > max(hot_rows, total // 1000))
    if hot.isEmpty():
        return left.join(right, keys, how)
    names = F.broadcast(hot.select(*keys))
    rest = left.join(names, keys, "left_anti").join(right.join(names, keys, "left_anti"), keys, how)
    return left.join(F.broadcast(hot), keys).unionByName(rest)
