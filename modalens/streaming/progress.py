"""Live progress of a run whose result rows land as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Result rows (JSON lines, one file or many) as they land."""
    return spark.readStream.schema(schema).json(folder)


def hourly(rows: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """(start, method_id, n, mean) of every hour of completion; a run that lands twice counts once.

    State is bounded by the watermark: repeats and hours older than `lateness` behind the newest row are let go.
    """
    once = rows.withWatermark("finished", lateness).dropDuplicatesWithinWatermark(["run_id"])
    per = once.groupBy(F.window("finished", "1 hour"), "method_id").agg(F.count(F.lit(1)).alias("n"), F.avg("primary_value").alias("mean"))
    return per.select(F.col("window.start").alias("start"), "method_id", "n", "mean")


def run(progress: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends closed hours to a Parquet folder; `once` stops when all that is there has been read."""
    writer = progress.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
