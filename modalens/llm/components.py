"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalens.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of the edges (a, b) with the smallest node that it can reach.

    Alternates the large-star and small-star steps until the edges no longer change: each step links neighbours to the
    smallest one, so the number of rounds is logarithmic in practice and no step makes more edges than there were. The
    edges stay in tables; only their checksum comes to the driver.
    """
    now = written(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 40)))).first()
        if state == before:
            break
        before = state
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(now.select(F.col("hi"), F.col("lo")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo < hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        now = written(
            small.filter("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionAll(least.select(F.col("m").alias("lo"), "hi")).filter("lo < hi").distinct(), "edges"
        )
    return now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("label")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
