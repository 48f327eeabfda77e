"""Packing into optimal length buckets.

A text becomes pieces of at most `max_len` words (the rest of a long text is the last piece). Spark counts pieces by
exact length; this histogram has at most `max_len` rows, whatever the corpus holds, and a dynamic programme over it
chooses the bucket boundaries with the least padding. Pieces are then ranked inside their bucket, and every batch takes
the next floor(token_budget / boundary) of them. A bucket that holds a third of all rows is split into shards of ids;
counts by shard give each shard's first rank, so ranks run through the bucket and no task holds a bucket.

Defined cases: texts without words (null ones too) have no piece; the order of rows never matters; rows that repeat an
id give pieces of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalens.llm.common import word_count, written


def boundaries(lengths: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """At most k bucket ends among `lengths` (ascending) with the least total padding, and that padding.

    best[j, e]: least padding of the lengths up to e in j buckets. The cost of a bucket (s, e] is
    lengths[e] * count(s, e] - words(s, e], so each row of the programme is one minimum over s.
    """
    n = len(lengths)
    if n == 0:
        return lengths, 0
    c = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    w = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.int64)
    big = np.iinfo(np.int64).max // 4
    best, came = np.full(n + 1, big), []
    best[0] = 0
    for _ in range(min(k, n)):
        nxt, frm = best.copy(), np.full(n + 1, -1)
        for e in range(1, n + 1):
            cost = best[:e] + lengths[e - 1] * (c[e] - c[:e]) - (w[e] - w[:e])
            s = int(cost.argmin())
            if cost[s] < nxt[e]:
                nxt[e], frm[e] = cost[s], s
        best = nxt
        came.append(frm)
    ends, e = [], n
    for frm in reversed(came):
        if e and frm[e] >= 0:
            ends.append(int(lengths[e - 1]))
            e = int(frm[e])
    return np.array(sorted(ends)), int(best[n])


def pieces(docs: DataFrame, max_len: int, id_col: str = "doc_id", size: Column | None = None) -> DataFrame:
    """(id, piece, first, length): every text as pieces of max_len words and a last one of what is left."""
    n = word_count() if size is None else size
    cut = docs.select(F.col(id_col), n.alias("n")).filter("n > 0")
    last = F.ceil(F.col("n") / max_len).cast("int") - 1
    return cut.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).select(
        id_col, "piece", (F.col("piece").cast("long") * max_len).alias("first"), F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("piece").cast("long") * max_len).alias("length")
    )


def pack(docs: DataFrame, max_len: int = 2048, n_buckets: int = 12, token_budget: int = 32_768, shard_rows: int = 20_000, seed: int = 11, id_col: str = "doc_id", size: Column | None = None) -> DataFrame:
    """One row per piece: id, piece, first (word), length, bucket_len (its bucket's boundary), batch, slot, padding.

    batch numbers the bucket's batches from 0, slot the places of a batch; only a bucket's last batch may have free slots.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, max_len, id_col, size), "pieces")
    hist = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()  # at most max_len rows
    ends, _ = boundaries(np.array([r.length for r in hist], np.int64), np.array([r.n for r in hist], np.int64), n_buckets)
    in_bucket: dict[int, int] = {}
    for r in hist:
        end = int(ends[np.searchsorted(ends, r.length)])
        in_bucket[end] = in_bucket.get(end, 0) + r.n
    rows = [(e, max(1, token_budget // e), -(-n // shard_rows)) for e, n in in_bucket.items()]
    of = {e: i for i, e in enumerate(in_bucket)}
    lengths = [(r.length, rows[of[int(ends[np.searchsorted(ends, r.length)])]]) for r in hist]
    table = spark.createDataFrame([(x, *b) for x, b in lengths], "length long, bucket_len long, per_batch long, shards long")
    placed = cut.join(F.broadcast(table), "length").withColumn("o", F.xxhash64(F.lit(seed), id_col, "piece"))
    placed = placed.withColumn("shard", F.pmod("o", "shards"))
    before = F.sum("m").over(Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("bucket_len", "shard").agg(F.count(F.lit(1)).alias("m")).select("bucket_len", "shard", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("o", id_col, "piece", "length"))
    ranked = placed.withColumn("own", own).join(starts, ["bucket_len", "shard"]).withColumn("at", F.col("start") + F.col("own") - 1)
    return ranked.select(
        id_col, "piece", "first", "length", "bucket_len", F.floor(F.col("at") / F.col("per_batch")).alias("batch"), F.pmod("at", "per_batch").alias("slot"), (F.col("bucket_len") - F.col("length")).alias("padding")
    )
