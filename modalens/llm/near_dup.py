"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct w-word shingles as 64-bit hashes. The sketch has t coordinates filled in rounds: in
round r < t every element lands in one hashed bin, in round t + i every element lands in bin i, and a bin keeps the
smallest (round, hash) that reached it. Rounds go on until all bins are full, which the second half guarantees; every
coordinate of two sketches agrees with the probability of the sets' Jaccard similarity, with the concentration of
drawing without replacement. `bands` groups of t / bands coordinates are hashed; sets at the threshold share a band but
with probability about 1e-7 at the defaults.

Work is kept linear in the rows:
1. documents of the same words in the same order are one class under their smallest id (by SHA-256 of their words), so
   copies cost one row each;
2. in every band bucket with two classes or more, a hub is checked against all others, and the confirmed links are
   joined to components. The hub is the class with the most neighbours over all its buckets, which among copies with
   different edits is the text that they were made from;
3. pairs of one bucket that are still in different components are compared next, all of them: first by one bit of each
   coordinate, then by a longer sketch that only these classes get. Pairs inside a component can add nothing, and a
   sketch turns a pair at the threshold away with a probability below 1e-9, so no link is lost.
Every check counts the intersection of the two full sets.

Defined cases: a text without words (a null one too) has an empty set and is linked with nothing; rows that repeat a
doc_id are one document whose links are merged; rows with a null id are kept and linked with nothing; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalens.llm.common import words, written
from modalens.llm.components import components

SIZE, BANDS = 200, 40
#: Coordinates of the longer sketch that pairs across components must agree in; one bit of each is kept.
FINE = 4096
#: Elements of sets that are sketched together, each set with 1024 more.
DEALT = 1 << 21
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over an array, keyed by seed."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(elements: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """One row of t coordinates for each set; the sets' elements lie one after another. Empty sets get no values."""
    out = np.full(len(sizes) * t, _LAST)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for r in range(2 * t):
        if not len(doc):
            break
        h = mixed(elements, r + 1)
        bins = (h >> np.uint64(48)) * np.uint64(t) >> np.uint64(16) if r < t else np.uint64(r - t)
        np.minimum.at(out, doc * t + bins.astype(np.int64), np.uint64(r << 48) | (h & np.uint64((1 << 48) - 1)))
        open_ = (out.reshape(-1, t) == _LAST).any(axis=1)[doc]
        if not open_.all():
            elements, doc = elements[open_], doc[open_]
    return out.reshape(-1, t)


def least_bits(t: int, percent: int) -> float:
    """Equal bits of t below which a pair is not checked: 6.5 standard deviations under the mean at the threshold."""
    p = (1 + percent / 100) / 2
    return t * p - 6.5 * (t * p * (1 - p)) ** 0.5


def fine(sets: DataFrame) -> DataFrame:
    """(id, fine): one bit of each coordinate of a longer sketch, 64 to a number."""

    @F.pandas_udf("array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            rows = []
            for i in range(0, len(part), 256):
                own = part.iloc[i : i + 256]
                flat = np.concatenate(own.tolist()).astype(np.int64).view(np.uint64)
                s = mixed(sketches(flat, np.array([len(x) for x in own], np.int64), FINE), 4000) & np.uint64(1)
                rows += list(np.packbits(s.astype(np.uint8), axis=1).view(np.int64))
            yield pd.Series(rows, dtype=object)

    return sets.select("id", sketch("sh").alias("fine"))


def unlike(a: str, b: str):
    """In how many bits two longer sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)


def most_unlike(percent: int) -> float:
    """Differing bits above which a pair is not checked: 6.5 standard deviations over the mean at the threshold."""
    p = (1 - percent / 100) / 2
    return FINE * p + 6.5 * (FINE * p * (1 - p)) ** 0.5


def with_shingles(rows: DataFrame, w: int, name: str) -> DataFrame:
    """rows (id, text) as (id, name, whole): hashes of the distinct w-word shingles; of fewer words the whole sequence.

    `whole` is the SHA-256 of all words in their order; texts that agree in it have the same shingles.

    The words are a column of their own, so that looking one up by its place doesn't split the text again.
    """
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = rows.select("id", words(low).alias("ws")).withColumn("m", F.size("ws"))
    slices = F.transform(F.sequence(F.lit(0), F.col("m") - w), lambda i: F.xxhash64(*[F.get("ws", i + k) for k in range(w)]))
    one = F.when(F.col("m") > 0, F.array(F.xxhash64(F.array_join("ws", " ")))).otherwise(F.array().cast("array<bigint>"))
    return split.select("id", F.when(F.col("m") >= w, F.array_distinct(slices)).otherwise(one).alias(name), F.sha2(F.array_join("ws", " "), 256).alias("whole"))


def sketched(docs: DataFrame, w: int, t: int, bands: int) -> DataFrame:
    """(id, n, whole, bands, bits): set size, digest of the words, band hashes, one bit of each coordinate."""

    @F.pandas_udf("n long, bands array<long>, bits array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sets in batches:
            part = np.cumsum([len(x) + 1024 for x in sets]) // DEALT if len(sets) else np.zeros(0)  # sets of about DEALT elements together
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sets)]
            yield pd.concat([of(sets.iloc[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], ignore_index=True)

    def of(sets: pd.Series) -> pd.DataFrame:
        sizes = np.array([len(x) for x in sets], np.int64)
        flat = (np.concatenate(sets.tolist()) if sizes.sum() else np.zeros(0, np.int64)).astype(np.int64).view(np.uint64)
        s = sketches(flat, sizes, t)
        rows = t // bands
        keys = np.empty((len(sizes), bands), np.uint64)
        for b in range(bands):
            k = np.full(len(sizes), b, np.uint64)
            for c in range(b * rows, (b + 1) * rows):
                k = mixed(k ^ s[:, c], 2000)
            keys[:, b] = k
        bit = (mixed(s, 3000) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(np.pad(bit, ((0, 0), (0, -t % 64))), axis=1).view(np.int64)
        keep = sizes > 0
        return pd.DataFrame(
            {
                "n": sizes,
                "bands": [x if k else x[:0] for x, k in zip(keys.view(np.int64), keep, strict=True)],
                "bits": list(packed),
            }
        )

    return with_shingles(docs, w, "sh").select("id", "whole", sketch("sh").alias("s")).select("id", "whole", "s.*")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have percent / 100 of their union in common."""
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("sh").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sh").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return joined.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, w: int = 5, percent: int = 80, t: int = SIZE, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept (it is its component's)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sk = written(sketched(rows, w, t, bands), "sketches")
    real = sk.filter("n > 0 AND id IS NOT NULL")
    classes = written(real.groupBy("whole").agg(F.min("id").alias("node")), "classes")
    by_set = real.join(classes, "whole")  # copies of one text are split by Spark's skew join
    members = by_set.filter("id <> node").select("id", "node").distinct()
    heads = by_set.filter("id = node").select("node", "n", "bands", "bits")

    bucket = written(by_set.filter("id = node").select("node", F.explode("bands").alias("band")), "bands")
    crowd = bucket.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    crowded = bucket.join(crowd.select("band", "size"), "band")
    weight = crowded.groupBy("node").agg(F.sum("size").alias("weight"))
    crowded = written(crowded.select("band", "node").join(weight, "node"), "buckets")
    sets = written(with_shingles(rows.join(weight.select(F.col("node").alias("id")), "id"), w, "sh").drop("whole"), "sets")

    hub = crowded.groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("x")).select("band", (-F.col("x.node")).alias("hub"))
    tried = crowded.join(hub, "band").filter("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    links = written(members.select(F.col("node").alias("a"), F.col("id").alias("b")).unionAll(confirmed(tried, sets, percent)), "links")
    label = written(components(links), "components")

    placed = crowded.join(label, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    several = placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("band")
    open_ = placed.join(several, "band")
    close = open_.select(F.col("node").alias("id")).distinct().join(sets, "id")
    close = fine(close).join(heads.withColumnRenamed("node", "id"), "id").withColumnRenamed("id", "node").dropDuplicates(["node"])
    open_ = written(open_.join(close, "node"), "open-buckets")
    one, two = (open_.select("band", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "bands", "bits", "fine", "label")]) for s in "ab")
    apart = sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(-(-t // 64))), F.lit(0))
    sized = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    earlier = F.arrays_overlap(*[F.slice(f"bands_{s}", F.lit(1), F.array_position("bands_a", F.col("band")).cast("int") - 1) for s in "ab"])  # met in a bucket before
    likely = one.join(two, "band").filter((F.col("label_a") < F.col("label_b")) & sized & (t - apart >= least_bits(t, percent)) & ~earlier & (unlike("fine_a", "fine_b") <= most_unlike(percent)))
    more = confirmed(likely.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), sets, percent)
    label = components(links.unionAll(more)).withColumnRenamed("node", "id")

    out = sk.select("id", F.col("n").alias("n_shingles")).join(label, "id", "left").withColumn("component_id", F.coalesce("label", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
