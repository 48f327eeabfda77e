"""Near-duplicates by SimHash: fingerprints, and pairs of close ones through vantage-point trees.

A fingerprint bit is 1 if it is set in over half of the 64-bit hashes of the text's word shingles, repeats included.
Equal fingerprints are one class, so copies cost one row. A tree splits the space of fingerprints by their Hamming
distance to vantage points: those at most `mu` away go left, the others right, and by the triangle inequality the
partners of a fingerprint on the right can be on the left only if it is at most mu + radius away. So whatever lies in
that margin goes to both sides, and any two fingerprints within the radius meet in at least one shard. The margin is
thin, so a level halves the shards while the rows grow by about a fifth.

The tree's vantage points come from a bounded sample of the classes (SAMPLE at most, and no more than one in sixteen);
the sample only shapes the tree, every class is routed through it. A shard is one group of Spark's: it is split further
by a tree of its own down to blocks that are compared whole. A block doesn't give its pairs, but an edge from each of
its linked classes to the smallest one in reach, so that a dense cluster costs a row per class, and no link is lost.

Defined cases: a text without words (a null one too) has the fingerprint zero and is linked like any other; rows that
repeat a doc_id are documents of their own, each in the component of its own text; rows with a null id are kept, linked
with nothing and their component is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalens.llm.common import matched, written
from modalens.llm.components import components

WORDS, RADIUS, SEED = 3, 2, 42
#: Largest sample that shapes the tree, rows that a shard is meant to have, classes that are compared whole.
SAMPLE, SHARD, BLOCK = 1 << 18, 4096, 512
#: Sampled classes without which a shard isn't split further: fewer say too little about where its middle is.
LEAST = 32
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 16


def fingerprint(text: bytes, w: int = WORDS) -> int:
    """The fingerprint of a text, unsigned. bytes.split() cuts at just the six characters that end a word."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    whole, n = b" ".join(words), max(1, len(words) - w + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    stops = ends[min(w, len(words)) - 1 :] - 1
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        pieces = zip(starts[i : min(n, i + _CHUNK)].tolist(), stops[i : i + _CHUNK].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in pieces], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, w: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): a row's id and the fingerprint of its text as a signed number."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series(np.array([fingerprint(x, w) for x in part], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), of(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("fp"))


def distances(fps: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ v).astype(np.int16)


def split(fps: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage point and distance that leave the smallest larger side; None if no split takes a tenth away.

    Candidates are three of the fingerprints themselves, taken evenly from the array.
    """
    best = (0.9 * len(fps), None)
    for v in fps[:: max(1, len(fps) // 3)][:3]:
        upto = np.cumsum(np.bincount(distances(fps, v), minlength=65 + radius))
        larger = np.maximum(upto[radius : 65 + radius], len(fps) - upto[:65])
        mu = int(larger.argmin())
        best = min(best, (float(larger[mu]), (v, mu)), key=lambda x: x[0])
    return best[1]


class Tree:
    """A vantage-point tree: for each inner node its point, distance and children; a child below zero is shard -child - 1."""

    def __init__(self, sample: np.ndarray, scale: float, radius: int):
        """scale: how many fingerprints one of the sample stands for."""
        self.radius, self.shards = radius, 0
        self.point, self.mu, self.child = [], [], []
        self.root = self._grown(sample, scale)

    def _grown(self, part: np.ndarray, scale: float) -> int:
        found = split(part, self.radius) if len(part) * scale > SHARD and len(part) >= LEAST else None
        if found is None:
            self.shards += 1
            return -self.shards
        k = len(self.point)
        self.point.append(found[0])
        self.mu.append(found[1])
        self.child.append(None)
        left, right = sides(part, *found, self.radius)
        self.child[k] = (self._grown(part[left], scale), self._grown(part[right], scale))
        return k

    def routed(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) for every shard that a fingerprint belongs to, its own and those across whose boundary it is near."""
        rows, shards, todo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(self.root, np.arange(len(fps)))]
        while todo:
            k, at = todo.pop()
            if k < 0:
                rows.append(at)
                shards.append(np.full(len(at), -k - 1))
            elif len(at):
                todo += [(c, at[side]) for c, side in zip(self.child[k], sides(fps[at], self.point[k], self.mu[k], self.radius), strict=True)]
        return np.concatenate(rows), np.concatenate(shards)


def sides(fps: np.ndarray, v: np.uint64, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Who goes left, with the margin that may have partners there, and who goes right."""
    d = distances(fps, v)
    return d <= mu + radius, d > mu


def linked(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) edges, block by block, that connect the same fingerprints as all pairs within the radius do."""
    todo = [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        found = split(fps[at], radius) if len(at) > BLOCK else None
        if found is not None:
            todo += [at[side] for side in sides(fps[at], *found, radius)]
            continue
        for i in range(0, len(at), BLOCK):  # more than one step only where nothing splits the fingerprints
            for j in range(0, i + 1, BLOCK):
                a, b = at[i : i + BLOCK], at[j : j + BLOCK]
                near = np.bitwise_count(fps[a][:, None] ^ fps[b][None, :]) <= radius
                if i == j:
                    yield from _stars(near, a)
                else:
                    x, y = np.nonzero(near)
                    yield a[x], b[y]


def _stars(near: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges from the members of each component of a symmetric matrix to its first member."""
    some = np.flatnonzero(near.sum(axis=1) > 1)
    if not len(some):
        return
    near, label = near[np.ix_(some, some)], np.arange(len(some))
    while True:
        new = np.where(near, label[None, :], len(some)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(some))
    yield at[some[other]], at[some[label[other]]]


def simhash_duplicates(docs: DataFrame, w: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable)."""
    rows = written(fingerprints(docs, w, id_col, text_col), "fingerprints")
    classes = written(rows.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "classes")
    count = classes.count()
    share = min(1 / 16, SAMPLE / max(1, count))
    picked = classes.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").toPandas()
    tree = Tree(np.sort(picked.fp.to_numpy(np.int64)).view(np.uint64), 1 / share, radius)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            at, shard = tree.routed(part.fp.to_numpy(np.int64).view(np.uint64))
            yield part.iloc[at].assign(shard=shard)

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        nodes = part.node.to_numpy()
        edges = [(nodes[a], nodes[b]) for a, b in linked(part.fp.to_numpy(np.int64).view(np.uint64), radius)]
        a, b = (np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, np.int64) for k in (0, 1))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    placed = classes.select("fp", "node").mapInPandas(route, "fp long, node long, shard long")
    label = components(written(placed.groupBy("shard").applyInPandas(meet, "a long, b long"), "links"))
    named = classes.join(label, "node", "left").select("fp", "n", F.coalesce("label", "node").alias("component_id"))
    found = matched(rows.filter("id IS NOT NULL"), written(named, "labels"), ["fp"]).select("id", "fp", "component_id")
    out = found.unionByName(rows.filter("id IS NULL").withColumn("component_id", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
