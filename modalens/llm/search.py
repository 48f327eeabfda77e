"""Ranked lexical search by dense blocked matrix products: the best documents for each of a set of items.

A document's impact for a term is a whole number below 10^6 that saturates with the term's occurrences and falls with
the document's length; an item's score for it is the sum of its terms' weights times the impacts.

1. Documents become rows (id, length, terms, occurrences) over the vocabulary of a block of items, written once.
2. The number of documents, their length and the documents of each term come from that table by aggregations.
3. Each task takes documents in tiles and multiplies a tile's impacts by the items' weights, both dense in float64 over
   the compact vocabulary of a tile of items. A vocabulary is cut wherever an item's weights could bring a partial sum
   to 2^53, so every product is exact; tiles are added in 64-bit integers.
4. A task keeps the k best documents of each item so far, ties by the smaller id, and looks only at scores that reach
   the k-th; the tasks' best are ranked by window, first inside salts, then for the item.

Items are a stated query set, worked in blocks of about BLOCK_ROWS (item, term) rows; every block meets all documents.
What the driver and each task hold of a block is bounded by that and by the block's longest item.

Defined cases: null and empty texts have no terms and don't count; rows with a null id aren't documents or items; rows
that repeat a doc_id are documents of their own; rows that repeat an item_id are one item with the terms of all; an
item without known terms gives no rows, nor does an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalens.llm.common import written

#: (item, term) rows of a block of items; items and terms of a tile; documents of a tile.
BLOCK_ROWS, TILE_ITEMS, TILE_TERMS, TILE_DOCS = 1 << 18, 128, 4096, 512
#: Scores are ranked within so many salts of an item first.
SALTS = 32
#: No impact reaches this.
IMPACT = 1_000_000
LIMIT = (1 << 53) // IMPACT
#: Letters and digits stay, capitals in lower case, other ASCII characters part terms; no byte of another character is touched.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_TERM).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, uses): an item's terms, repeats counted."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for i, text in zip(part.item, part.text, strict=True):
                c = Counter(terms(text))
                yield pd.DataFrame({"item": i, "term": list(c), "uses": list(c.values())})

    rows = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInPandas(of, "item long, term binary, uses long").groupBy("item", "term").agg(F.sum("uses").alias("uses"))


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, tf): length in terms, known terms by number and their occurrences, for documents that have a term."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for i in range(0, len(part), 1024):
                out = []
                for doc, text in zip(part.id[i : i + 1024], part.text[i : i + 1024], strict=True):
                    if all_ := terms(text):
                        known = [(vocabulary[t], n) for t, n in Counter(all_).items() if t in vocabulary]
                        out.append((doc, len(all_), np.array([k for k, _ in known], np.int32), np.array([n for _, n in known], np.int32)))
                yield pd.DataFrame(out, columns=["id", "n", "terms", "tf"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInPandas(of, "id long, n long, terms array<int>, tf array<int>")


def tiles(item: np.ndarray, term: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Tiles of items, each with the (terms, dense weights) that its vocabulary is cut into.

    item, term, weight are rows of a sparse table, with items numbered from 0. No cut lets an item's weights sum to
    LIMIT; a weight that alone reaches it is spread over columns of its own.
    """
    out = []
    for first in range(0, int(item.max(initial=-1)) + 1, TILE_ITEMS):
        own = (item >= first) & (item < first + TILE_ITEMS)
        names = np.unique(item[own])
        parts, i, t, w = [], np.searchsorted(names, item[own]), term[own], weight[own]
        while len(t):
            columns = np.unique(t)
            for c in range(0, len(columns), TILE_TERMS):
                cut = columns[c : c + TILE_TERMS]
                inside = np.isin(t, cut)
                dense = np.zeros((len(cut), len(names)), np.int64)
                dense[np.searchsorted(cut, t[inside]), i[inside]] = np.minimum(w[inside], LIMIT - 1)
                start = 0
                while start < len(cut):
                    stop = start + max(1, int((np.cumsum(dense[start:], axis=0).max(axis=1) < LIMIT).sum()))
                    parts.append((cut[start:stop], dense[start:stop].astype(np.float64)))
                    start = stop
            w = w - (LIMIT - 1)
            i, t, w = i[w > 0], t[w > 0], w[w > 0]
        if parts:
            out.append((names, parts))
    return out


def damping(n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What a document of n terms adds below the fraction of its impacts; worked in whole numbers of any size."""
    return np.array([8 * (25 + 75 * x * docs // length) for x in n.tolist()], np.int64)


class Best:
    """The k best (score, id) of each item so far, ties by the smaller id."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, names: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each document of the tile, a column for each of the named items."""
        doc, col = np.nonzero(scores >= self.least[names])
        if not len(doc):
            return
        item, score, i = (np.concatenate(x) for x in ((self.item, names[col]), (self.score, scores[doc, col]), (self.id, ids[doc])))
        order = np.lexsort((i, -score, item))
        item, score, i = item[order], score[order], i[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        self.item, self.score, self.id = item[keep], score[keep], i[keep]
        last = place == self.k - 1
        self.least[item[last]] = score[last]


def tile_best(table: DataFrame, item: np.ndarray, term: np.ndarray, weight: np.ndarray, vocabulary: int, docs: int, length: int, k: int) -> DataFrame:
    """(number, id, score): each task's best k documents of every item."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts, best = tiles(item, term, weight), Best(int(item.max(initial=-1)) + 1, k)
        column = np.full(vocabulary, -1, np.int64)
        for part in batches:
            for i in range(0, len(part), TILE_DOCS):
                tile = part.iloc[i : i + TILE_DOCS]
                size = np.array([len(x) for x in tile.terms], np.int64)
                if not size.sum():
                    continue
                row, t, tf = np.repeat(np.arange(len(tile)), size), np.concatenate(tile.terms.tolist()), np.concatenate(tile.tf.tolist()).astype(np.int64)
                damp = np.repeat(damping(tile.n.to_numpy(np.int64), docs, length), size)
                value, ids = (1_000_000_000 * tf // (1000 * tf + damp)).astype(np.float64), tile.id.to_numpy(np.int64)
                for names, parts in cuts:
                    total = np.zeros((len(tile), len(names)), np.int64)
                    for cut, dense in parts:
                        column[cut] = np.arange(len(cut))
                        at = column[t]
                        column[cut] = -1
                        some = at >= 0
                        here = np.unique(at[some])  # only what both tiles have is multiplied
                        impact = np.zeros((len(tile), len(here)))
                        impact[row[some], np.searchsorted(here, at[some])] = value[some]
                        total += (impact @ dense[here]).astype(np.int64)
                    best.add(names, total, ids)
        yield pd.DataFrame({"number": best.item, "id": best.id, "score": best.score})

    return table.select("id", "n", "terms", "tf").mapInPandas(of, "number long, id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank, by salts first so that no task gets all of an item's."""
    order = [F.desc("score"), F.asc("id")]
    salted = Window.partitionBy("item", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= k).drop("rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    wanted = written(item_terms(items, item_col, item_text), "item-terms")
    blocks = -(-wanted.count() // BLOCK_ROWS)
    out = None
    for b in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toPandas()
        if not len(rows):
            continue
        names, item = np.unique(rows.item.to_numpy(np.int64), return_inverse=True)
        known = {t: i for i, t in enumerate(sorted(set(map(bytes, rows.term))))}
        term = np.array([known[bytes(t)] for t in rows.term], np.int64)
        table = written(term_counts(docs, known, id_col, text_col), "term-counts")
        n, length = table.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n:
            break
        df = np.zeros(len(known), np.int64)
        seen = table.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()  # a row for each term of the block
        df[seen["term"].to_numpy(np.int64)] = seen["count"].to_numpy(np.int64)
        w = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)[term] * rows.uses.to_numpy(np.int64)
        use = (df[term] > 0) & (w > 0)
        numbers = spark.createDataFrame(pd.DataFrame({"number": np.arange(len(names)), "item": names}))
        best = tile_best(table, item[use], term[use], w[use], len(known), n, length, k).join(F.broadcast(numbers), "number")  # a row for each item of the block
        part = written(ranked(best.select("item", "id", "score"), k), "best")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "item long, id long, score long, rank int")
    return out.select(F.col("item").alias(item_col), F.col("rank").cast("int"), F.col("id").alias(id_col), "score")
