"""Language identification by prediction by partial matching.

For every language a variable-order byte context tree is learned and frozen. A context that was seen N times with d
different next bytes codes a byte that followed it n times with log2((N + d) / n) bits and an escape to the next
shorter context with log2((N + d) / d) bits; below order 0 every byte costs 8 bits. A context that was never seen
costs nothing to leave. The code length of a text under a language is the sum over all its bytes, and the language with
the shortest one is the prediction. Frozen statistics make the cost of a byte a function of the context alone, so for
every (context, byte) that any language knows the whole chain of escapes is worked out once, into one table with a
column per language: scoring looks up the longest known context of each byte and adds rows.

Learning takes a bounded sample of labelled documents (`per_language` of each language, by a hash of their ids, none
longer than `max_bytes`); everything else covers whole texts of all rows. The model's size is bounded by the sample's.

Defined cases: a null text, or one without a letter, is `und` with score 0; null languages are never learned from; with
nothing to learn from every document is `und`; repeated rows give repeated rows; an empty table gives no rows; other
columns are ignored; equal code lengths go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
ORDER = 4
#: A letter by its category: fractions, raised digits, Roman and circled numbers are none.
_LETTER = regex.compile(r"\p{L}")
#: Characters of the texts that are worked at a time, and texts.
_BATCH_CHARS, _BATCH = 1 << 22, 512
_CHUNK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """A frozen open-addressed hash table from 64-bit keys to row numbers, looked up a whole array at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)  # 0: free; no key is 0
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self.slot(keys)
        while len(left):
            free = self.keys[slot] == 0
            at, first = np.unique(slot[free], return_index=True)
            won = left[free][first]
            self.keys[at], self.rows[at] = keys[won], won
            stay = self.rows[slot] != left
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for an unknown one."""
        slot = self.slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.rows[slot], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.rows[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as one byte array, each after ORDER line feeds, and where each begins (with a last end)."""
    blobs = [b"\n" * ORDER + t.lower().encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([0, *map(len, blobs)])
    return np.frombuffer(b"".join(blobs), np.uint8), ends


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """For each byte from number ORDER on, the last k bytes up to it as a key; keys of different k differ."""
    key = np.full(len(data) - ORDER, k + 1, np.uint64)
    for i in range(k):
        key = (key << np.uint64(8)) | data[ORDER - k + 1 + i : len(data) - k + 1 + i]
    return key


class Model:
    """`langs`; for each k, a table of the k-grams that any language knows and their bits by language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        counts = [self.counted(samples[x]) for x in self.langs]
        self.grams, self.escapes = {}, {}
        if not counts:
            return
        shorter, below = None, np.full((1, len(self.langs)), 8.0)
        for k in range(1, ORDER + 2):
            keys = np.unique(np.concatenate([c[k][0] for c in counts]))
            ctxs = np.unique(np.concatenate([self.context(c[k][0], k) for c in counts]))
            cost, escape = np.zeros((len(keys), len(self.langs))), np.zeros((len(ctxs), len(self.langs)))
            of = np.searchsorted(ctxs, self.context(keys, k))
            if shorter is not None:
                below = shorter[np.searchsorted(known, self.suffix(keys, k))]
            for j, c in enumerate(counts):
                own, n = c[k]
                at = np.searchsorted(ctxs, self.context(own, k))
                total, different = np.bincount(at, n, len(ctxs)), np.bincount(at, minlength=len(ctxs))
                seen = different > 0
                escape[seen, j] = np.log2((total[seen] + different[seen]) / different[seen])
                cost[:, j] = escape[of, j] + (below[:, j] if shorter is not None else 8.0)
                rows = np.searchsorted(keys, own)
                cost[rows, j] = np.log2((total[at] + different[at]) / n)
            none = np.zeros((1, len(self.langs)))
            self.grams[k] = (Table(keys), np.concatenate([cost, none]).astype(np.float32))
            self.escapes[k] = (Table(ctxs), np.concatenate([escape, none]).astype(np.float32))
            shorter, known = cost, keys

    @staticmethod
    def context(keys: np.ndarray, k: int) -> np.ndarray:
        return keys >> np.uint64(8)

    @staticmethod
    def suffix(keys: np.ndarray, k: int) -> np.ndarray:
        """The key of the last k - 1 bytes."""
        return (keys & np.uint64((1 << 8 * (k - 1)) - 1)) | np.uint64(k << 8 * (k - 1))

    @staticmethod
    def counted(texts: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        data, ends = encode(texts)
        scored = np.ones(len(data), bool)
        for i in range(ORDER):
            scored[ends[:-1] + i] = False
        return {k: np.unique(grams(data, k)[scored[ORDER:]], return_counts=True) for k in range(1, ORDER + 2)}

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code length of each byte from number ORDER on, by language."""
        key = grams(data, ORDER + 1)
        row = self.grams[ORDER + 1][0].find(key)
        out = self.grams[ORDER + 1][1][row]  # the last row is all zeros and stands for unknown
        left = np.flatnonzero(row < 0)
        key = key[left]
        for k in range(ORDER, -1, -1):
            table, escape = self.escapes[k + 1]
            bits = escape[table.find(key >> np.uint64(8))]
            if k:
                key = self.suffix(key, k + 1)
                table, cost = self.grams[k]
                row = table.find(key)
                bits += cost[row]
            else:
                bits += np.float32(8)
            out[left] += bits
            if not k or not (row < 0).any():
                break
            left, key = left[row < 0], key[row < 0]
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not self.langs or not todo:
            return out
        data, ends = encode([texts[i] for i in todo])
        total = np.zeros((len(todo), len(self.langs)))
        for lo in range(ORDER, len(data), _CHUNK):
            hi = min(lo + _CHUNK, len(data))
            bits = self.bits(data[lo - ORDER : hi])
            first = int(np.searchsorted(ends, lo, "right")) - 1
            last = int(np.searchsorted(ends, hi, "left"))
            for x in ends[first:last]:  # the line feeds before a text are context only
                bits[max(0, x - lo) : max(0, x + ORDER - lo)] = 0
            cuts = np.maximum(ends[first:last] - lo, 0)
            total[first:last] += np.add.reduceat(bits, cuts, axis=0)
        best = total.argmin(axis=1)
        share = 1 / np.exp2(np.minimum(1000, total - total.min(axis=1, keepdims=True)) * -1).sum(axis=1)
        for i, b, s in zip(todo, best, share, strict=True):
            out[i] = (self.langs[b], float(s))
        return out


def held_out(id_col: str = "doc_id", folds: int = 5):
    return F.crc32(F.col(id_col).cast("string")) % folds == 0


def sample(docs: DataFrame, per_language: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Texts to learn from: at most per_language of each language, the first by a hash of their ids.

    The choice is made on ids alone, in shards first, so no task holds a language; then the chosen texts are fetched.
    """
    fit = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col) & (F.octet_length(text_col) <= max_bytes))
    fit = fit.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    ids = fit.select("id", "lang", "t", F.xxhash64("id").alias("o"))
    ids = ids.withColumn("shard", F.pmod("o", F.lit(32)))
    for keys in (["lang", "shard"], ["lang"]):
        ids = ids.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("o", "id", "t"))).filter(F.col("rn") <= per_language)
    chosen = F.broadcast(ids.select("id", "lang", "t").distinct())  # per_language rows a language at most
    out: dict[str, list[str]] = {}
    for r in fit.join(chosen, ["id", "lang", "t"]).select("lang", "id", "text").distinct().collect():
        out.setdefault(r.lang, []).append(r.text)
    return {k: sorted(v) for k, v in out.items()}


def predicted(docs: DataFrame, model: Model, text_col: str = "text", name: str = "prediction") -> DataFrame:
    """docs with a column `name` of `lang_pred` and `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows, at, all_ = [], 0, texts.tolist()
            while at < len(all_):
                end, chars = at, 0
                while end < len(all_) and end - at < _BATCH and (end == at or chars + len(all_[end] or "") <= _BATCH_CHARS):
                    chars += len(all_[end] or "")
                    end += 1
                rows += shared.value.predict(all_[at:end])
                at = end
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return docs.withColumn(name, predict(F.col(text_col)))


def language(docs: DataFrame, per_language: int = 200, max_bytes: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (the share of the prediction among all languages)."""
    model = Model(sample(docs, per_language, max_bytes, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("_text"))
    return predicted(rows, model, "_text").select(id_col, "held_out", "prediction.lang_pred", "prediction.score")
