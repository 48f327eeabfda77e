"""Token counts of whole texts under a byte-level BPE vocabulary.

Byte-level BPE never merges across pre-tokens, so a text has as many tokens as its pre-tokens have pieces.

1. Every text becomes its pre-token frequencies (and its number of special strings), a table that is written once.
2. The distinct pre-tokens of the corpus are one aggregation of it, combined before the shuffle; the pieces of each are
   counted once.
3. Frequencies are joined to these counts and summed by document. The COMMON most frequent pre-tokens of at most
   KEPT_CHARS characters, a table of bounded size, are broadcast, which serves nearly all rows and every hot one where
   they lie; the rest are joined by a shuffle. No ids of a text are ever made.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated rows; a null doc_id stays
null; an empty table gives no rows; other columns are ignored. Special strings inside a text are one token each, as
the tokenizer library has it by default.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalens.llm.common import matched, written

#: The pre-token pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of the broadcast table of common pre-tokens, and the longest one in it: 2^19 rows of 64 characters at most.
COMMON, KEPT_CHARS = 1 << 19, 64
#: The same pattern for the standard library's faster engine, good where its word, digit and space classes mean letters, digits and
#: white space as above: in texts without the characters of _OTHER.
_LATIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
_OTHER = re.compile("[^\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]")
_PRE: dict[str, PreTokenizer] = {}


class PreTokenizer:
    """Pre-token frequencies of a text, and the pieces of a pre-token."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.any_script = regex.compile(PRETOKEN).findall

    def split(self, text: str) -> list[str]:
        return self.any_script(text) if _OTHER.search(text) else _LATIN(text)

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies of a text and its number of special strings."""
        if self.special is None or not self.special.search(text):
            return Counter(self.split(text)), 0
        parts = self.special.split(text)
        return sum((Counter(self.split(p)) for p in parts), Counter()), len(parts) - 1

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)]


def pretokenizer(path: str) -> PreTokenizer:
    if path not in _PRE:
        _PRE[path] = PreTokenizer(path)
    return _PRE[path]


def frequencies(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_bytes, special, pre, freq): a number for the row, its special strings, its pre-tokens, how often each."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = pretokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [tok.frequencies(t) for t in part.column(2).to_pylist()]
                ends = [0]
                for freq, _ in found:
                    ends.append(ends[-1] + len(freq))
                ends = pa.array(ends, pa.int32())
                pre = pa.ListArray.from_arrays(ends, pa.array([p for freq, _ in found for p in freq], pa.string()))
                many = pa.ListArray.from_arrays(ends, pa.array([n for freq, _ in found for n in freq.values()], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for _, n in found], pa.int64()), pre, many], ["id", "n_bytes", "special", "pre", "freq"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(split, f"id {id_type}, n_bytes long, special long, pre array<string>, freq array<int>")
    return out.withColumn("row", F.monotonically_increasing_id())


def piece_counts(used: DataFrame, tokenizer_path: str) -> DataFrame:
    """(p, uses, pieces): the distinct pre-tokens of a table (p, n), each counted once."""

    @F.pandas_udf("int")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = pretokenizer(tokenizer_path)
        for pre in batches:
            yield pd.Series([n for i in range(0, len(pre), 1024) for n in tok.pieces(pre.iloc[i : i + 1024].tolist())], dtype="int32")

    return used.groupBy("p").agg(F.sum("n").alias("uses")).select("p", "uses", pieces("p").alias("pieces"))


def least_uses(counts: DataFrame, most: int) -> int:
    """A power of two that at most `most` rows of counts (p, uses) reach, from a histogram of the uses' powers."""
    rows = counts.groupBy(F.floor(F.log2("uses")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("power")).collect()  # 62 at most
    total, power = 0, 62
    for r in rows:
        total += r.m
        if total > most:
            break
        power = r.power
    return 1 << power


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", common: int | None = None) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    told = written(frequencies(docs, tokenizer_path, id_col, text_col), "frequencies")
    used = told.select("row", F.explode(F.arrays_zip("pre", "freq")).alias("x")).select("row", F.col("x.pre").alias("p"), F.col("x.freq").alias("n"))
    counts = written(piece_counts(used, tokenizer_path), "piece-counts")
    kept = counts.filter(F.length("p") <= KEPT_CHARS)
    short = written(kept.filter(F.col("uses") >= least_uses(kept, COMMON if common is None else common)).select("p", "pieces"), "common")
    rare = counts.join(F.broadcast(short.select("p")), "p", "left_anti")
    sums = used.join(F.broadcast(short), "p").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("n"))
    if not rare.isEmpty():
        left = matched(used.join(F.broadcast(short.select("p")), "p", "left_anti"), rare, ["p"], n="uses")
        sums = sums.unionAll(left.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("n"))).groupBy("row").agg(F.sum("n").alias("n"))
    n = F.col("special") + F.coalesce("n", F.lit(0))
    out = told.select("row", "id", "n_bytes", "special").join(sums, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
