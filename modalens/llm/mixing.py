"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is its share of the budget by weight, at most `max_repeats` times its size; what the cap takes away
is shared again by weight among the others. Every document is taken floor(target / size) times; for the rest of the
target, documents are counted by exact size, and a bounded-knapsack dynamic programme over these counts finds the
largest sum that doesn't exceed it. Which documents of a size class are taken follows a seeded hash of their ids, so
reruns agree.

Data flow: one scan for sizes, one aggregation to (source, size, count), a table of sources, one task per source for
the programme over that source's distinct sizes (never over its documents), and one ranking of documents inside
(source, size, shard): a class that holds a third of all rows is split into shards whose counts give the offsets.

Defined cases: null text has size 0 and is never taken; a null source is a source, last in order; rows that repeat an
id are documents of their own and tie by content; an empty table gives no rows; a source of size 0 has target 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalens.llm.common import free_name, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARD_ROWS = 50_000
#: Words of the rest that the programme starts with; it grows until the best sum is certain.
WINDOW = 1 << 17


def capped_targets(sizes: np.ndarray, weights: np.ndarray, budget: float, max_repeats: float) -> np.ndarray:
    """Shares of the budget by weight, none above max_repeats times its size; the excess is reshared until none is above."""
    cap = sizes * max_repeats
    targets, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = budget
    while open_.any():
        share = np.where(open_, left * weights / weights[open_].sum(), 0)
        above = open_ & (share > cap)
        if not above.any():
            targets[open_] = share[open_]
            break
        targets[above] = cap[above]
        left -= cap[above].sum()
        open_ &= ~above
    return targets


def fit(sizes: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray:
    """How many documents of each size to take, at most `counts` of each, for the largest sum that doesn't exceed `rest`.

    The programme runs on a window of the rest: what lies above it is first filled by the same fraction of every size
    and whole documents, largest first. A sum that meets the rest can't be bettered. Where the window's doesn't, it grows
    fourfold and the programme starts anew, in the end on the whole rest, so the sum is always the best one. Sums are
    counted in units of the sizes' common divisor.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    some = (counts > 0) & (sizes > 0)
    total = int((sizes[some] * counts[some]).sum())
    if rest <= 0 or total == 0:
        return np.zeros(len(sizes), np.int64)
    if rest >= total:
        return np.where(some, counts, 0)
    unit = int(np.gcd.reduce(sizes[some]))
    s, c, goal = np.where(some, sizes // unit, 1), np.where(some, counts, 0), rest // unit
    window = WINDOW
    while True:
        bulk, left = _bulk(s, c, goal, window)
        take = bulk + knapsack(s, c - bulk, left)
        if left == goal or int((s * take).sum()) == goal:
            return take
        window *= 4


def _bulk(sizes: np.ndarray, counts: np.ndarray, goal: int, window: int) -> tuple[np.ndarray, int]:
    """Documents taken before the programme, and what is left of the goal: the window, or little less."""
    if goal <= window:
        return np.zeros(len(sizes), np.int64), goal
    take = (counts * ((goal - window) / int((sizes * counts).sum()))).astype(np.int64)
    left = goal - int((sizes * take).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if left > window:
            more = min(int(counts[i] - take[i]), (left - window) // int(sizes[i]))
            take[i] += more
            left -= more * int(sizes[i])
    return take, left


def knapsack(sizes: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray:
    """Bounded-knapsack programme: the counts whose words reach the largest reachable sum up to `rest`.

    Every size is split into bundles of 1, 2, 4, ... documents. Each sum remembers the first bundle that reached it: what
    that bundle was added to was reached by earlier ones, so the way back takes no bundle twice. Bundles stop once `rest`
    itself is reached. Memory is five bytes for each word of the rest.
    """
    first = np.full(rest + 1, -1, np.int32)
    reached = np.zeros(rest + 1, bool)
    reached[0], bundles = True, []
    for i in np.argsort(sizes, kind="stable"):
        left, bundle, size = min(int(counts[i]), rest // int(sizes[i])), 1, int(sizes[i])
        while left > 0 and not reached[rest]:
            b = min(bundle, left)
            new = np.flatnonzero(reached[: rest + 1 - b * size] & ~reached[b * size :]) + b * size
            first[new] = len(bundles)
            reached[new] = True
            bundles.append((i, b, b * size))
            left, bundle = left - b, bundle * 2
    take, at = np.zeros(len(sizes), np.int64), int(np.flatnonzero(reached)[-1])
    while at:
        i, b, words_ = bundles[first[at]]
        take[i] += b
        at -= words_
    return take


def source_targets(sized: DataFrame, budget_share: float, max_repeats: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size, target), one row per source. The table of sources is one task's work, the documents are not."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))

    def targets(pdf: pd.DataFrame) -> pd.DataFrame:
        named = pdf[pdf.source.notna()].sort_values("source", key=lambda s: s.map(lambda x: x.encode("utf-32-be")))
        pdf = pd.concat([named, pdf[pdf.source.isna()]], ignore_index=True)
        w = np.array([weights[i % len(weights)] for i in range(len(pdf))])
        size = pdf.source_size.to_numpy("float64")
        pdf["target"] = capped_targets(size, w, budget_share * size.sum(), max_repeats)
        return pdf[["source", "source_size", "target"]]

    return per.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(targets, "source string, source_size long, target double")


def mix(
    docs: DataFrame,
    seed: int = 7,
    budget_share: float = 1.5,
    max_repeats: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS,
    id_col: str = "doc_id",
    size: Column | None = None,
    key: Column | None = None,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target (its source's), taken (words, repeats counted).

    The choice follows a seeded hash of `key`, which is the id where none is given.
    """
    size = word_count() if size is None else size
    key = F.col(id_col) if key is None else key
    order = F.xxhash64(F.lit(seed), key, F.col("source"))
    sized = written(docs.select(F.col(id_col).alias("id"), "source", size.alias("size"), key.alias("key"), order.alias("o")), "sizes")
    hist = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    per_source = written(source_targets(hist.select("source", (F.col("size") * F.col("n")).alias("size")), budget_share, max_repeats, weights), "targets")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["size"] > 0].sort_values("size", ignore_index=True)
        if not len(pdf):
            return pdf.assign(base=0, extra=0)[["source", "size", "base", "extra"]]
        s, n = pdf["size"].to_numpy("int64"), pdf["n"].to_numpy("int64")
        base, total = int(pdf.target[0] // pdf.source_size[0]), int(pdf.source_size[0])
        extra = fit(s, n, int(round(pdf.target[0])) - base * total)
        return pd.DataFrame({"source": pdf.source, "size": s, "base": base, "extra": extra})

    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    plan = hist.alias("h").join(per_source.alias("t"), same("h", "t")).select("h.*", "t.source_size", "t.target")
    taken = written(plan.groupBy("source").applyInPandas(choose, "source string, size long, base long, extra long"), "takes")
    return _select(sized, hist, per_source, taken).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * (F.col("base") + F.col("more"))).alias("taken")
    )


def _select(sized: DataFrame, hist: DataFrame, per_source: DataFrame, taken: DataFrame) -> DataFrame:
    """Documents with base and more (0 or 1): `extra` documents of each (source, size), first in seeded order."""
    shards = hist.select("source", "size", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards"))
    classes = shards.alias("h").join(
        taken.alias("k"), F.col("h.source").eqNullSafe(F.col("k.source")) & (F.col("h.size") == F.col("k.size")), "left"
    ).select("h.source", "h.size", "h.shards", F.coalesce("k.base", F.lit(0)).alias("base"), F.coalesce("k.extra", F.lit(0)).alias("extra"))
    rows = sized.alias("d").join(
        classes.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size"))
    ).select("d.*", "c.base", "c.extra", F.pmod("d.o", "c.shards").alias("shard"))
    key = ["source", "size", "shard"]
    starts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("source", "size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(*key, F.coalesce(before, F.lit(0)).alias("start"))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("o", "key", "id")))
    on = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.size") == F.col("s.size")) & (F.col("r.shard") == F.col("s.shard"))
    placed = ranked.alias("r").join(starts.alias("s"), on).select("r.*", (F.col("r.rn") + F.col("s.start") <= F.col("r.extra")).cast("long").alias("more"))
    return placed.alias("p").join(per_source.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "t.source_size", "t.target")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix with their own columns, one row for each time that a document is taken.

    The choice follows the id and a hash of the whole row; the number of a row only joins it to its choice. Rows that
    agree in both are the same in every column, so it doesn't matter which of them is taken.
    """
    columns, row = docs.columns, free_name(docs, "mix_row")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(*columns).alias("content"))
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-input")
    times = F.expr("transform(sequence(1, int(taken div size)), i -> i)").alias(free_name(docs, "mix_times"))
    chosen = mix(numbered, id_col=row, key=key, **options).filter("taken > 0").select(row, times)
    return numbered.join(chosen, row).select(*columns, F.explode(free_name(docs, "mix_times")).alias(free_name(docs, "mix_copy"))).select(*columns)
