"""Uncertainty by resampling. All draws are hashes of (seed, replicate, draw), so they don't depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalens.functions.rank import numbered
from modalens.operators.metrics import auroc
from modalens.storage import written


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0**-53)


def group_weights(groups: DataFrame, reps: int, seed: int = 17, group: str = "group_id") -> DataFrame:
    """(rep, group, w): how often each replicate draws each group when it draws as many groups as there are."""
    ids = groups.select(group).distinct()
    placed = numbered(ids, group)
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    draws = placed.join(F.broadcast(n)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    draws = draws.select("rep", F.floor(uniform(F.lit(seed), "rep", "ix") * F.col("n")).cast("int").alias("ix"))
    return draws.groupBy("rep", "ix").agg(F.count(F.lit(1)).alias("w")).join(placed, "ix").select("rep", group, "w")


def percentile_interval(values: DataFrame, keys: list[str], value: str, level: float = 0.95, least: int = 20) -> DataFrame:
    """Per key: percentile interval over replicates; null with fewer than `least` usable ones."""
    a = (1 - level) / 2
    out = values.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("usable"), F.percentile(value, F.lit(a)).alias("_lo"), F.percentile(value, F.lit(1 - a)).alias("_hi")
    )
    ok = F.col("usable") >= least
    return out.select(*keys, "usable", F.when(ok, F.col("_lo")).alias("ci_low"), F.when(ok, F.col("_hi")).alias("ci_high"))


class Draws(NamedTuple):
    """How often replicates take units: what tells a unit's draws apart, and a byte for each of these numbers and replicates lo to hi.

    Tasks work the counts out where they need them, so no row takes its replicates through a shuffle, and slice by slice, so
    none holds its rows' replicates.
    """

    of: Callable[[DataFrame], DataFrame]
    times: Callable[[np.ndarray, int, int], Taken]


class Taken:
    """Counts of units, made for those that a slice asks for."""

    def __init__(self, counts: Callable[[np.ndarray], np.ndarray], u: np.ndarray):
        self.counts, self.u = counts, u

    def __getitem__(self, at: slice) -> np.ndarray:
        return self.counts(self.u[at])


#: Replicates whose counts a task holds at a time, rows that it goes through at a time, and blocks of units.
REPS, ROWS, BLOCKS = 125, 1024, 32
#: Rows of all keys that a range of scores has about.
RANGE_ROWS = 1 << 21


def _hashed(h: np.ndarray, value: np.ndarray, wide: bool = False) -> np.ndarray:
    """XXH64 of 32-bit (wide: 64-bit) numbers from the seed h. `xxhash64` of several columns has each one's hash as the next one's seed."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    v = np.asarray(value).astype(np.int64).view(np.uint64)
    if wide:
        h = turned((h + five + np.uint64(8)) ^ (turned(v * two, 31) * one), 27) * one + four
    else:
        h = turned((h + five + np.uint64(4)) ^ ((v & np.uint64(0xFFFFFFFF)) * one), 23) * two + three
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return h ^ (h >> np.uint64(32))


def drawn_counts(before: list[int], n: int, after: list[tuple[int, bool]] = (), wide: bool = False) -> np.ndarray:
    """How often each of n numbers is drawn, draw i being n times `uniform(*before, i, *after)`; wide numbers are longs."""
    h = np.full(1, 42, np.uint64)
    for key in before:
        h = _hashed(h, np.full(1, key))
    drawn = np.empty(n, np.int64)
    for lo in range(0, n, 1 << 13):
        own = _hashed(h, np.arange(lo, min(n, lo + (1 << 13))), wide)
        for key, long in after:
            own = _hashed(own, np.full(1, key), long)
        drawn[lo : lo + (1 << 13)] = (own >> np.uint64(11)) * 2.0**-53 * n
    return np.bincount(drawn, minlength=n)


def group_vectors(groups: DataFrame, reps: int, seed: int, group: str) -> Draws:
    """The draws of `group_weights`: a group's number stands for it."""
    placed = written(numbered(groups.select(group).distinct(), group), "group-places")
    n = placed.count()

    def times(u: np.ndarray, lo: int, hi: int) -> Taken:
        w = np.empty((n, hi - lo), np.uint8)
        for rep in range(lo, hi):
            w[:, rep - lo] = drawn_counts([seed, rep], n)
        return Taken(w.__getitem__, u)

    return Draws(lambda rows: rows.join(placed.withColumnRenamed("ix", "_u"), group), times)


def auroc_replicates(pred: DataFrame, draws: Draws, keys: list[str], reps: int, group: str = "group_id", ranges: int = 32) -> DataFrame:
    """(keys, rep, auroc): rows are summed to (group, score, truth); each task works out its groups' counts in all replicates.

    Scores are cut into ranges once, `ranges` of them or one for each RANGE_ROWS rows. A task goes through its range in
    order of score with running sums of some replicates at a time; what lies in lower ranges is added afterwards, from one
    vector per range.
    """
    ranges = max(ranges, -(-pred.count() // RANGE_ROWS))
    edges = sorted(set(pred.approxQuantile("score", [i / ranges for i in range(1, ranges)], min(0.001, 0.1 / ranges))))
    at = sum(((F.col("score") > F.lit(e)).cast("int") for e in edges), F.lit(0))
    rows = draws.of(pred.select(*keys, group, "y", "score")).groupBy(*keys, "_u", "y", "score").agg(F.count(F.lit(1)).alias("m"))
    rows = rows.select(*keys, "_u", F.col("y").cast("int").alias("y"), "score", "m", at.alias("_range"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in pred.select(*keys).dtypes)
    times = draws.times

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        units, score, y, m = (pdf[c].to_numpy() for c in ("_u", "score", "y", "m"))
        parts = [_running(times, units, score, y, m, lo, min(reps, lo + REPS)) for lo in range(0, reps, REPS)]
        u, p, q = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pdf[[*keys, "_range"]].iloc[:1].assign(u=[u], p=[p], q=[q])

    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_range")
        u, p, q = (np.stack(pdf[c].tolist()) for c in "upq")
        u = (u + p * (np.cumsum(q, axis=0) - q)).sum(0)
        p, q = p.sum(0), q.sum(0)
        out = np.where((p > 0) & (q > 0), u / np.where(p * q > 0, p * q, 1), np.nan)
        return pd.concat([pdf[keys].iloc[:1]] * reps, ignore_index=True).assign(rep=np.arange(reps), auroc=out)

    parts = rows.groupBy(*keys, "_range").applyInPandas(inside, f"{kinds}, _range int, u array<double>, p array<double>, q array<double>")
    return parts.groupBy(*keys).applyInPandas(over, f"{kinds}, rep int, auroc double").withColumn("auroc", F.nanvl("auroc", F.lit(None)))  # at most `ranges` rows each


def _running(times: Callable, units: np.ndarray, score: np.ndarray, y: np.ndarray, m: np.ndarray, lo: int, hi: int) -> tuple:
    """By replicate: ordered pairs inside a range, its positives and its negatives. A score may go on over many chunks of rows."""
    u, p, q, tied_one, tied_two = (np.zeros(hi - lo) for _ in range(5))
    own, last = times(units, lo, hi), np.nan
    for at in range(0, len(units), ROWS):
        s, w, k = score[at : at + ROWS], own[at : at + ROWS], m[at : at + ROWS]  # the counts of these rows only
        on, off = np.flatnonzero(y[at : at + ROWS] == 1), np.flatnonzero(y[at : at + ROWS] == 0)
        one, two = (w[i] * k[i, None].astype(np.float64) for i in (on, off))
        sums = np.zeros((len(off) + 1, hi - lo))
        np.cumsum(two, axis=0, out=sums[1:])
        left, right = np.searchsorted(s[off], s[on]), np.searchsorted(s[off], s[on], side="right")
        u += np.einsum("ij,ij->j", one, sums[left])
        if (same := left < right).any():
            u += np.einsum("ij,ij->j", one[same], sums[right[same]] - sums[left[same]]) / 2
        end = one.sum(0)
        u += end * q  # all negatives of earlier chunks, of which those of the first score are ties
        u += (tied_one * two[s[off] == last].sum(0) - tied_two * one[s[on] == last].sum(0)) / 2
        if s[-1] != last:
            last, tied_one, tied_two = s[-1], np.zeros(hi - lo), np.zeros(hi - lo)
        tied_one, tied_two = tied_one + one[s[on] == last].sum(0), tied_two + two[s[off] == last].sum(0)
        p, q = p + end, q + sums[-1]
    return u, p, q


def auroc_interval(pred: DataFrame, keys: list[str], reps: int = 200, seed: int = 17, group: str = "group_id", level: float = 0.95) -> DataFrame:
    """Interval of AUROC by resampling whole groups; replicates without both classes are left out."""
    return percentile_interval(auroc_replicates(pred, group_vectors(pred, reps, seed, group), keys, reps, group), keys, "auroc", level)


def control_intervals(pred: DataFrame, reps: int = 1000, alpha: float = 0.05, seed: int = 17, group: str = "group_id") -> DataFrame:
    """(model, usable, ci_low, ci_high) of control models, each at the level 1 - alpha / controls, from its own replicates."""
    k = pred.select("model").distinct().count()
    return auroc_interval(pred, ["model"], reps, seed, group, 1 - alpha / max(1, k))


def poisson_draws(reps: int, seed: int, unit: str) -> Draws:
    """How often each replicate takes each unit, drawn from Poisson(1) by the unit's hash, which stands for it.

    Drawing a fixed total with replacement makes every draw meet its unit in a shuffle of units times replicates.
    Independent counts have the same mean and nearly its variance, need no shuffle at all and leave strata independent,
    each with a size that varies about its own.
    """
    steps = np.cumsum([1 / math.factorial(i) for i in range(12)]) / math.e
    lane = (np.arange(reps, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    known = np.searchsorted(steps, np.arange(1 << 16) / (1 << 16), side="right").astype(np.uint8)  # by the first 16 bits,
    known[np.unique((steps[steps < 1] * (1 << 16)).astype(int))] = 255  # where these decide

    def counts(u: np.ndarray, lo: int, hi: int) -> np.ndarray:
        z = lane[lo:hi] ^ u.astype(np.int64).view(np.uint64)[:, None]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        own = known[z >> np.uint64(48)]
        if (open_ := own == 255).any():
            own[open_] = np.searchsorted(steps, (z[open_] >> np.uint64(11)) * 2.0**-53, side="right")
        return own

    def times(u: np.ndarray, lo: int, hi: int) -> Taken:
        return Taken(lambda some: counts(some, lo, hi), u)

    return Draws(lambda rows: rows.withColumn("_u", F.xxhash64(F.lit(seed), unit)), times)


def poisson_vectors(rows: DataFrame, reps: int, seed: int, unit: str) -> DataFrame:
    """(unit, w): the counts of `poisson_draws`, one byte per replicate."""
    of, times = poisson_draws(reps, seed, unit)

    @F.pandas_udf("binary")
    def drawn(h: pd.Series) -> pd.Series:
        own = times(h.to_numpy(), 0, reps)
        return pd.Series([w.tobytes() for at in range(0, len(h), ROWS) for w in own[at : at + ROWS]], dtype=object)

    return of(rows.select(unit).distinct()).select(unit, drawn("_u").alias("w"))


def subgroup_scores(pred: DataFrame, stratum: str = "stratum", unit: str = "sample_id", reps: int = 500, seed: int = 42, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """(model, stratum, n, auroc, ci_low, ci_high) of every stratum, and (model, gap, ci_low, ci_high) over the scored ones.

    A stratum of fewer than `least` rows or of one class is shown without a score. A replicate draws the rows of all
    strata together, the same ones for every model: the gap's interval is that of largest less smallest in each
    replicate. With fewer than two scored strata a model has no gap.
    """
    sizes = pred.groupBy("model", stratum).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y").alias("_c"))
    scored = sizes.filter((F.col("n") >= least) & (F.col("_c") > 1)).select("model", stratum)
    rows = written(pred.join(scored, ["model", stratum]).select("model", stratum, unit, "y", "score"), "scored")
    values = written(auroc_replicates(rows, poisson_draws(reps, seed, unit), ["model", stratum], reps, unit), "stratum-replicates")
    seen = auroc(rows, ["model", stratum]).select("model", stratum, "auroc")
    strata = sizes.drop("_c").join(seen, ["model", stratum], "left").join(percentile_interval(values, ["model", stratum], "auroc").drop("usable"), ["model", stratum], "left")
    k = seen.groupBy("model").agg(F.count(F.lit(1)).alias("_k"), (F.max("auroc") - F.min("auroc")).alias("gap")).filter("_k > 1")
    gaps = values.groupBy("model", "rep").agg(F.count("auroc").alias("_u"), (F.max("auroc") - F.min("auroc")).alias("gap")).join(k.select("model", "_k"), "model").filter("_u = _k")
    return strata, k.drop("_k").join(percentile_interval(gaps, ["model"], "gap"), "model", "left")


def paired_gain(pred: DataFrame, one: str, two: str, reps: int = 200, seed: int = 17, group: str = "group_id") -> DataFrame:
    """Interval of AUROC(one) - AUROC(two) with the same draws for both models."""
    both = pred.filter(F.col("model").isin(one, two))
    values = auroc_replicates(both, group_vectors(both, reps, seed, group), ["model"], reps, group)
    gap = values.groupBy("rep").agg((F.max(F.when(F.col("model") == one, F.col("auroc"))) - F.max(F.when(F.col("model") == two, F.col("auroc")))).alias("gain"))
    return percentile_interval(gap, [], "gain")


def mean_interval(rows: DataFrame, unit: str, value: str, reps: int = 200, seed: int = 17) -> DataFrame:
    """Interval of a mean by resampling whole units.

    Units are dealt into blocks by their number; a task works out how often the replicates draw its own.
    """
    per = rows.groupBy(unit).agg(F.coalesce(F.sum(value).cast("double"), F.lit(0.0)).alias("s"), F.count(value).alias("m"))
    placed = written(numbered(per.select(unit), unit), "group-places")
    n = placed.count()
    size = -(-n // BLOCKS)
    dealt = per.join(placed, unit).select("ix", "s", "m", F.floor(F.col("ix") / F.lit(max(1, size))).alias("_b"))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        ix, x = pdf["ix"].to_numpy(), pdf[["s", "m"]].to_numpy(float)
        out = np.stack([drawn_counts([seed, rep], n)[ix] @ x for rep in range(reps)])
        return pd.DataFrame({"rep": np.arange(reps), "s": out[:, 0], "m": out[:, 1]})

    drawn = dealt.groupBy("_b").applyInPandas(sums, "rep int, s double, m double").groupBy("rep").agg(F.try_divide(F.sum("s"), F.sum("m")).alias("mean"))
    return percentile_interval(drawn, [], "mean")


def plus_one_p(values: DataFrame, observed: str, null: str, keys: list[str]) -> DataFrame:
    """Per key: (1 + replicates at least as large as the observed value) / (replicates + 1)."""
    hits = F.sum((F.col(null) >= F.col(observed)).cast("long"))
    return values.groupBy(*keys).agg(((1 + hits) / (F.count(F.lit(1)) + 1)).alias("p"))


def sign_flip(pairs: DataFrame, unit: str, difference: str, reps: int = 999, seed: int = 23) -> DataFrame:
    """Two-sided sign-flip permutation test of mean paired differences."""
    signed = pairs.select(unit, difference).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    sign = F.when(uniform(F.lit(seed), "rep", F.col(unit).cast("string")) < 0.5, -1.0).otherwise(1.0)
    null = signed.groupBy("rep").agg(F.abs(F.avg(F.col(difference) * sign)).alias("null"))
    seen = pairs.agg(F.avg(difference).alias("mean"), F.abs(F.avg(difference)).alias("observed"), F.count(F.lit(1)).alias("n"))
    rows = null.join(F.broadcast(seen))
    return plus_one_p(rows.withColumn("null", F.col("null") + 1e-12), "observed", "null", ["n", "mean"])


def corrected_t(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, over paired fold scores (one, two): mean gain, corrected resampled t and its p.

    The variance is multiplied by 1/k + 1/(k - 1), the test's share of a k-fold split.
    """
    from modalens.functions.tails import t_sf2

    gain = F.col("one") - F.col("two")
    out = folds.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.avg(gain).alias("gain"), F.var_samp(gain).alias("_v"))
    k = F.col("k").cast("double")
    se = F.sqrt(F.col("_v") * (1 / k + 1 / (k - 1)))
    out = out.select(*keys, "k", "gain", F.when((k > 1) & (se > 0), F.col("gain") / se).alias("t"))
    return out.withColumn("p", t_sf2("t", F.col("k").cast("double") - 1))
