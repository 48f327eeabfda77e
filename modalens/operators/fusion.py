"""Intermediate fusion: an embedding of every modality, pooled over its observed cells, and one network on all of them.

A modality's features have vectors of `dim` numbers; a sample's embedding is the mean over its observed cells of value
times vector, plus a bias, normalised. A missing cell has no row and adds nothing. The embeddings of all modalities in a
row go through one hidden layer to the classes. Training works in rounds: rows of a fold's training side are dealt into
parts, each part takes some steps from the round's parameters, and the parts' parameters are averaged by rows, slice by
slice. Only parameters, whose number is that of the features times `dim`, come to the driver between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalens.operators.models import masked_standardized
from modalens.storage import written

#: Training rows of a part, rows that are worked at a time, numbers of a slice of parameters.
PART_ROWS, CHUNK, SLICE = 4096, 256, 1 << 16
_EPS = 1e-5


class Shape:
    """Places of a network's parameters in one vector. widths: features of each modality, in order."""

    def __init__(self, widths: list[int], classes: int, dim: int, hidden: int):
        self.widths, self.classes, self.dim, self.hidden = widths, classes, dim, hidden
        self.starts = np.concatenate([[0], np.cumsum(widths)])
        m = len(widths)
        self.sizes = {"e": (sum(widths), dim), "b": (m, dim), "g": (m, dim), "s": (m, dim), "w": (m * dim, hidden), "c": (hidden,), "v": (hidden, classes), "o": (classes,)}
        self.length = sum(int(np.prod(s)) for s in self.sizes.values())

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of the vector, by name."""
        out, at = {}, 0
        for name, s in self.sizes.items():
            out[name] = flat[at : at + int(np.prod(s))].reshape(s)
            at += int(np.prod(s))
        return out

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        flat = np.zeros(self.length)
        p = self.split(flat)
        p["e"][:] = rng.normal(size=p["e"].shape) * 0.1
        p["g"][:] = 1.0
        p["w"][:] = rng.uniform(-1, 1, p["w"].shape) / np.sqrt(len(p["w"]))
        p["v"][:] = rng.uniform(-1, 1, p["v"].shape) / np.sqrt(len(p["v"]))
        return flat

    def forward(self, p: dict, x: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Class probabilities of rows of values (zero where missing) with `seen` cells per modality, and what backward needs."""
        parts, normed, spread = [], [], []
        for m in range(len(self.widths)):
            pooled = x[:, self.starts[m] : self.starts[m + 1]] @ p["e"][self.starts[m] : self.starts[m + 1]] / np.maximum(seen[:, m : m + 1], 1) + p["b"][m]
            sd = np.sqrt(pooled.var(axis=1, keepdims=True) + _EPS)
            n = (pooled - pooled.mean(axis=1, keepdims=True)) / sd
            normed.append(n)
            spread.append(sd)
            parts.append(n * p["g"][m] + p["s"][m])
        joined = np.concatenate(parts, axis=1)
        hidden = np.maximum(joined @ p["w"] + p["c"], 0)
        z = hidden @ p["v"] + p["o"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), (normed, spread, joined, hidden)

    def gradient(self, flat: np.ndarray, x: np.ndarray, seen: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted sum of cross-entropies and its gradient."""
        p, out = self.split(flat), np.zeros(self.length)
        g = self.split(out)
        prob, (normed, spread, joined, hidden) = self.forward(p, x, seen)
        loss = -float((weight * np.log(np.maximum(prob[np.arange(len(y)), y], 1e-300))).sum())
        dz = prob * weight[:, None]
        dz[np.arange(len(y)), y] -= weight
        g["v"][:], g["o"][:] = hidden.T @ dz, dz.sum(axis=0)
        dh = (dz @ p["v"].T) * (hidden > 0)
        g["w"][:], g["c"][:] = joined.T @ dh, dh.sum(axis=0)
        dj = dh @ p["w"].T
        for m in range(len(self.widths)):
            d = dj[:, m * self.dim : (m + 1) * self.dim]
            g["g"][m], g["s"][m] = (d * normed[m]).sum(axis=0), d.sum(axis=0)
            dn = d * p["g"][m]
            dp = (dn - dn.mean(axis=1, keepdims=True) - normed[m] * (dn * normed[m]).mean(axis=1, keepdims=True)) / spread[m]
            g["b"][m] = dp.sum(axis=0)
            own = slice(self.starts[m], self.starts[m + 1])
            g["e"][own] = x[:, own].T @ (dp / np.maximum(seen[:, m : m + 1], 1))
        return loss, out

    def rows(self, part: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Chunks of rows (ix, z) as values and numbers of observed cells by modality."""
        for lo in range(0, len(part), CHUNK):
            own = part.iloc[lo : lo + CHUNK]
            x, seen = np.zeros((len(own), int(self.starts[-1]))), np.zeros((len(own), len(self.widths)))
            size = [len(i) for i in own.ix]
            if sum(size):
                row, ix = np.repeat(np.arange(len(own)), size), np.concatenate(own.ix.tolist())
                x[row, ix] = np.concatenate(own.z.tolist())
                np.add.at(seen, (row, np.searchsorted(self.starts, ix, side="right") - 1), 1)
            yield slice(lo, lo + len(own)), x, seen


def stepped(shape: Shape, flat: np.ndarray, part: pd.DataFrame, steps: int, rate: float, decay: float) -> np.ndarray:
    """Parameters after some steps of Adam on all rows of a part."""
    flat, first, second = flat.copy(), np.zeros(shape.length), np.zeros(shape.length)
    y, weight = part.y.to_numpy(np.int64), part.w.to_numpy(float)
    for t in range(1, steps + 1):
        g = decay * flat
        for own, x, seen in shape.rows(part):
            g += shape.gradient(flat, x, seen, y[own], weight[own])[1] / weight.sum()
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        flat -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return flat


def _moves(shape: Shape, held: dict[int, np.ndarray], steps: int, rate: float, decay: float):
    """What one part makes of its fold's parameters, in slices."""

    def moved(part: pd.DataFrame) -> pd.DataFrame:
        fold = int(part.outer_fold.iloc[0])
        flat = stepped(shape, held[fold], part, steps, rate, decay)
        cuts = range(0, shape.length, SLICE)
        return pd.DataFrame({"outer_fold": fold, "at": list(cuts), "n": float(len(part)), "p": [flat[i : i + SLICE].tobytes() for i in cuts]})

    return moved


def intermediate_fusion(
    cells: DataFrame, samples: DataFrame, folds: DataFrame, dim: int = 8, hidden: int = 16, rounds: int = 6, steps: int = 40, rate: float = 0.02, decay: float = 1e-4, seed: int = 3, model: str = "neural::FUSION"
) -> DataFrame:
    """(model, sample_id, outer_fold, y, pred, probs): out-of-fold predictions of one network over all modalities.

    Values are standardised by each fold's training moments; classes y are numbered from 0 and weighted against their
    frequency. All folds are trained in the same jobs. A sample without a cell is predicted from the biases.
    """
    samples, folds = written(samples.select("sample_id", F.col("y").cast("int").alias("y")), "samples"), written(folds, "folds")
    names = written(cells.select("modality", "feature").distinct(), "features")
    widths = [r["count"] for r in names.groupBy("modality").count().orderBy("modality").collect()]  # a row per modality
    before = F.row_number().over(Window.orderBy("modality", "feature")) - 1  # a row per feature, as many as the parameters
    z = masked_standardized(cells, folds).join(F.broadcast(names.withColumn("ix", before)), ["modality", "feature"])
    per = z.groupBy("outer_fold", "sample_id").agg(F.collect_list("ix").alias("ix"), F.collect_list("z").alias("z"))
    fold_names = folds.select(F.col("outer_fold").alias("_f")).distinct()
    every = samples.join(folds, "sample_id").join(F.broadcast(fold_names)).select("sample_id", "y", F.col("outer_fold").alias("own"), F.col("_f").alias("outer_fold"))  # a row per fold
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    data = every.join(per, ["outer_fold", "sample_id"], "left").select("outer_fold", "sample_id", "y", (F.col("own") != F.col("outer_fold")).alias("train"), empty("ix", "int"), empty("z", "double"))
    data = written(data, "vectors")
    counts = data.filter("train").groupBy("outer_fold", "y").agg(F.count(F.lit(1)).alias("m"))
    sizes = counts.groupBy("outer_fold").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), F.max("y").alias("top"))
    about = sizes.collect()  # a row per fold
    classes = max(r.top for r in about) + 1
    parts = -(-max(r.n for r in about) // PART_ROWS)
    shape = Shape(widths, classes, dim, hidden)
    weight = F.col("n") / (F.col("k") * F.col("m"))
    train = data.filter("train").join(F.broadcast(counts.join(sizes, "outer_fold")), ["outer_fold", "y"]).withColumn("w", weight)  # a row per fold and class
    train = written(train.select("outer_fold", "y", "ix", "z", "w", F.pmod(F.xxhash64("sample_id"), F.lit(parts)).alias("part")), "training")
    now = {r.outer_fold: shape.start(seed) for r in about}

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(n * np.frombuffer(p) for n, p in zip(rows.n, rows.p, strict=True)) / rows.n.sum()
        return rows[["outer_fold", "at"]].iloc[:1].assign(p=[total.tobytes()])

    for _ in range(rounds):
        slices = train.groupBy("outer_fold", "part").applyInPandas(_moves(shape, now, steps, rate, decay), "outer_fold int, at long, n double, p binary").groupBy("outer_fold", "at").applyInPandas(mean, "outer_fold int, at long, p binary")
        now = {f: np.zeros(shape.length) for f in now}
        for r in slices.collect():  # one vector of parameters per fold
            own = np.frombuffer(r.p)
            now[r.outer_fold][r["at"] : r["at"] + len(own)] = own
    final = now

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold, part in batch.groupby("outer_fold"):
                p = shape.split(final[int(fold)])
                prob = np.concatenate([shape.forward(p, x, seen)[0] for _, x, seen in shape.rows(part)])
                yield part[["sample_id", "outer_fold", "y"]].assign(pred=prob.argmax(axis=1).astype(float), probs=list(prob))

    out = data.filter("NOT train").select("sample_id", "outer_fold", "y", "ix", "z").mapInPandas(told, "sample_id string, outer_fold int, y int, pred double, probs array<double>")
    return out.select(F.lit(model).alias("model"), "sample_id", "outer_fold", F.col("y").cast("double").alias("y"), "pred", "probs")
