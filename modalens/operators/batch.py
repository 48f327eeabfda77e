"""Batch diagnostics and batch centring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalens.functions.tails import f_sf
from modalens.storage import dropped, unlent, written

#: Blocks at least, points of a block at most, and numbers that its coordinates and sums by label may take (32 MB of doubles).
BLOCKS, BLOCK_POINTS, BLOCK_VALUES = 8, 1 << 16, 1 << 22
#: Points that are one row, points of a tile of distances, and the share of the squared norms below which a squared
#: distance is taken by differences.
CHUNK, TILE, NEAR = 1024, (256, 1024), 1e-6


def anova(values: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """Per key: one-way F, p and eta squared of a value across groups."""
    rows = values.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    centre = rows.groupBy(*keys).agg(F.avg(value).alias("_mu"))
    x = (rows.join(F.broadcast(centre), keys) if keys else rows.join(F.broadcast(centre))).withColumn("_x", F.col(value) - F.col("_mu"))
    parts = x.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("m"), F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("q"))
    out = parts.groupBy(*keys).agg(
        F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("_b"), F.sum("s").alias("_s"), F.sum("q").alias("_q")
    )
    fix = F.col("_s") * F.col("_s") / F.col("n")
    between, within = F.col("_b") - fix, F.col("_q") - F.col("_b")
    total = F.col("_q") - fix
    f = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (within > 0), (between / (F.col("k") - 1)) / (within / (F.col("n") - F.col("k"))))
    out = out.select(*keys, "n", "k", f.alias("f"), F.when(total > 0, between / total).alias("eta2"))
    return out.withColumn("p", f_sf("f", (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")))


def structured(silhouette: DataFrame, anova_table: DataFrame, keys: list[str]) -> DataFrame:
    """Flag: silhouette over 0.25, or eta squared over 0.15 with p below 0.05."""
    both = silhouette.join(anova_table, keys, "full")
    flag = (F.coalesce("silhouette", F.lit(0.0)) > 0.25) | ((F.coalesce("eta2", F.lit(0.0)) > 0.15) & (F.coalesce("p", F.lit(1.0)) < 0.05))
    return both.withColumn("structured", flag)


def confounded(test: DataFrame) -> DataFrame:
    """A batch-by-class table is confounded if p < 0.05 and V > 0.2."""
    return test.withColumn("confounded", F.coalesce((F.col("p") < 0.05) & (F.col("cramers_v") > 0.2), F.lit(False)))


def fold_moments(cells: DataFrame, folds: DataFrame, by: list[str]) -> DataFrame:
    """Training moments of every fold by one pass: the total minus the fold's own part, after centring on the total mean.

    (by, outer_fold, n, mean, m2): count, mean and sum of squared deviations of the training cells. Cells may come with
    their own fold, `_own`.
    """
    rows = cells.withColumnRenamed("_own", "outer_fold") if "_own" in cells.columns else cells.join(unlent(folds.select("sample_id", "outer_fold")), "sample_id")
    centre = written(rows.groupBy("modality", "feature").agg(F.avg("value").alias("_mu")), "centres")  # by its size Spark sees whether cells must be shuffled
    x = rows.join(centre, ["modality", "feature"]).withColumn("_x", F.col("value") - F.col("_mu"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("q"), F.first("_mu").alias("_mu")]
    own = x.groupBy(*by, "outer_fold").agg(*sums)
    every = own.groupBy(*by).agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"), F.first("_mu").alias("_mu"))
    k = folds.select("outer_fold").distinct()
    grid = every.join(F.broadcast(k)).join(own.select(*by, "outer_fold", "n", "s", "q"), [*by, "outer_fold"], "left").na.fill(0, ["n", "s", "q"])
    n, s, q = F.col("tn") - F.col("n"), F.col("ts") - F.col("s"), F.col("tq") - F.col("q")
    return grid.select(*by, "outer_fold", n.alias("n"), (F.col("_mu") + s / F.when(n > 0, n)).alias("mean"), F.when(n > 0, F.greatest(F.lit(0.0), q - s * s / n)).alias("m2")).filter("n > 0")


def centred(cells: DataFrame, samples: DataFrame, folds: DataFrame) -> DataFrame:
    """(outer_fold, sample_id, modality, feature, value): cells less their batch's training offset in each fold.

    The offset is the batch's training mean less the training mean; a batch without training rows keeps its values.
    """
    batched = cells.join(unlent(samples.select("sample_id", "batch")), "sample_id")
    per_batch = fold_moments(batched, folds, ["modality", "feature", "batch"]).select("modality", "feature", "batch", "outer_fold", F.col("mean").alias("_bm"))
    per_all = fold_moments(cells, folds, ["modality", "feature"]).select("modality", "feature", "outer_fold", F.col("mean").alias("_am"))
    k = folds.select("outer_fold").distinct()
    rows = batched.join(F.broadcast(k)).join(per_all, ["modality", "feature", "outer_fold"]).join(per_batch, ["modality", "feature", "batch", "outer_fold"], "left")
    return rows.select("outer_fold", "sample_id", "modality", "feature", (F.col("value") - F.coalesce(F.col("_bm") - F.col("_am"), F.lit(0.0))).alias("value"))


def centring_guard(samples: DataFrame, folds: DataFrame, least: int = 2) -> DataFrame:
    """(outer_fold, batch, n_train): batches of a validation fold with fewer than `least` training rows."""
    rows = samples.join(folds, "sample_id").groupBy("batch", "outer_fold").agg(F.count(F.lit(1)).alias("n_val"))
    every = rows.groupBy("batch").agg(F.sum("n_val").alias("n"))
    return rows.join(every, "batch").select("outer_fold", "batch", (F.col("n") - F.col("n_val")).alias("n_train")).filter(F.col("n_train") < least)


def silhouette(points: DataFrame, label: str, keys: list[str] = ()) -> DataFrame:
    """Per key: mean silhouette of (sample_id, coordinates array, label) by Euclidean distance; null for one label.

    Equal points of a label are one with a weight. Blocks of points meet once in each pair; a task works their distances
    out by products of tiles and adds them up by label for both blocks, so no pair of points is ever a row. The number of
    distances goes with the square of the different points; what tasks hold is bounded by BLOCK_VALUES.
    """
    named, keys = list(keys), [*keys, "_all"]
    rows = points.filter(F.col(label).isNotNull()).withColumn("_all", F.lit(0))
    one = written(rows.groupBy(*keys, label, "coordinates").agg(F.count(F.lit(1)).alias("_w")), "points")
    sizes = one.groupBy(*keys, label).agg(F.sum("_w").alias("_n"), F.count(F.lit(1)).alias("_m"), F.max(F.size("coordinates")).alias("_d"))
    sizes = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col("_n").alias("n")))).alias("_labels"), F.sum("_m").alias("_m"), F.max("_d").alias("_d"))
    sizes = written(sizes, "labels")  # a row per key, an element per label
    most, wide, many = (x or 1 for x in sizes.agg(F.max("_m"), F.max("_d"), F.max(F.size("_labels"))).first())
    blocks = max(BLOCKS, -(-most // max(512, min(BLOCK_POINTS, BLOCK_VALUES // max(wide, many)))))
    labels = sizes.select(*keys, "_labels")
    code = (F.array_position(F.transform("_labels", lambda x: x["label"]), F.col(label)) - 1).cast("int")
    coded = one.join(F.broadcast(labels), keys).select(*keys, F.pmod(F.xxhash64(label, "coordinates"), F.lit(blocks)).alias("_b"), code.alias("_code"), "_w", "coordinates")
    kind = dict(one.dtypes)
    named_ = ", ".join(f"`{c}` {kind[c]}" for c in keys)
    packed = "_b long, _c long, codes binary, weights binary"
    chunks = written(coded.groupBy(*keys, "_b").applyInPandas(lambda pdf: _chunks(pdf, keys), f"{named_}, {packed}, points binary"), "point-blocks")
    dropped(one)

    pairs = chunks.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    pairs = pairs.withColumn("_lo", F.least("_b", "_o")).withColumn("_hi", F.greatest("_b", "_o")).drop("_o")
    pairs = pairs.repartition(min(4096, blocks * (blocks + 1)), *keys, "_lo", "_hi")  # a number that is kept: small tables make long tasks
    sums = pairs.groupBy(*keys, "_lo", "_hi").applyInPandas(lambda pdf: _distances(pdf, keys, many), f"{named_}, {packed}, sums binary")
    per = sums.groupBy(*keys, "_b", "_c").applyInPandas(lambda pdf: _added(pdf, keys), f"{named_}, _code int, _w double, _sums array<double>")

    x = per.join(F.broadcast(labels), keys)
    size = lambda i: F.get("_labels", i)["n"]
    m = size(F.col("_code"))
    mean = F.transform(F.slice("_sums", 1, F.size("_labels")), lambda d, i: F.when(i != F.col("_code"), d / size(i)))
    x = x.select(*keys, "_code", "_w", m.alias("_m"), F.when(m > 1, F.get("_sums", F.col("_code")) / (m - 1)).alias("_a"), F.array_min(mean).alias("_b"))
    s = F.when(F.col("_m") == 1, 0.0).otherwise((F.col("_b") - F.col("_a")) / F.greatest("_a", "_b"))
    out = x.groupBy(*keys).agg(F.sum("_w").cast("long").alias("n"), F.countDistinct("_code").alias("k"), (F.sum(s * F.col("_w")) / F.sum(F.when(s.isNotNull(), F.col("_w")))).alias("s"))
    return out.select(*named, "n", F.when((F.col("k") > 1) & (F.col("k") < F.col("n")), F.col("s")).alias("silhouette"))


def _chunks(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """A block's points in order of label, CHUNK to a row, as bytes."""
    pdf = pdf.sort_values("_code", kind="stable")
    x, code, w = np.array(pdf["coordinates"].tolist(), float), pdf["_code"].to_numpy("int32"), pdf["_w"].to_numpy("float64")
    own = {c: pdf[c].iloc[0] for c in [*keys, "_b"]}
    cut = range(0, len(pdf), CHUNK)
    return pd.DataFrame([own | {"_c": i // CHUNK, "codes": code[i : i + CHUNK].tobytes(), "weights": w[i : i + CHUNK].tobytes(), "points": x[i : i + CHUNK].tobytes()} for i in cut])


def _runs(code: np.ndarray) -> list[tuple[int, int, int]]:
    """(code, from, to) of the runs of equal codes."""
    at = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
    return [(int(code[i]), i, j) for i, j in zip(at[:-1], at[1:], strict=True)]


def _distances(pdf: pd.DataFrame, keys: list[str], many: int) -> pd.DataFrame:
    """Of a pair of blocks: each point's distances to the other block's points, summed by label."""
    pdf = pdf.sort_values("_c")
    lo, hi = pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]
    sides = [pdf[pdf["_b"] == b] for b in dict.fromkeys([lo, hi])]
    if any(not len(s) for s in sides):
        return pd.DataFrame(columns=[*keys, "_b", "_c", "codes", "weights", "sums"])
    code, weight, x = ([np.frombuffer(b"".join(s[c]), t) for s in sides] for c, t in (("codes", "int32"), ("weights", float), ("points", float)))
    x = [v.reshape(len(c), -1) for v, c in zip(x, code, strict=True)]
    centre = x[0].mean(0)
    x = [v - centre for v in x]  # small norms, so products lose little
    norm, total = [(v * v).sum(1) for v in x], [np.zeros((len(v), many)) for v in x]
    one, two = 0, len(sides) - 1
    left = np.column_stack([-2 * x[one], norm[one], np.ones(len(x[one]))])
    right = np.column_stack([x[two], np.ones(len(x[two])), norm[two]])
    for i in range(0, len(left), TILE[0]):
        a = slice(i, i + TILE[0])
        for j in range(0, len(right), TILE[1]):
            b = slice(j, j + TILE[1])
            d = left[a] @ right[b].T
            if not d.min() > NEAR * (norm[one][a].max() + norm[two][b].max()):
                p, q = np.nonzero(d <= NEAR * (norm[one][a][:, None] + norm[two][b][None]))
                for k in range(0, len(p), CHUNK):  # products cancel here: by differences
                    s = slice(k, k + CHUNK)
                    d[p[s], q[s]] = ((x[one][a][p[s]] - x[two][b][q[s]]) ** 2).sum(1)
            np.sqrt(d, out=d)
            for c, f, t in _runs(code[two][b]):
                total[one][a, c] += d[:, f:t] @ weight[two][b][f:t]
            if two != one:
                for c, f, t in _runs(code[one][a]):
                    total[two][b, c] += weight[one][a][f:t] @ d[f:t]
    out = []
    for s, sums in zip(sides, total, strict=True):
        own = s[[*keys, "_b", "_c", "codes", "weights"]]
        out.append(own.assign(sums=[sums[i : i + CHUNK].tobytes() for i in range(0, len(sums), CHUNK)]))
    return pd.concat(out)


def _added(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The sums of a chunk's points over all blocks."""
    total = np.frombuffer(pdf["sums"].iloc[0]).copy()
    for x in pdf["sums"].iloc[1:]:
        total += np.frombuffer(x)
    code = np.frombuffer(pdf["codes"].iloc[0], "int32")
    out = pd.DataFrame({"_code": code, "_w": np.frombuffer(pdf["weights"].iloc[0]), "_sums": list(total.reshape(len(code), -1))})
    return out.assign(**{c: pdf[c].iloc[0] for c in keys})[[*keys, "_code", "_w", "_sums"]]
