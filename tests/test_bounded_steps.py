"""Steps whose memory, disk or time grew faster than their input."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modalens.functions import rank
from modalens.operators import bootstrap, models, scales


def test_tables_of_thousands_of_groups_are_held_as_ranks():
    assert scales.MATRIX_GROUPS >= 9000  # users of the events at six times sf0.1
    rng, n = np.random.default_rng(6), 400
    tables, plain = [], []
    for t in range(2):
        x = rng.integers(0, 20, n) / 20
        d = np.abs(x - x[:, None])
        tables += [{"t": t, "i": i, "d": d[i, i + 1 :]} for i in range(n)]
        own = d - d.sum(axis=0) / (n - 1)
        np.fill_diagonal(own, 0.0)
        plain.append((own, np.stack([np.unique(c, return_inverse=True)[1] for c in d.T], axis=1)))
    p = rng.permutation(n)
    tables, names = pd.DataFrame(tables), pd.DataFrame({"rep": 1, "i": np.arange(n), "p": p})
    tracemalloc.start()
    try:
        ((rep, local),) = scales._matrix_maps(tables, names, n)
        assert tracemalloc.get_traced_memory()[1] < 24 * n * n  # two tables of numbers and ranks alone take 32 bytes a pair
    finally:
        tracemalloc.stop()
    (x, k), (y, other) = plain
    y, other = y[np.ix_(p, p)].T, other[np.ix_(p, p)].T
    on = (k <= 5) & (other <= 3)
    whole = lambda z, r, j: (z.sum(where=r <= j) / n, (z * z.T).sum(where=(r <= j) & (r.T <= j)))
    (ex, vx), (ey, vy) = whole(x, k, 5), whole(y.T, other.T, 3)
    assert rep == 1 and local[5, 3] == pytest.approx(((x * y).sum(where=on) - ex * ey) / np.sqrt((vx - ex * ex) * (vy - ey * ey)))


def test_tasks_hold_no_replicates_of_their_rows(spark, monkeypatch):
    groups = spark.range(50).select("id")
    of, times = bootstrap.group_vectors(groups, 125, 3, "id")
    rng, n = np.random.default_rng(2), 200_000
    units, score, y = rng.integers(0, 50, n), np.sort(rng.random(n)), rng.integers(0, 2, n)
    tracemalloc.start()
    try:
        u, p, q = bootstrap._running(times, units, score, y, np.ones(n, int), 0, 125)
        assert tracemalloc.get_traced_memory()[1] < 60 * n  # a byte for each row and replicate is more
    finally:
        tracemalloc.stop()
    w = np.array([bootstrap.drawn_counts([3, 7], 50)])[0][units]
    assert p[7] == w[y == 1].sum() and q[7] == w[y == 0].sum() and u[7] == (w * (y == 1) * np.cumsum(w * (y == 0))).sum()

    asked, real = [], type(groups).approxQuantile
    monkeypatch.setattr(type(groups), "approxQuantile", lambda self, c, at, e: asked.append(len(at) + 1) or real(self, c, at, e))
    pred = spark.createDataFrame([("a", f"g{i % 7}", i * i % 2, i / 400) for i in range(400)], "model string, group_id string, y int, score double")
    draws = bootstrap.group_vectors(pred, 20, 3, "group_id")
    few = {r.rep: r.auroc for r in bootstrap.auroc_replicates(pred, draws, ["model"], 20).collect()}
    monkeypatch.setattr(bootstrap, "RANGE_ROWS", 4)
    assert {r.rep: r.auroc for r in bootstrap.auroc_replicates(pred, draws, ["model"], 20).collect()} == few and asked == [32, 100]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_rows_of_samples_are_not_broadcast(spark, monkeypatch):
    n = 40  # rows in order make small files, which Spark would broadcast whatever their number
    samples = spark.createDataFrame([(f"{i:03d}", float(i * i % 7)) for i in range(n)], "sample_id string, y double")
    folds = samples.select("sample_id", F.expr("int(sample_id) % 2").alias("outer_fold"))
    cells = spark.createDataFrame([(f"{i:03d}", "m", f"f{j}", float(i % (3 + j))) for i in range(n) for j in range(3)], "sample_id string, modality string, feature string, value double")
    written, sides = models.written, []

    def seen(df, name):
        if name in ("cells", "targeted", "prepared"):
            sides.append((name, plan(df).count("BroadcastHashJoin")))
        return written(df, name)

    monkeypatch.setattr(models, "written", seen)
    models.prepared_columns(cells, samples, folds, 2, models.selected_linear)
    own = {name for name, _ in sides}
    assert own == {"cells", "targeted", "prepared"}
    at = dict(sides)
    assert at["cells"] == 0 and at["prepared"] <= 2  # the features' numbers, in the plan's two shapes
    assert "BroadcastHashJoin" not in plan(models.fold_medians(cells, folds))


@pytest.mark.parametrize("near", [0.0005, 0.2, -0.4])
def test_medians_of_many_cells_are_exact_without_their_order(spark, monkeypatch, near):
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"sample_id": [f"s{i}" for i in range(3000)], "value": np.round(rng.normal(size=3000) * 50), "outer_fold": rng.integers(0, 3, 3000)})
    cells = spark.createDataFrame(rows[["sample_id", "value"]]).withColumn("modality", F.lit("m")).withColumn("feature", F.when(F.col("value") > 30, "high").otherwise("low"))
    folds = spark.createDataFrame(rows[["sample_id", "outer_fold"]])
    monkeypatch.setattr(rank, "RANGE_ROWS", 100)
    monkeypatch.setattr(models, "NEAR", near)  # with a share below zero nothing is found there, so all cells are put in order
    ordered = []
    monkeypatch.setattr(models, "ranged", lambda *a: ordered.append(1) or rank.ranged(*a))
    got = {(r.outer_fold, r.feature): r["median"] for r in models.fold_medians(cells, folds).collect()}
    kind = np.where(rows.value > 30, "high", "low")
    assert got == {(k, f): rows.value[(rows.outer_fold != k) & (kind == f)].median() for k in range(3) for f in ("high", "low")}
    assert bool(ordered) == (near < 0)
