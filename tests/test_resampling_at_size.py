"""Resampling whose rows don't take their replicates through a shuffle, with the draws of the plain tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalens.operators import association, bootstrap, groups, rows
from modalens.plans import registry


def plan(df):
    return df._jdf.queryExecution().toString()


def test_tasks_draw_what_the_columns_draw(spark):
    n = 70000
    own = spark.range(n).select(F.floor(bootstrap.uniform(F.lit(5), F.lit(3), F.col("id").cast("int")) * n).alias("i")).groupBy("i").count().collect()
    want = np.zeros(n, int)
    for r in own:
        want[r.i] = r["count"]
    assert (bootstrap.drawn_counts([5, 3], n) == want).all() and want.sum() == n
    own = spark.range(90).select(F.floor(bootstrap.uniform(F.lit(5), F.lit(3), "id", F.lit(7), F.lit(-9).cast("long")) * 90).alias("i")).groupBy("i").count().collect()
    got = bootstrap.drawn_counts([5, 3], 90, [(7, False), (-9, True)], wide=True)
    assert {r.i: r["count"] for r in own} == {i: c for i, c in enumerate(got) if c}


def test_rows_carry_no_replicates(spark):
    pred = spark.createDataFrame([("a", f"g{i % 7}", i % 2, i / 50) for i in range(50)], "model string, group_id string, y int, score double")
    for draws in (bootstrap.group_vectors(pred, 40, 3, "group_id"), bootstrap.poisson_draws(40, 3, "group_id")):
        shown = plan(bootstrap.auroc_replicates(pred, draws, ["model"], 40))
        assert "binary" not in shown and "explode" not in shown.lower()


def test_ties_over_many_chunks_of_rows():
    rng = np.random.default_rng(4)
    n = 5000
    score, y, m, w = np.sort(rng.integers(0, 3, n) / 3), rng.integers(0, 2, n), rng.integers(1, 4, n), rng.integers(0, 4, (n, 5)).astype(np.uint8)
    u, p, q = bootstrap._running(lambda *_: w, np.arange(n), score, y, m, 0, 5)
    x = w * m[:, None].astype(float)
    one, two = x * (y == 1)[:, None], x * (y == 0)[:, None]
    by = np.array([[x_[score == s].sum(0) for s in np.unique(score)] for x_ in (one, two)])
    want = (by[0] * (np.cumsum(by[1], axis=0) - by[1] / 2)).sum(0)
    assert np.array_equal(u, want) and np.array_equal(p, one.sum(0)) and np.array_equal(q, two.sum(0))


def test_mean_interval_draws_whole_units(spark):
    rng = np.random.default_rng(8)
    data = [(f"u{i % 40}", float(rng.normal())) for i in range(300)] + [("u3", None), ("none", None)]
    table = spark.createDataFrame(data, "unit string, value double")
    drawn = bootstrap.mean_interval(table, "unit", "value", reps=60, seed=2)
    w = {}
    for r in bootstrap.group_weights(table, 60, 2, "unit").collect():
        w.setdefault(r.rep, {})[r.unit] = r.w
    means = [sum(w[k].get(u, 0) * v for u, v in data if v is not None) / sum(w[k].get(u, 0) for u, v in data if v is not None) for k in range(60)]
    got = drawn.first()
    assert (got.ci_low, got.ci_high) == pytest.approx((np.percentile(means, 2.5), np.percentile(means, 97.5)))
    assert "explode" not in plan(drawn).lower()


def test_role_intervals_draw_whole_datasets(spark):
    rng = np.random.default_rng(3)
    data = [(int(k), int(d), "ab"[rng.integers(0, 2)], [None, "a", "b", "x"][rng.integers(0, 4)]) for k in (1, 2) for d in range(12) for _ in range(9)]
    table = spark.createDataFrame(data, "k int, d long, truth string, called string")
    out = rows.pooled_role_interval(table, ["k"], "d", reps=50)
    assert "explode" not in plan(out).lower()
    order = [r.d for r in spark.range(12).select(F.col("id").alias("d"), F.xxhash64("id").alias("o")).withColumn("s", F.pmod("o", F.lit(64))).orderBy("s", "o").collect()]
    got = {r.k: r for r in out.collect()}
    for k in (1, 2):
        scores = []
        for rep in range(1, 51):
            w = bootstrap.drawn_counts([42, rep], 12, [(k, False)], wide=True)
            own = [(t, c) for key, d, t, c in data if key == k for _ in range(w[order.index(d)])]
            scores.append(np.mean([2 * sum(t == c == r for t, c in own) / (sum(t == r for t, _ in own) + sum(c == r for _, c in own)) for r in {t for t, _ in own}]))
        assert (got[k].ci_low, got[k].ci_high) == pytest.approx((np.percentile(scores, 2.5), np.percentile(scores, 97.5)))


def test_permuted_labels_are_not_broadcast(spark):
    table = spark.createDataFrame([(f"g{i}", i) for i in range(30)], "group_id string, x int")
    shown = groups.permuted(table, ["x"], reps=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in shown


def test_batch_association_without_replicates_permutes_nothing(spark, monkeypatch):
    table = spark.createDataFrame([(f"g{i}", float(i % 5), f"b{i % 3}") for i in range(30)], "group_id string, t double, batch string")
    seen = association.continuous_by_batch(table, "t", "batch", reps=9).first()
    labels, asked = association.permuted, []
    monkeypatch.setattr(association, "permuted", lambda *a, **k: asked.append(a[2]) or labels(*a, **k))
    alone = association.continuous_by_batch(table, "t", "batch", reps=0).first()
    assert alone.dcor == pytest.approx(seen.dcor) and (alone.n, alone.p) == (30, None) and 0.1 <= seen.p <= 1 and not asked
    registry.queries()["g8_continuous_by_batch"](spark, "/root/testdata/sf0.001").first()
    assert not asked
