import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from modalens.functions import rank
from modalens.operators import models, nested


def study(spark, n=60, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)  # ties
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
    cells = [(f"s{i}", "m", f"f{j}", float(x[i, j])) for i in range(n) for j in range(3) if (i + j) % 7]
    cells = spark.createDataFrame(cells, "sample_id string, modality string, feature string, value double")
    samples = spark.createDataFrame([(f"s{i}", int(v)) for i, v in enumerate(y)], "sample_id string, y int")
    return cells, samples, samples.select("sample_id", F.expr("int(substring(sample_id, 2)) % 3").alias("outer_fold"))


@pytest.mark.parametrize("most", [200_000, 8])
def test_medians_need_no_copies_of_cells(spark, monkeypatch, most):
    monkeypatch.setattr(rank, "RANGE_ROWS", most)  # features in several ranges, too
    cells, _, folds = study(spark)
    rows = cells.join(folds, "sample_id").toPandas()
    out = models.fold_medians(cells, folds)
    assert "JavaObjectAggregate" not in (plan := out._jdf.queryExecution().toString()) and "percentile(" not in plan
    got = {(r.outer_fold, r.feature): r["median"] for r in out.collect()}
    assert got == {(k, f): pytest.approx(rows[(rows.outer_fold != k) & (rows.feature == f)].value.median()) for k in range(3) for f in ("f0", "f1", "f2")}


def test_only_the_folds_that_are_wanted_are_prepared(spark):
    cells, samples, folds = study(spark)
    every = models.prepared(cells, samples, folds)
    one = models.prepared(cells, samples, folds, only=[1])
    assert {r[0] for r in one.select("outer_fold").distinct().collect()} == {1} and one.count() == 60
    flat = lambda t: sorted((r.sample_id, r.side, r.y, *np.round(r.x.toArray(), 12)) for r in t.filter("outer_fold = 1").collect())
    assert flat(one) == flat(every)
    c = cells.join(folds, "sample_id").toPandas()
    c = c.pivot(index=["sample_id", "outer_fold"], columns="feature", values="value").reset_index()
    train = c[c.outer_fold != 1]
    filled = train[["f0", "f1", "f2"]].fillna(train[["f0", "f1", "f2"]].median())
    s0 = c[c.sample_id == "s0"][["f0", "f1", "f2"]].fillna(train[["f0", "f1", "f2"]].median())
    want = ((s0 - filled.mean()) / filled.std(ddof=0)).to_numpy()[0]
    assert next(r for r in flat(one) if r[0] == "s0")[3:] == pytest.approx(want)


def test_columns_scores_are_those_of_moved_rows(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(50, 3)), 1)
    y = (x[:, 0] + rng.normal(size=50) > 0).astype(int)
    rows = spark.createDataFrame([(i, float(v), [float(a) for a in p]) for i, (v, p) in enumerate(zip(y, x))], "place int, y double, x array<double>").withColumn("x", array_to_vector("x")).withColumn("w", F.lit(1.0))
    fitted, assess = models.logistic(50).fit(rows), rows.select("place", "x", "y")
    moved = nested.permuted_values(assess, 2, 5, 61)
    want = nested._scored(nested.rescored(fitted, assess, moved, "auroc"), ["ix", "rep"], "auroc").groupBy("ix").agg(F.avg("score").alias("s"))
    got = {r.ix: r.score for r in nested.column_scores(fitted, assess, 2, 5, 61).collect()}
    assert got == {r.ix: pytest.approx(r.s) for r in want.collect()} and len(got) == 3 and not any(map(math.isnan, got.values()))


def test_steps_of_an_audit_leave_only_their_results(spark):
    from modalens import audit, storage

    def step():
        first = storage.written(spark.range(5), "first")
        return storage.written(first.filter("id > 1"), "second").withColumn("twice", F.col("id") * 2)

    mark = storage.made()
    out = audit._alone(step, "result")
    assert storage._MADE[mark:] == [out._written_at] and sorted(r.twice for r in out.collect()) == [4, 6, 8]


def test_predictions_leave_no_prepared_rows(spark):
    from modalens import storage

    cells, samples, folds = study(spark)
    mark = storage.made()
    out = models.out_of_fold(cells, samples, folds)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in storage._MADE[mark:]}
    assert left == {"moments", "predicted"} and out.count() == 60
