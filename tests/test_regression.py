"""Selection by F of a line, regression trees, boosting of several classes, a fusion network."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalens.operators import models, splits


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))
    y = 2 * x[:, 0] - x[:, 2] + rng.normal(size=90) * 0.3 + 7
    lost = rng.random((90, 4)) < 0.1
    cells = [(f"s{i:02d}", "m", f"f{j}", float(x[i, j])) for i in range(90) for j in range(4) if not lost[i, j]]
    table = spark.createDataFrame(cells, "sample_id string, modality string, feature string, value double").cache()
    samples = spark.createDataFrame([(f"s{i:02d}", float(y[i]), f"g{i}") for i in range(90)], "sample_id string, y double, group_id string").cache()
    folds = spark.createDataFrame([(f"s{i:02d}", i % 3) for i in range(90)], "sample_id string, outer_fold int").cache()
    return np.where(lost, np.nan, x), y, table, samples, folds


def test_features_are_selected_by_the_training_f_of_a_line(line):
    x, y, table, samples, folds = line
    got = {(r.outer_fold, r.feature): (r.f, r.place) for r in models.selected_linear(table, samples, folds).collect()}
    for k in range(3):
        rows = np.arange(90) % 3 != k
        f = {}
        for j in range(4):
            v = np.where(np.isnan(x[rows, j]), np.nanmedian(x[rows, j]), x[rows, j])
            r2 = np.corrcoef(v, y[rows])[0, 1] ** 2
            f[f"f{j}"] = r2 / (1 - r2) * (rows.sum() - 2)
        order = sorted(f, key=lambda c: -f[c])
        assert all(got[k, c][0] == pytest.approx(f[c]) and got[k, c][1] == order.index(c) + 1 for c in f)
    assert models.selected_linear(table, samples, folds, top=2).count() == 6


def test_forest_and_boosting_regression_on_held_out_samples(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(300, 3))
    y = 2 * x[:, 0] - x[:, 2] + rng.normal(size=300) * 0.3 + 7
    table = spark.createDataFrame([(f"s{i:03d}", "m", f"f{j}", float(x[i, j])) for i in range(300) for j in range(3)], "sample_id string, modality string, feature string, value double").cache()
    samples = spark.createDataFrame([(f"s{i:03d}", float(y[i])) for i in range(300)], "sample_id string, y double").cache()
    folds = spark.createDataFrame([(f"s{i:03d}", i % 3) for i in range(300)], "sample_id string, outer_fold int").cache()
    for make, least in ((lambda n: models.forest_regression(n, trees=30), 0.8), (lambda n: models.boosting_regression(n, rounds=20), 0.8), (None, 0.95)):
        out = models.out_of_fold_regression(table, samples, folds, make=make, top=2).toPandas()
        assert len(out) == 300 and 1 - ((out.y - out.score) ** 2).sum() / ((y - y.mean()) ** 2).sum() > least


def test_classes_against_the_rest(spark):
    rng = np.random.default_rng(6)
    cls = np.arange(120) % 3
    x = rng.normal(size=(120, 2)) * 0.5 + np.array([[0, 2], [2, 0], [-2, -2]])[cls]
    cells = spark.createDataFrame([(f"s{i:03d}", "m", f"f{j}", float(x[i, j])) for i in range(120) for j in range(2)], "sample_id string, modality string, feature string, value double")
    samples = spark.createDataFrame([(f"s{i:03d}", int(cls[i]), f"g{i}") for i in range(120)], "sample_id string, y int, group_id string")
    out = models.out_of_fold(cells, samples, splits.stratified(samples, 2, "y"), lambda n: models.AgainstRest(lambda m: models.boosting(m, rounds=4), n), "boosting")
    rows = out.withColumn("total", F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)).toPandas()
    assert len(rows) == 120 and np.allclose(rows.total, 1) and (rows.pred == rows.y).mean() > 0.9
    assert all(int(np.argmax(p)) == c for p, c in zip(rows.probs, rows.pred, strict=True))


def test_gradient_of_the_fusion_network():
    from modalens.operators.fusion import Shape

    rng = np.random.default_rng(7)
    shape = Shape([3, 2], 3, 4, 5)
    flat = shape.start(1) + rng.normal(size=shape.length) * 0.3
    x, y, w = rng.normal(size=(6, 5)), rng.integers(0, 3, 6), rng.random(6) + 0.5
    x[0, 3:] = 0
    seen = np.array([[3, 0], [3, 2], [2, 2], [1, 1], [3, 2], [3, 2]], float)
    _, g = shape.gradient(flat, x, seen, y, w)
    for i in rng.choice(shape.length, 40, replace=False):
        step = np.zeros(shape.length)
        step[i] = 1e-6
        want = (shape.gradient(flat + step, x, seen, y, w)[0] - shape.gradient(flat - step, x, seen, y, w)[0]) / 2e-6
        assert g[i] == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("part", [4096, 60])
def test_fusion_learns_what_only_both_modalities_tell(spark, monkeypatch, part):
    from modalens.operators import fusion

    monkeypatch.setattr(fusion, "PART_ROWS", part)
    rng = np.random.default_rng(8)
    a, b = rng.choice([-1.0, 1.0], (2, 240))
    y = (a * b > 0).astype(int)
    noise = rng.normal(size=(240, 4)) * 0.2
    columns = {("one", "f0"): a + noise[:, 0], ("one", "f1"): a + noise[:, 1], ("two", "g0"): b + noise[:, 2], ("two", "g1"): b + noise[:, 3]}
    rows = [(f"s{i:03d}", m, f, float(v[i])) for (m, f), v in columns.items() for i in range(240) if not (f == "g1" and i % 7 == 0) and i != 5]
    cells = spark.createDataFrame(rows, "sample_id string, modality string, feature string, value double")
    samples = spark.createDataFrame([(f"s{i:03d}", int(y[i])) for i in range(240)], "sample_id string, y int")
    folds = spark.createDataFrame([(f"s{i:03d}", i % 2) for i in range(240)], "sample_id string, outer_fold int")
    out = fusion.intermediate_fusion(cells, samples, folds, rounds=3).toPandas()
    assert sorted(out.sample_id) == [f"s{i:03d}" for i in range(240)] and (out.pred == out.y).mean() > 0.9
    assert all(abs(sum(p) - 1) < 1e-9 for p in out.probs)
    again = fusion.intermediate_fusion(cells.repartition(5), samples, folds, rounds=3).toPandas()
    assert (again.sort_values("sample_id").pred.to_numpy() == out.sort_values("sample_id").pred.to_numpy()).mean() > 0.98


def test_a_forest_is_fitted_in_parts(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(models, "PART_NODES", 4 * 64)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 3))
    table = [(f"s{i}", 0, float(x[i, 0] + x[i, 1] > 0) + float(x[i, 2] > 1), 1.0, x[i].tolist()) for i in range(120)]
    rows = spark.createDataFrame(table, "sample_id string, outer_fold int, y double, w double, x array<double>").withColumn("x", array_to_vector("x")).coalesce(1)
    seen, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, data: seen.append((self.getNumTrees(), self.getSeed())) or fit(self, data))
    got = {r.sample_id: r for r in models._predicted(models.forest(120, trees=10, depth=5), rows, rows).collect()}
    assert seen == [(4, 1), (4, 2), (2, 3)]
    want = np.zeros((120, 3))
    for trees, seed in seen:
        model = fit(RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=trees, maxDepth=5, seed=seed), rows)
        want += np.array([r.rawPrediction.toArray() for r in model.transform(rows).collect()]) / 10
    assert np.allclose([got[f"s{i}"].probability.toArray() for i in range(120)], want) and [got[f"s{i}"].prediction for i in range(120)] == want.argmax(1).tolist()
