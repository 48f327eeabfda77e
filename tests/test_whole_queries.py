"""Registered queries that do the operators' whole job, held against brute force."""

import numpy as np
import pandas as pd
import pytest

from modalens.operators import batch, bootstrap, ledger, metrics, models, projection
from modalens.plans import registry
from modalens.sources import adapters as A

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: registry.queries()[name](spark, SF)


def test_batch_tests_of_every_feature(spark, run):
    study = A.events_day(spark, SF)
    rows = study.cells.join(study.samples, "sample_id").toPandas()
    one, two = ({r.feature: r for r in run(name).collect()} for name in ("b4_batch_anova", "b5_batch_kruskal"))
    assert set(one) == set(two) == set(rows.feature)
    for feature, part in rows.groupby("feature"):
        x, ranks = part.value.to_numpy(), part.value.rank().to_numpy()
        groups = [np.flatnonzero(part.batch == g) for g in part.batch.unique()]
        n, k = len(x), len(groups)
        between = sum(len(g) * (x[g].mean() - x.mean()) ** 2 for g in groups)
        total = ((x - x.mean()) ** 2).sum()
        assert one[feature].f == pytest.approx(between / (k - 1) / ((total - between) / (n - k)), abs=1e-4) and one[feature].eta2 == pytest.approx(between / total, abs=1e-6)
        h = 12 / (n * (n + 1)) * sum(ranks[g].sum() ** 2 / len(g) for g in groups) - 3 * (n + 1)
        ties = part.value.value_counts().to_numpy().astype(float)
        assert two[feature].h == pytest.approx(h / (1 - (ties**3 - ties).sum() / (n**3 - n)), abs=1e-5) and two[feature].n == n


def test_centring_of_every_feature(spark, run):
    out = run("b9_batch_centring").toPandas()
    assert out.feature.nunique() == 64 and set(out.modality) == {"emb_lo", "emb_hi"}
    study = A.embeddings(spark, SF)
    cells = study.cells.join(study.samples, "sample_id").toPandas()
    cells["fold"] = cells.sample_id.astype(int) // 7 % 5
    for feature in ("d03", "d60"):
        own = cells[cells.feature == feature]
        for fold in range(5):
            train = own[own.fold != fold]
            offset = train.groupby("batch").value.mean() - train.value.mean()
            want = (own.value - own.batch.map(offset).fillna(0)).round(6).to_numpy()
            got = out[(out.feature == feature) & (out.outer_fold == fold)].set_index("sample_id").value.loc[own.sample_id].to_numpy()
            assert np.allclose(got, want, atol=2e-6)


def test_silhouette_of_all_dimensions(spark, run):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding", "label").collect()
    x, y = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    s = []
    for i in range(len(x)):
        means = {g: d[i, y == g].sum() / ((y == g).sum() - (g == y[i])) for g in set(y) if g != y[i] or (y == g).sum() > 1}
        a, b = means.get(y[i]), min(v for g, v in means.items() if g != y[i])
        s.append(0 if a is None else (b - a) / max(a, b))
    got = run("b3_silhouette_dimensions").first()
    assert got.n == len(x) and abs(got.silhouette - np.mean(s)) < 2e-5


def test_flagship_reads_files_instead_of_cached_partitions(run):
    out = run("missingness_audit")
    assert "InMemoryRelation" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.test for r in out.collect()} == {"activity:y", "activity:batch"}


def _brute_silhouette(x, y):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        means = {g: d[i, y == g].sum() / ((y == g).sum() - (g == y[i])) for g in set(y) if g != y[i] or (y == g).sum() > 1}
        a, b = means.get(y[i]), min(v for g, v in means.items() if g != y[i])
        s.append(0 if a is None else (b - a) / max(a, b))
    return np.mean(s)


def test_silhouette_of_copies_near_copies_and_far_points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 5)) + 1e4
    x[100:200] = x[:100]  # equal points, partly of another label
    x[200:300] = x[:100] + rng.normal(size=(100, 5)) * 1e-7
    x[-1] = 1e9
    y = np.array([f"g{i % 3}" for i in range(599)] + ["alone"])
    rows = [("a", str(i), v.tolist(), g) for i, (v, g) in enumerate(zip(x, y, strict=True))] + [("b", "0", [0.0], "g1"), ("b", "1", [1.0], "g1")]
    got = {r.m: r for r in batch.silhouette(spark.createDataFrame(rows, "m string, sample_id string, coordinates array<double>, y string"), "y", ["m"]).collect()}
    assert got["a"].n == 600 and abs(got["a"].silhouette - _brute_silhouette(x, y)) < 1e-9
    assert got["b"].n == 2 and got["b"].silhouette is None


def test_distances_of_two_blocks_by_label():
    rng = np.random.default_rng(6)
    parts = [pd.DataFrame({"k": 0, "_b": b, "_code": rng.integers(0, 4, n), "_w": rng.integers(1, 4, n), "coordinates": rng.normal(size=(n, 3)).tolist()}) for b, n in ((2, 1500), (5, 1100))]
    blocks = pd.concat([batch._chunks(p, ["k"]) for p in parts])
    got = batch._distances(blocks.assign(_lo=2, _hi=5), ["k"], 4)
    assert len(got) == 4  # a row per chunk, none per point or pair
    one, two = (p.sort_values("_code", kind="stable") for p in parts)
    x, z = np.array(one.coordinates.tolist()), np.array(two.coordinates.tolist())
    d = np.sqrt(((x[:, None] - z[None]) ** 2).sum(-1))
    for b, dist, other in ((2, d, two), (5, d.T, one)):
        sums = np.concatenate([np.frombuffer(s) for s in got[got._b == b].sums]).reshape(len(dist), 4)
        assert np.allclose(sums, np.stack([dist[:, other._code == c] @ other._w[other._code == c] for c in range(4)], 1))


def test_components_equal_the_eigenvectors_of_the_correlations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6))
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [(f"s{i}", "m", f"f{j}", float(x[i, j])) for i in range(60) for j in range(6) if not np.isnan(x[i, j])]
    points, explained = projection.components(spark.createDataFrame(rows, "sample_id string, modality string, feature string, value double"), k=3)
    full = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    z = (full - full.mean(0)) / full.std(0)
    values, axes = np.linalg.eigh(z.T @ z)
    axes, values = axes[:, ::-1][:, :3], values[::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(3)])
    got = {r.sample_id: r.coordinates for r in points.collect()}
    assert np.allclose([got[f"s{i}"] for i in range(60)], z @ axes, atol=1e-6)
    assert np.allclose([r.explained for r in explained.orderBy("component").collect()], (values / values.sum())[:3])


def test_auroc_replicates_equal_weighted_scores(spark):
    rng = np.random.default_rng(6)
    rows = [("a" if i % 2 else "b", f"g{rng.integers(0, 12)}", int(rng.integers(0, 2)), float(rng.integers(0, 15)) / 15) for i in range(400)]
    pred = spark.createDataFrame(rows, "model string, group_id string, y int, score double")
    drawn = {(r.rep, r.group_id): r.w for r in bootstrap.group_weights(pred, 30, 3).collect()}
    got = {(r.model, r.rep): r.auroc for r in bootstrap.auroc_replicates(pred, bootstrap.group_vectors(pred, 30, 3, "group_id"), ["model"], 30, ranges=4).collect()}
    for model in "ab":
        for rep in range(30):
            own = [(s, y, drawn.get((rep, g), 0)) for m, g, y, s in rows if m == model]
            p, q = [(s, w) for s, y, w in own if y], [(s, w) for s, y, w in own if not y]
            u = sum(w * v * ((s > t) + (s == t) / 2) for s, w in p for t, v in q)
            assert abs(got[model, rep] - u / (sum(w for _, w in p) * sum(w for _, w in q))) < 1e-9


def test_ridge_equals_its_closed_form(spark):
    rng = np.random.default_rng(9)
    x, n = rng.normal(size=(90, 3)), 90
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=n)
    rows = [(f"s{i}", "m", f"f{j}", float(x[i, j])) for i in range(n) for j in range(3)]
    cells = spark.createDataFrame(rows, "sample_id string, modality string, feature string, value double")
    samples = spark.createDataFrame([(f"s{i}", float(y[i])) for i in range(n)], "sample_id string, y double")
    folds = spark.createDataFrame([(f"s{i}", i % 3) for i in range(n)], "sample_id string, outer_fold int")
    got = {r.sample_id: r.score for r in models.out_of_fold_regression(cells, samples, folds).collect()}
    for k in range(3):
        t, v = np.arange(n) % 3 != k, np.arange(n) % 3 == k
        z = (x - x[t].mean(0)) / x[t].std(0)
        w = np.linalg.solve(z[t].T @ z[t] + np.eye(3), z[t].T @ (y[t] - y[t].mean()))
        assert np.allclose([got[f"s{i}"] for i in np.flatnonzero(v)], z[v] @ w + y[t].mean(), atol=1e-6)


def test_shuffled_features_move_and_masks_take_their_share(spark):
    cells = spark.createDataFrame([(f"s{i}", "m", f"f{j}", float(i)) for i in range(200) for j in range(4)], "sample_id string, modality string, feature string, value double")
    samples = spark.createDataFrame([(f"s{i}", f"b{i % 4}") for i in range(200)], "sample_id string, batch string")
    moved = {(r.feature, r.sample_id): r.value for r in models.shuffled_features(cells, samples).collect()}
    assert len(moved) == 800 and sum(int(s[1:]) == v for (_, s), v in moved.items()) < 80
    assert len({tuple(moved[f"f{j}", f"s{i}"] for i in range(200)) for j in range(4)}) > 1
    for mechanism in ("mcar", "mar", "mnar", "batch", "sample"):
        left = models.masked(cells, 0.2, mechanism=mechanism, samples=samples)
        assert 0.6 < left.count() / 800 < 0.98
    assert models.masked(cells, 0.3, mechanism="mnar").agg({"value": "avg"}).first()[0] < 90


def test_verdicts_of_one_modality(spark):
    t = spark.createDataFrame([("a", True, True, 0.9), ("b", False, True, 0.9), ("c", False, True, 0.52)], "modality string, structured boolean, confounded boolean, alone double")
    got = {r.modality: r.verdict for r in ledger.verdicts(t, single=True).collect()}
    assert got == {"a": "batch-confounded", "b": "predictive (standalone)", "c": "no detectable signal (near chance)"}


def test_auroc_reads_predictions_once(spark, tmp_path):
    rng = np.random.default_rng(2)
    score, y = rng.integers(0, 9, 400) / 8, rng.integers(0, 2, 400)
    spark.createDataFrame([("a", int(t), float(s)) for t, s in zip(y, score, strict=True)] + [("a", 1, None), ("b", 1, 0.5)], "model string, y int, score double").write.parquet(str(tmp_path / "p"))
    out = metrics.auroc(spark.read.parquet(str(tmp_path / "p")), ["model"])
    assert str(tmp_path) not in "".join(out.inputFiles())  # only counts are left to read
    u = np.mean([(s > t) + (s == t) / 2 for s in score[y == 1] for t in score[y == 0]])
    got = {r.model: r for r in out.collect()}
    p, q = int(y.sum()) + 1, int((1 - y).sum())  # a truth without a score counts, its rank doesn't
    ranks = u * (p - 1) * q + (p - 1) * p / 2
    assert (got["a"].n, got["a"].n_pos) == (401, p) and got["a"].auroc == pytest.approx((ranks - p * (p + 1) / 2) / (p * q)) and got["b"].auroc is None
