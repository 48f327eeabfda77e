"""The whole audit of a small landed study, and ranges of large keys."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalens import audit
from modalens.functions import rank
from modalens.operators import align, ledger, missingness, models, splits
from modalens.sources import matrix


def test_audit_from_landed_files_to_verdicts(spark, tmp_path):
    rng = np.random.default_rng(12)
    y = np.array([i // 4 % 2 for i in range(160)])
    tables = {"good": rng.normal(size=(160, 3)) + 1.5 * y[:, None], "noise": rng.normal(size=(160, 3))}
    rows = [(f"s{i:03d}", m, f"f{j}", float(v)) for m, x in tables.items() for (i, j), v in np.ndenumerate(x) if not (m == "noise" and j == 0 and y[i] and i % 3)]
    cells = spark.createDataFrame([*rows, ("stranger", "good", "f0", 1.0)], "sample_id string, modality string, feature string, value double")
    samples = spark.createDataFrame([(f"s{i:03d}", int(y[i]), f"g{i // 4}", f"b{i % 2}") for i in range(160)] + [("s999", None, "g0", "b0")], "sample_id string, y int, group_id string, batch string")
    matrix.write_dataset(cells, samples, str(tmp_path / "study"))
    done = audit.audit_files(spark, str(tmp_path / "study"), str(tmp_path / "out"), folds=3, reps=100, dims=2)
    said = {r.modality: r for r in done.verdicts.collect()}
    assert said["good"].alone > 0.8 and said["good"].verdict.startswith(("predictive", "informative")) and said["noise"].verdict == "no detectable signal (control-like)"
    assert said["good"].place == 1 and not said["good"].structured and said["good"].gain > 0.2
    scores = {r.model: r.score for r in done.scores.collect()}
    assert set(scores) == {"linear::good", "linear::noise", "linear::FUSION", "linear::FUSION-minus-good", "linear::FUSION-minus-noise", "control::shuffled-target", "control::shuffled-features", "control::noise"}
    controls = {r.name: r for r in done.controls.collect()}
    assert not any(r.leak for r in controls.values()) and all(r.ci_low < r.score < r.ci_high for r in controls.values())
    warned = {(r.modality, r.against): r.p_bh for r in done.missingness.collect()}
    assert warned["noise", "y"] < 0.01 and ("good", "y") not in warned or warned["good", "y"] is None or warned["good", "y"] > 0.05
    status = {r.check: r.status for r in done.checklist.collect()}
    assert status["no target-linked missingness"] == "caution" and status["controls at chance"] == "pass" and status["independent subjects"] == "pass"
    assert done.rating.first().rating == "moderate concerns" and done.support.filter("side = 'assessment'").agg(F.sum("n")).first()[0] == 160
    assert done.fingerprint.first().n_samples == 160
    left = os.listdir(tmp_path / "out")
    assert "verdicts" in left and "predictions" not in left and "folds" not in left


def test_optimism_of_a_signal_that_batches_carry(spark):
    """Columns that name the batch, which goes with the class: good under mixed folds, constant in training where the batch is new."""
    rng = np.random.default_rng(6)
    batch, y = np.arange(120) % 6, (np.arange(120) % 6 % 2 + (rng.uniform(size=120) < 0.15)) % 2
    rows = [(f"s{i}", "m", f"f{b}", float(batch[i] == b)) for i in range(120) for b in range(6)]
    cells = spark.createDataFrame(rows, "sample_id string, modality string, feature string, value double")
    samples = spark.createDataFrame([(f"s{i}", int(y[i]), f"g{i}", f"b{batch[i]}") for i in range(120)] + [("none", 1, "g", None)], "sample_id string, y int, group_id string, batch string")
    stress = models.batch_blocked(cells, samples, 6)
    seen = stress.join(samples.select("sample_id", "batch"), "sample_id").groupBy("outer_fold").agg(F.countDistinct("batch").alias("b")).collect()
    assert [r.b for r in seen] == [1] * 6 and stress.count() == 120
    mixed = models.out_of_fold(cells, samples.filter("batch IS NOT NULL"), splits.grouped(samples, 3, "y"), model="linear::FUSION")
    r = audit.optimism(audit.class_scores(mixed, ["model"]), stress).first()
    assert r.standard > 0.75 and r.blocked < 0.5 and r.optimism_gap == pytest.approx(r.standard - r.blocked)


@pytest.mark.parametrize("size", [200_000, 7])
def test_ranges_of_large_keys_change_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(rank, "RANGE_ROWS", size)
    rng = np.random.default_rng(2)
    data = [("big", float(v)) for v in rng.integers(0, 50, 300)] + [("wide", float(v)) for v in rng.integers(10**6, 2 * 10**6, 60)] + [("small", 1.0)] * 3
    table = spark.createDataFrame(data, "k string, v double")
    got = {(r.k, r.v): r["rank"] for r in rank.average_ranks(table, ["k"], "v").collect()}
    for k in ("big", "wide", "small"):
        own = np.array([v for name, v in data if name == k])
        assert all(got[k, v] == (own < v).sum() + ((own == v).sum() + 1) / 2 for v in own)
    whole = {r.v: r["rank"] for r in rank.average_ranks(table.withColumn("all", F.lit(0)), ["all"], "v").collect()}
    every = np.array([v for _, v in data])
    assert all(whole[v] == (every < v).sum() + ((every == v).sum() + 1) / 2 for v in every)


@pytest.mark.parametrize("size", [200_000, 9])
def test_adjusted_p_of_large_families(spark, monkeypatch, size):
    monkeypatch.setattr(rank, "RANGE_ROWS", size)
    rng = np.random.default_rng(3)
    p = np.round(rng.random(120) ** 2, 2)
    rows = [("f", f"t{i}", float(v)) for i, v in enumerate(p)] + [("f", "none", None), ("g", "one", 0.2)]
    got = {r.test: r for r in missingness.adjusted(spark.createDataFrame(rows, "family string, test string, p double"), ["family"]).collect()}
    order, m = np.argsort(p, kind="stable"), len(p)
    s, i = p[order], np.arange(1, m + 1)
    bh = np.minimum(1, np.minimum.accumulate((s * m / i)[::-1])[::-1])
    by = np.minimum(1, np.minimum.accumulate((s * m / i * (1 / i).sum())[::-1])[::-1])
    holm = np.minimum(1, np.maximum.accumulate(s * (m - i + 1)))
    for place, k in enumerate(order):
        r = got[f"t{k}"]
        assert (r.p_bh, r.p_by, r.p_holm) == pytest.approx((bh[place], by[place], holm[place]), abs=1e-12)
    assert got["none"].p_bh is None and got["one"].p_holm == pytest.approx(0.2) and len(got) == 122


@pytest.mark.parametrize("n", [1, 40, 400])
def test_concordance_equals_all_pairs(spark, n):
    from modalens.operators.metrics import concordance

    rng = np.random.default_rng(n)
    t, e, r = rng.integers(1, max(2, n), n), rng.random(n) < 0.6, rng.integers(0, 30, n)
    pairs = good = 0.0
    for i in range(n):
        later = t > t[i]
        if e[i]:
            pairs += later.sum()
            good += (later & (r[i] > r)).sum() + (later & (r[i] == r)).sum() / 2
    got = concordance(spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, r, strict=True)], "time double, event int, risk double")).first()
    assert got.pairs == pairs and got.c_index == pytest.approx(good / pairs if pairs else 0.5)


def test_alignment_by_samples_equals_that_by_features(spark):
    from modalens.operators import ledger

    rng = np.random.default_rng(4)
    x = {"a": rng.normal(size=(12, 20)), "c": rng.normal(size=(12, 6))}
    x["b"] = x["a"][:, :9] + rng.normal(size=(12, 9)) * 0.3
    rows = [(f"s{i}", m, f"f{j}", float(v)) for m, t in x.items() for (i, j), v in np.ndenumerate(t) if (i * j) % 11 != 3]
    cells = spark.createDataFrame(rows, "sample_id string, modality string, feature string, value double")
    one, two = ({(r.modality_a, r.modality_b): r.cka for r in f(cells).collect()} for f in (ledger._aligned_samples, ledger._aligned_features))
    assert one.keys() == two.keys() == {("a", "b"), ("a", "c"), ("b", "c")} and all(one[k] == pytest.approx(two[k]) for k in one)
    assert {(r.modality_a, r.modality_b): r.cka for r in ledger.cka(cells).collect()} == pytest.approx(one)


def test_alignment_by_products_of_features_in_tasks(spark):
    rng = np.random.default_rng(9)
    rows = [(f"s{i}", f"m{j % 3}", f"f{j}", float(rng.normal() + i % (j + 2))) for i in range(70) for j in range(9) if rng.random() > 0.1]
    z = ledger._scaled(spark.createDataFrame(rows, "sample_id string, modality string, feature string, value double"))
    pairs = ledger._aligned_wide(z.select("sample_id", F.concat_ws("\u0001", "modality", "feature").alias("feature"), "z"))
    cells = spark.createDataFrame(rows, "sample_id string, modality string, feature string, value double")
    one, two = ({(r.modality_a, r.modality_b): r.cka for r in t.collect()} for t in (pairs, ledger._aligned_features(cells)))
    assert len(two) == 3 and two == pytest.approx(one)


def test_outstanding_keys_by_one_aggregation(spark):
    t = lambda *ks: spark.createDataFrame([(k, "x") for k in ks], "k long, v string")
    out = align.outstanding(t(1, 2, 3, 4, None).select("k"), t(1, 1, 5, 5, None), t(2, 6, None), ["k"])
    assert sorted((r.k or 0, r.problem) for r in out.collect()) == [(0, "missing"), (0, "unexpected"), (3, "missing"), (4, "missing"), (5, "unexpected")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
