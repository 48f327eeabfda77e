import numpy as np
import pytest
from pyspark.sql import functions as F

from modalens.operators import align, clean, groups, ledger, metrics, models, rows, survival
from modalens.sources import matrix


def test_empty_match_keeps_the_id(spark):
    r = spark.createDataFrame([("tcga-1-01A-11R-1234-07",), ("tcga-1-01a",), (" tcga-1 ",), (None,)], "s string").withColumn("o", clean.normalized(F.col("s"), **clean.PRESETS["tcga"]))
    assert [x.o for x in r.select("o").collect()] == ["TCGA-1", "TCGA-1-01A", "TCGA-1", None]  # patterns come before the case


def test_records_of_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "1"}\n\n{"k": \n[{"k": "2"}]\n7\n{"other": 1}\n', encoding="utf-8")
    records, problems = matrix.scan_records(spark, {"jsonl": str(tmp_path / "a.jsonl")}, ["k"])
    assert sorted(str(r.k) for r in records.collect()) == ["1", "None"]
    assert sorted((r.line, r.problem) for r in problems.collect()) == [("7", "row is not an object"), ("[{\"k\": \"2\"}]", "row is not an object"), ('{"k": ', "invalid JSON")]


def test_raw_counts_without_names(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Gene ID\ts1\ts2\ng1\t1\t2\n", encoding="utf-8")
    cells, symbols = matrix.raw_counts(spark, str(tmp_path / "m.tsv"), "m")
    assert sorted((r.sample_id, r.feature, r.value) for r in cells.collect()) == [("s1", "g1", 1.0), ("s2", "g1", 2.0)]
    assert symbols.count() == 0


def test_failures_are_counted_where_they_belong(spark):
    index = spark.createDataFrame([("a", "x"), ("b", "y")], "dataset_id string, scenario string")
    done = spark.createDataFrame([("a", "m"), ("a", "m"), ("z", "m")], "dataset_id string, method_id string")
    failed = spark.createDataFrame([("a", "m"), ("b", "m")], "dataset_id string, method_id string")
    out = align.attempts(done, failed, index, ["method_id"], ["scenario"])
    assert sorted((r.scenario, r.scored, r.failed, r.attempted) for r in out.collect()) == [("x", 2, 1, 3), ("y", 0, 1, 1)]


def test_families_equal_holm(spark):
    t = spark.createDataFrame([("f", "a", 0.02), ("f", "b", 0.5), ("f", "c", None), ("g", "a", None)], "family string, test string, p double")
    out = {r.family: r for r in groups.families(t).collect()}
    assert out["f"].min_p_holm == pytest.approx(0.04) and out["f"].warning and out["f"].n_tests == 2
    assert out["g"].min_p_holm is None and not out["g"].warning


def test_checklist_of_an_ungrouped_study(spark):
    samples = spark.createDataFrame([(str(i), "a" if i else "b", None) for i in range(10)], "sample_id string, y string, g string")
    none = lambda c: spark.createDataFrame([], f"{c} boolean")
    out = {r.check: r.status for r in ledger.checklist(samples, spark.createDataFrame([(True,)], "leak boolean"), none("batch_confounded"), none("flag"), "g", "y").collect()}
    assert out == {
        "controls at chance": "fail", "independent subjects": "caution", "sample size": "caution", "balanced classes": "caution", "no batch confounding": "pass", "no target-linked missingness": "pass",
    }


def test_audit_summary_bases(spark):
    schema = "k string, alarm boolean, leak boolean, false_certification boolean, false_alarm boolean, role_f1 double, controls array<double>"
    r = spark.createDataFrame([("a", True, True, True, False, 0.5, [0.4, 0.6]), ("a", False, False, False, None, None, []), ("b", None, None, None, None, None, None)], schema)
    (a,) = rows.audit_summary(r, ["k"]).collect()
    assert (a.k, a.datasets, a.alarms, a.certification_base, a.alarm_base, a.mean_role_f1) == ("a", 2, 1, 2, 0, 0.5)
    assert a.mean_control == pytest.approx(0.5)


def test_calibration_line_equals_newton(spark):
    rng = np.random.default_rng(3)
    score = rng.uniform(0.02, 0.98, 600)
    y = (rng.uniform(size=600) < 1 / (1 + np.exp(-(0.4 + 0.6 * np.log(score / (1 - score)))))).astype(int)
    t = spark.createDataFrame([("m", float(s), int(v)) for s, v in zip(score, y, strict=True)] + [("few", 0.5, 1), ("few", None, 0)], "model string, score double, y int")
    out = {r.model: r for r in metrics.calibration_line(t, ["model"]).collect()}
    x = np.log(score / (1 - score))

    def fit(cols, offset):
        b = np.zeros(cols.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-(cols @ b + offset)))
            b = b + np.linalg.solve(cols.T @ (cols * (p * (1 - p))[:, None]), cols.T @ (y - p))
        return b

    assert out["m"].slope == pytest.approx(fit(np.c_[np.ones(600), x], 0)[1], abs=1e-6)
    assert out["m"].intercept == pytest.approx(fit(np.ones((600, 1)), x)[0], abs=1e-6)
    assert out["few"].slope is None and out["few"].intercept is None


def survivors(n=60, seed=5):
    rng = np.random.default_rng(seed)
    return [(str(i), float(rng.integers(1, 9)), int(rng.uniform() < 0.6), "abc"[int(rng.integers(0, 3))], [float(v) for v in rng.normal(size=2)]) for i in range(n)]


def score(rows):
    names = sorted({r[3] for r in rows})
    o, v = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for t in {r[1] for r in rows if r[2]}:
        n = np.array([sum(r[1] >= t and r[3] == b for r in rows) for b in names], float)
        d = np.array([sum(r[1] == t and r[2] and r[3] == b for r in rows) for b in names], float)
        if n.sum() <= 1:
            continue
        p = n / n.sum()
        o += d - d.sum() * p
        v += d.sum() * (n.sum() - d.sum()) / (n.sum() - 1) * (np.diag(p) - np.outer(p, p))
    return o @ np.linalg.pinv(v, rcond=1e-12) @ o


def test_log_rank_score(spark):
    data = survivors()
    t = spark.createDataFrame([r[:4] for r in data], "group_id string, time double, event int, batch string")
    out = {r.process: r for r in survival.batch_association(t, reps=19).collect()}
    assert out["event"].statistic == pytest.approx(score(data))
    assert out["censoring"].statistic == pytest.approx(score([(r[0], r[1], 1 - r[2], r[3]) for r in data]))
    assert all(0.05 <= r.p <= 1 and r.reps == 19 for r in out.values())


def test_cox_equals_the_whole_likelihood(spark):
    data = survivors()
    t = spark.createDataFrame([(r[1], r[2], r[4]) for r in data], "time double, event int, x array<double>")
    beta = survival.cox(t, l2=0.5)
    time, event, x = np.array([r[1] for r in data]), np.array([r[2] for r in data]), np.array([r[4] for r in data])
    slope = 2 * 0.5 * beta
    for i in np.flatnonzero(event):
        risk = time >= time[i]
        w = np.exp(x[risk] @ beta)
        slope = slope - x[i] + w @ x[risk] / w.sum()
    assert np.abs(slope).max() < 1e-4
    assert np.abs(survival.cox(t.withColumn("event", F.lit(0)))).max() == 0


def slope_at(beta, time, event, x, l2):
    out = 2 * l2 * beta
    for i in np.flatnonzero(event):
        risk = time >= time[i]
        w = np.exp(x[risk] @ beta)
        out = out - x[i] + w @ x[risk] / w.sum()
    return out


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_cox_jobs_of_unlike_width_step_together(spark, monkeypatch, broadcast):
    """Jobs of 3 and 40 coefficients, times cut into ranges, a third of all rows at one time; one job without events."""
    monkeypatch.setattr("modalens.functions.rank.RANGE_ROWS", 7)
    monkeypatch.setattr(survival, "BROADCAST_TIMES", broadcast)
    rng = np.random.default_rng(8)
    data = {}
    for job, n, d in (("narrow", 80, 3), ("wide", 120, 40), ("none", 10, 2)):
        time = np.where(rng.uniform(size=n) < 0.35, 25.0, rng.integers(1, 50, n).astype(float))
        data[job] = (time, (rng.uniform(size=n) < (0 if job == "none" else 0.6)).astype(int), rng.normal(size=(n, d)))
    rows = [(job, float(t), int(e), v.tolist()) for job, (time, event, x) in data.items() for t, e, v in zip(time, event, x, strict=True)]
    fitted = survival.cox_fits(spark.createDataFrame(rows, "job string, time double, event int, x array<double>"), l2=1.0)
    for job in ("narrow", "wide"):
        assert np.abs(slope_at(fitted[job], *data[job], 1.0)).max() < 1e-3
    assert np.abs(fitted["none"]).max() == 0 and {k: len(v) for k, v in fitted.items()} == {"narrow": 3, "wide": 40, "none": 2}


def test_components_of_a_training_side(spark, monkeypatch):
    """By either side's products: a quarter of the training rows, equal to singular vectors but for their signs."""
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 50)) * np.linspace(3, 0.5, 50)
    x[:20] -= x[:20].mean(axis=0)
    rows = [(str(i), "train" if i < 20 else "assessment", float(i), 1, Vectors.dense(v.tolist())) for i, v in enumerate(x)]
    t = spark.createDataFrame(rows, ["sample_id", "side", "time", "event", "x"])
    want = x @ np.linalg.svd(x[:20], full_matrices=False)[2][:5].T
    for small in (4096, 40):
        monkeypatch.setattr(survival, "SMALL", small)
        got = {int(r.sample_id): np.array(r.x) for r in survival.fold_components(t).collect()}
        out = np.array([got[i] for i in range(30)])
        assert out.shape == (30, 5)
        np.testing.assert_allclose(np.abs(out), np.abs(want), atol=1e-8)
        assert len(survival.fold_components(t, k=2).first().x) == 2
    monkeypatch.setattr(survival, "SMALL", 25)
    with pytest.raises(ValueError, match="select columns"):
        survival.fold_components(t)


def test_batch_adjusted_is_refused(spark):
    with pytest.raises(ValueError, match="outcome"):
        models.batch_adjusted(None, None, None, confounded=True)
