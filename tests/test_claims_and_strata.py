"""Feature associations, claims, subgroup scores, controls, copies of survival targets, previews and the entry's guard."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalens.operators import bootstrap, groups, models, profile, rows


def ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def kruskal(x, labels):
    r, n = ranks(x), len(x)
    if np.ptp(x) == 0:
        return 0.0
    h = 12 / (n * (n + 1)) * sum(r[labels == c].sum() ** 2 / (labels == c).sum() for c in np.unique(labels)) - 3 * (n + 1)
    ties = np.unique(x, return_counts=True)[1].astype(float)
    return h / (1 - (ties**3 - ties).sum() / (n**3 - n))


@pytest.fixture(scope="module")
def profiles(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.random((30, 4)), 1)
    x[:, 3] = 0.5
    y = np.round(x[:, 0] + rng.random(30) * 0.3, 1)
    cls = np.array(["abc"[i % 3] for i in range(30)])
    table = spark.createDataFrame([(f"g{i:02d}", "m", f"f{j}", float(x[i, j])) for i in range(30) for j in range(4)], "group_id string, modality string, feature string, missing double").cache()
    target = spark.createDataFrame([(f"g{i:02d}", float(y[i]), str(cls[i])) for i in range(30)], "group_id string, rate double, site string").cache()
    return x, y, cls, table, target


@pytest.mark.parametrize("kind", ["continuous", "categorical"])
def test_feature_associations_equal_plain_statistics(spark, profiles, monkeypatch, kind):
    x, y, cls, table, target = profiles
    monkeypatch.setattr(groups, "FEATURES", 2)
    monkeypatch.setattr(groups, "GROUPS", 11)
    got = {r.feature: r for r in groups.feature_association(table, target, "rate" if kind == "continuous" else "site", reps=99, kind=kind).collect()}
    for j in range(4):
        if kind == "continuous":
            want = 0.0 if j == 3 else abs(np.corrcoef(ranks(x[:, j]), ranks(y))[0, 1])
        else:
            want = kruskal(x[:, j], cls)
        assert got[f"f{j}"].observed == pytest.approx(want, abs=1e-9)
    assert got["f3"].p == got["f3"].p_max == 1.0 and all(r.p <= r.p_max for r in got.values())
    assert (got["f0"].p == pytest.approx(0.01)) == (kind == "continuous")


def test_association_replicates_permute_whole_groups(spark, profiles, monkeypatch):
    """Statistics of every replicate, from the labels that `permuted` gives."""
    x, y, _, table, target = profiles
    ranked = spark.createDataFrame([(f"g{i:02d}", float(r)) for i, r in enumerate(ranks(y))], "group_id string, _y double")
    moved = groups.permuted(ranked, ["_y"], 19).toPandas()
    want = [0] * 3
    for j in range(3):
        seen = abs(np.corrcoef(ranks(x[:, j]), ranks(y))[0, 1])
        null = [abs(np.corrcoef(ranks(x[:, j]), part.sort_values("group_id")._y)[0, 1]) for _, part in moved.groupby("rep")]
        want[j] = (1 + sum(v >= seen - 1e-12 for v in null)) / 20
    got = {r.feature: r.p for r in groups.feature_association(table, target, "rate", reps=19).collect()}
    assert [got[f"f{j}"] for j in range(3)] == pytest.approx(want)
    with pytest.raises(ValueError, match="two values"):
        groups.feature_association(table, target.withColumn("rate", F.lit(1.0)), "rate", reps=3)


def test_secondary_tests_never_decide_a_claim(spark):
    tests = spark.createDataFrame(
        [("a", "m", "x", "primary", 0.04), ("a", "n", "x", "primary", 0.03), ("a", "m", "y", "secondary", 1e-9), ("b", "m", "x", "primary", 0.01), ("b", "n", "x", "primary", 0.02), ("c", "m", "x", "primary", None), ("d", "m", "x", "primary", 0.5)],
        "claim string, modality string, method string, evidence string, p double",
    )
    expected = spark.createDataFrame([("a", "m", 1), ("a", "n", 1), ("b", "m", 1), ("b", "n", 1), ("c", "m", 1), ("d", "m", 2), ("e", "m", 1)], "claim string, modality string, n long")
    got = {r.claim: r for r in groups.claims(tests, expected).collect()}
    assert (got["a"].status, got["a"].warnings, got["a"].any_warning, got["a"].n_secondary) == ("tested", 0, False, 1) and got["a"].min_holm == pytest.approx(0.06)
    assert (got["b"].warnings, got["b"].any_warning) == (2, True)
    assert [got[c].status for c in "cde"] == ["refused"] * 3 and got["d"].min_holm is None


def test_subgroups_are_scored_and_their_gap_is_drawn_jointly(spark):
    rng = np.random.default_rng(5)
    data = []
    for stratum, n, shift in (("a", 120, 2.0), ("b", 120, 0.3), ("c", 12, 1.0), ("d", 40, 0.0)):
        for i in range(n):
            y = i % 2 if stratum != "d" else 1
            for model in ("one", "two"):
                data.append((model, stratum, f"{stratum}{i}", y, float(y * shift + rng.normal())))
    pred = spark.createDataFrame(data, "model string, stratum string, sample_id string, y int, score double")
    strata, gap = bootstrap.subgroup_scores(pred, reps=200)
    seen = {(r.model, r.stratum): r for r in strata.collect()}
    assert len(seen) == 8 and all((seen[m, s].auroc is None) == (s in "cd") for m, s in seen)
    g = {r.model: r for r in gap.collect()}
    for m in ("one", "two"):
        assert g[m].gap == pytest.approx(seen[m, "a"].auroc - seen[m, "b"].auroc) and 0 < g[m].ci_low < g[m].gap < g[m].ci_high
        assert seen[m, "a"].ci_low < seen[m, "a"].auroc < seen[m, "a"].ci_high and g[m].usable == 200
    assert bootstrap.subgroup_scores(pred.filter("stratum IN ('a', 'c')"), reps=30)[1].count() == 0


def test_poisson_draws_have_mean_and_variance_one(spark):
    w = bootstrap.poisson_vectors(spark.range(400).select(F.col("id").cast("string").alias("u")), 300, 3, "u").collect()
    x = np.array([np.frombuffer(r.w, np.uint8) for r in w], float)
    assert x.shape == (400, 300) and abs(x.mean() - 1) < 0.02 and abs(x.var() - 1) < 0.03
    assert abs(np.corrcoef(x[0], x[1])[0, 1]) < 0.2 and np.abs(x.sum(0) - 400).max() < 5 * 20


def test_control_intervals_are_wider_with_more_controls(spark):
    rng = np.random.default_rng(1)
    data = [(f"c{k}", f"g{i}", i % 2, float(rng.normal())) for k in range(4) for i in range(80)]
    pred = spark.createDataFrame(data, "model string, group_id string, y int, score double")
    many = {r.model: r for r in bootstrap.control_intervals(pred, reps=300).collect()}
    few = {r.model: r for r in bootstrap.control_intervals(pred.filter("model = 'c0'"), reps=300).collect()}
    assert len(many) == 4 and many["c0"].ci_low < few["c0"].ci_low and few["c0"].ci_high < many["c0"].ci_high


def test_inverted_risks_follow_the_pairwise_rule(spark):
    rng = np.random.default_rng(9)
    time = rng.integers(1, 6, 12).astype(float)
    columns = {"falls": 10 - time, "rises": time, "noise": rng.normal(size=12), "flat": np.ones(12), "one_off": np.where(np.arange(12) == 3, 99.0, 10 - time), "gone": 10 - time}
    cells = [(f"s{i}", "m", c, float(v[i])) for c, v in columns.items() for i in range(12) if not (c == "gone" and i == 2)]
    samples = spark.createDataFrame([(f"s{i}", float(time[i]), int(i % 2)) for i in range(12)], "sample_id string, time double, event int")
    table = spark.createDataFrame(cells, "sample_id string, modality string, feature string, value double")

    def plain(v):
        order = lambda a, b: int(a > b) - int(a < b)
        pairs = [(order(time[i], time[j]), order(v[i], v[j])) for i in range(12) for j in range(i)]
        return len(set(v)) > 1 and all(r == -t for t, r in pairs)

    got = {r.feature: r for r in models.survival_copies(table, samples).collect()}
    assert {c: got[c].inverted for c in columns if c != "gone"} == {c: plain(v) for c, v in columns.items() if c != "gone"} and got["falls"].inverted
    assert not got["gone"].inverted and got["rises"].time_copy and not got["rises"].joint
    assert not any(r.inverted for r in models.survival_copies(table, samples, least_pairs=67).collect())


def test_gate_of_no_problems_and_of_unknown_severity(spark):
    every = spark.createDataFrame([("p",), ("q",)], "phase string")
    found = rows.findings({"late": ("warning", every.filter("phase = 'q'"))}, ["phase"])
    assert {r.phase: r.verdict for r in rows.gate(found, every).collect()} == {"p": "PASS", "q": "WARN"}
    assert rows.gate(found.drop("phase").limit(0)).first().verdict == "PASS"
    with pytest.raises(ValueError, match="severity"):
        rows.findings({"late": ("fatal", every)}, ["phase"])


def test_previews_of_odd_columns(spark):
    t = spark.createDataFrame([(str(i), f"id{i}", "NA" if i % 2 else "x", None) for i in range(20)], "n string, name string, c string, e string")
    got = {r["column"]: r for r in profile.clinical(t).collect()}
    assert {c: got[c].looks_like_id for c in ("n", "name", "c")} == {"n": False, "name": True, "c": False} and not got["e"].looks_like_id
    one = lambda c: profile.target_preview(t, c).first()
    assert (one("n").task, one("n").ok, one("n").low, one("n").high) == ("regression", True, 0.0, 19.0)
    assert (one("c").task, one("c").ok, one("c").n_missing) == ("classification", False, 10) and one("e").ok is False and one("name").balanced


def test_entry_without_the_tokenizers(tmp_path):
    """The audit's queries stay when a library of the training-data operators can't be imported."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('not here')\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(k.startswith('op') for k in q) and 'pipeline' not in e.oracle_sql(); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": f"{tmp_path}{os.pathsep}{root}"}, capture_output=True, text=True, check=True)
    assert int(out.stdout) > 150 and "not here" in out.stderr
