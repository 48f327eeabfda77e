import numpy as np
import pytest
from pyspark.sql import functions as F

from modalens.operators import association, controls, groups, ledger, normalize, rows, splits


def centred(d):
    return d - d.mean(0) - d.mean(1)[:, None] + d.mean()


def correlation(one, two):
    a, b = centred(one), centred(two)
    return (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())


def test_batch_association_equals_matrices(spark):
    rng = np.random.default_rng(3)
    n = 24
    batch, x, t = rng.integers(0, 3, n), rng.normal(size=(n, 4)), rng.integers(0, 6, n)
    x[batch == 1] += 3
    ids = [f"g{i:02d}" for i in range(n)]
    label = spark.createDataFrame([(g, str(b), float(v)) for g, b, v in zip(ids, batch, t)], "group_id string, batch string, t double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = spark.createDataFrame([(ids[i], ids[j], float(d[i, j])) for i in range(n) for j in range(i + 1, n)], "a string, b string, d double")
    other = (batch[:, None] != batch[None]).astype(float)
    got = association.structure_by_batch(pairs, label, "batch", reps=19).first()
    assert got.n == n and got.dcor == pytest.approx(correlation(d, other)) and got.p == 0.05
    rank = np.array([(t < v).sum() + ((t == v).sum() + 1) / 2 for v in t])
    got = association.continuous_by_batch(label, "t", "batch", reps=19).first()
    assert got.dcor == pytest.approx(correlation(np.abs(rank[:, None] - rank[None]), other)) and 0.05 <= got.p <= 1
    with pytest.raises(ValueError):
        association.structure_by_batch(pairs, label, "batch", reps=1, least=n)


def test_permutations_keep_margins_and_move_together(spark):
    g = spark.createDataFrame([(i, i % 3, i * 10) for i in range(200)], "group_id long, x long, y long")
    out = groups.permuted(g, ["x", "y"], reps=3).toPandas()
    assert len(out) == 600 and (out["y"] // 10 % 3 == out["x"]).all()
    for _, one in out.groupby("rep"):
        assert sorted(one["y"]) == [i * 10 for i in range(200)] and sorted(one["group_id"]) == list(range(200))
        assert (one["y"] != one["group_id"] * 10).mean() > 0.9


def test_targets_stay_in_their_strata_and_pass_the_audit(spark):
    rows = [(i, i // 2, "ab"[i // 2 % 2], int(i // 2 % 5 == 0)) for i in range(80)]
    samples = spark.createDataFrame(rows, "sample_id long, group_id long, stratum string, y int")
    folds = samples.select("sample_id", (F.col("group_id") % 3).cast("int").alias("outer_fold"))
    train = controls.training_groups(samples, folds, "y", "stratum")
    moved = controls.permuted_targets(train)
    assert moved.count() == train.count() == 80 and moved.filter("y <> permuted").count() > 0
    assert controls.audit(train, moved).count() == 0
    left = controls.audit(train, train.withColumn("permuted", F.col("y"))).collect()
    assert sorted((r.outer_fold, r.rule, r.n) for r in left) == [(k, "nothing moves", 1) for k in range(3)]
    with pytest.raises(ValueError):
        controls.training_groups(samples.withColumn("y", F.col("sample_id").cast("int")), folds, "y", "stratum")


def test_one_assignment_or_two(spark):
    t = spark.createDataFrame([(0, 1, "a", 1), (0, 2, "a", 1), (0, 3, "b", 0), (1, 1, "a", 1), (1, 2, "a", 0)], "outer_fold int, group_id long, stratum string, y int")
    out = {(r.outer_fold, r.group_id): r.permuted for r in controls.permuted_targets(t, tries=1).collect()}
    assert out == {(0, 1): None, (0, 2): None, (0, 3): None, (1, 1): 0, (1, 2): 1}
    log = {r.outer_fold: r.log_assignments for r in controls.attainable(t).collect()}
    assert log[0] == pytest.approx(0) and log[1] == pytest.approx(np.log(2))
    assert controls.permuted_targets(t.limit(0)).count() == 0 and controls.attainable(t.limit(0)).count() == 0


def test_orders_are_tried_one_at_a_time(spark, monkeypatch):
    rows = [(k, i, "ab"[i % 2], int(i % 2 == 0 and i % 3 == 0)) for k in range(2) for i in range(400)] + [(2, i, "a", 1) for i in range(9)]
    t = spark.createDataFrame(rows, "outer_fold int, group_id long, stratum string, y int")
    made, keep = [], controls.written

    def counted(df, name):
        out = keep(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(controls, "written", counted)
    out = controls.permuted_targets(t).toPandas()
    assert made == [("training-groups", 809), ("permuted", 400)]  # one order, without the stratum of one target
    assert len(out) == 809 and out[out.outer_fold == 2].permuted.isna().all()
    b = out[(out.outer_fold < 2) & (out.stratum == "b")]
    assert (b.y == b.permuted).all() and (out[out.outer_fold < 2].groupby("outer_fold").permuted.sum() == 67).all()
    assert controls.audit(t.filter("outer_fold < 2"), controls.permuted_targets(t.filter("outer_fold < 2"))).count() == 0


def test_training_samples_alone_set_the_scale(spark):
    counts = {"s1": [4, 8], "s2": [1, 2], "s3": [16, 8]}
    cells = spark.createDataFrame([(s, "m", f"f{i}", float(v)) for s, x in counts.items() for i, v in enumerate(x)], "sample_id string, modality string, feature string, value double")
    learn = spark.createDataFrame([("s1",), ("s2",)], "sample_id string")
    factor = {r.sample_id: r.factor for r in normalize.median_of_ratios(cells, 1, learn).collect()}
    assert factor["s1"] == pytest.approx(2) and factor["s2"] == pytest.approx(0.5) and factor["s3"] == pytest.approx(np.sqrt(8 * 2))
    out = normalize.normalised(cells, "median_of_ratios", learn, 1).filter("sample_id = 's1' AND feature = 'f0'").first()
    assert out.value == pytest.approx(np.log2(3)) and out.whole_matrix
    with pytest.raises(ValueError):
        normalize.normalised(cells, "other")


def test_rating(spark):
    flags = spark.createDataFrame([("x",), ("w",)], "flag string")
    seen = spark.createDataFrame([("m", "no detectable signal", True), ("k", "predictive", False)], "modality string, verdict string, batch_confounded boolean")
    calm = spark.createDataFrame([(False,)], "leak boolean")
    r = ledger.hygiene(flags, seen, calm, 12).first()
    assert (r.rating, r.n_flags) == ("moderate concerns", 2)
    assert r.advice == "correct batch effects: m; consider dropping: m; missingness or batch: w; missingness or batch: x; small sample: 12"
    r = ledger.hygiene(flags.limit(0), seen.limit(0), calm.limit(0), 100).first()
    assert (r.rating, r.leakage, r.advice) == ("clean", False, "nothing critical")


def test_pooled_roles(spark):
    p = spark.createDataFrame([("k", "a", "a"), ("k", "a", "b"), ("k", "b", None), ("k", "c", "d"), ("k", None, "a"), ("j", "a", "a")], "key string, truth string, called string")
    out = {r.key: r for r in rows.pooled_role_f1(p, ["key"]).collect()}
    assert (out["k"].n, out["k"].roles) == (4, 3) and out["k"].role_f1 == pytest.approx((2 / 3) / 3) and out["j"].role_f1 == 1
    assert rows.pooled_role_f1(p.limit(0), ["key"]).count() == 0
    d = spark.createDataFrame([("k", i, t, c) for i in range(8) for t, c in (("a", "a"), ("b", "b" if i % 2 else "a"))] + [("j", 1, "a", "a")], "key string, d int, truth string, called string")
    r = rows.pooled_role_interval(d, ["key"], "d", reps=100).collect()
    at = rows.pooled_role_f1(d, ["key"]).filter("key = 'k'").first().role_f1
    assert [x.key for x in r] == ["k"] and r[0].usable == 100 and 0.3 < r[0].ci_low < at < r[0].ci_high <= 1


def test_sound_nested_folds_break_no_rule(spark):
    s = spark.createDataFrame([(i, i // 2) for i in range(36)], "sample_id long, group_id long")
    folds = s.select("sample_id", (F.col("group_id") % 3).cast("int").alias("outer_fold"))
    own = s.join(folds, "sample_id").withColumnRenamed("outer_fold", "own").join(folds.select("outer_fold").distinct()).filter("own <> outer_fold")
    inner = own.select("sample_id", "outer_fold", F.floor(F.col("group_id") / 9).cast("int").alias("inner_fold"))
    assert [r.n for r in splits.inner_violations(s, folds, inner).collect()] == [0] * 15
    twice = {(r.outer_fold, r.rule): r.n for r in splits.inner_violations(s, folds, inner.union(inner.filter("outer_fold = 1 AND sample_id < 2"))).collect() if r.n}
    assert twice == {(1, "placed twice"): 2}
