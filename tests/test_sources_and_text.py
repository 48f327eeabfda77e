import pytest
from pyspark.sql import functions as F

from modalens.functions import rank, tails
from modalens.operators import clean, groups, metrics, missingness, splits
from modalens.sources import matrix
from modalens.streaming import progress


def put(tmp_path, text, name="x.txt"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def values(cells):
    return {(r.sample_id, r.feature): r.value for r in cells.collect()}


def test_messy_matrix(spark, tmp_path):
    at = put(tmp_path, "﻿id;euro;us;const\n a ; 1,5 ;2.0;1\nb;2,5;NA;1\n;9;9;9\nnan;1;1;1\n")
    assert values(matrix.read_matrix(spark, at, "m")) == {("a", "euro"): 1.5, ("a", "us"): 2.0, ("a", "const"): 1.0, ("b", "euro"): 2.5, ("b", "const"): 1.0}
    turned = values(matrix.read_matrix(spark, at, "m", transposed=True))
    assert turned[("euro", "a")] == 1.5


def test_one_column_mixes_decimal_signs(spark, tmp_path):
    at = put(tmp_path, "id\tx\na\t1.5\nb\t2,5\nc\t3.0\n")
    assert sorted(values(matrix.read_matrix(spark, at, "m")).values()) == [1.5, 2.5, 3.0]


@pytest.mark.parametrize("text", ["", " \n \n"])
def test_empty_file_is_named(spark, tmp_path, text):
    at = put(tmp_path, text)
    with pytest.raises(ValueError, match="x.txt"):
        matrix.read_matrix(spark, at, "m").count()


def test_header_only_clinical(spark, tmp_path):
    with pytest.raises(ValueError, match="header only"):
        matrix.read_clinical(spark, put(tmp_path, "id,y\n"))


def test_ragged_factors(spark, tmp_path):
    at = put(tmp_path, "E\t\ts1\tfactor\tage\t12\turl\nE\t\ts1\tcharacteristic\tsex\tf\nE\t\ts2\tfactor\tage\t13\n")
    assert {r.sample_id: r.age for r in matrix.condensed_factors(spark, at).collect()} == {"s1": "12", "s2": "13"}


def test_tidy_and_json_sources(spark):
    r = spark.createDataFrame([("s", "g", 1.0), ("s", "g", 3.0), ("t", "g", None)], "sample string, gene string, v double")
    assert values(matrix.tidy_cells(r, "sample", "gene", "v", "m")) == {("s", "g"): 2.0}
    j = spark.createDataFrame([("met", '{"s": "1.5", "t": "NA"}')], "f string, j string")
    assert values(matrix.json_map_cells(j, "f", "j", "m")) == {("s", "met"): 1.5}
    f = spark.createDataFrame([("s", "diet:high | age:12")], "k string, f string")
    assert matrix.factor_string(f, "k", "f").first().asDict() == {"k": "s", "age": "12", "diet": "high"}
    u = spark.createDataFrame([(f"s{i}", "A::B" if i else "A--C") for i in range(5)], "s string, f string")
    assert {r.feature for r in matrix.fusion_cells(u, "s", "f").collect()} == {"A"}


def test_event_labels(spark):
    words = ["1:DECEASED", "0:LIVING", "yes", "alive", "maybe", None]
    out = clean.event(spark.createDataFrame([(i, x) for i, x in enumerate(words)], "i int, e string"), "e")
    assert [r.event_code for r in out.orderBy("i").collect()] == [1, 0, 1, 0, None, None]
    numeric = spark.createDataFrame([(str(i % 2),) for i in range(9)] + [("dead",)], "e string")
    assert sorted(str(r.event_code) for r in clean.event(numeric, "e").collect()) == ["0.0"] * 5 + ["1.0"] * 4 + ["None"]
    other = spark.createDataFrame([(str(i % 2),) for i in range(9)] + [("7",)], "e string")  # not 0 and 1 alone
    assert sorted(r.event_code for r in clean.event(other, "e").collect()) == [0.0] * 5 + [1.0] * 4 + [7.0]


def test_numbers_that_a_cast_would_take(spark):
    df = spark.createDataFrame([(x,) for x in ["1.5d", "NaN", "Infinity", "1e3", "-.5", "1e999", "5."]], "s string")
    assert [r[0] for r in df.select(clean.number(F.col("s"))).collect()] == [None, None, None, 1000.0, -0.5, None, 5.0]


def test_only_the_first_match_goes(spark):
    df = spark.createDataFrame([("a-b-a",), ("xyz",)], "s string")
    assert [r[0] for r in df.select(clean.once(F.col("s"), "a")).collect()] == ["-b-a", "xyz"]


def test_ranks_equal_the_window(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("k"), (F.xxhash64("id") % 97).cast("double").alias("v"))
    out = rank.average_ranks(df.repartition(5), ["k"], "v").withColumn("w", rank.window_ranks("v", "k"))
    assert out.filter("abs(rank - w) > 1e-9").count() == 0


def test_tails_against_known_values():
    assert tails.gamma_q(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert tails.gamma_q(5, 1.0) == pytest.approx(0.9963401531726563, abs=1e-12)
    assert tails.beta_i(5, 0.5, 10 / (10 + 2.2281388519649385**2)) == pytest.approx(0.05, abs=1e-9)
    assert tails.beta_i(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)


def test_adjusted_p_values(spark):
    rows = [("f", f"t{i}", p) for i, p in enumerate([0.01, 0.04, 0.03, None])]
    out = {r.test: r for r in missingness.adjusted(spark.createDataFrame(rows, "family string, test string, p double"), ["family"]).collect()}
    assert [round(out[f"t{i}"].p_holm, 6) for i in range(3)] == [0.03, 0.06, 0.06]
    assert [round(out[f"t{i}"].p_bh, 6) for i in range(3)] == [0.03, 0.04, 0.04]
    assert out["t3"].p_bh is None


def test_equal_values_have_no_kruskal(spark):
    df = spark.createDataFrame([(0, 1.0, "a")] * 3 + [(0, 1.0, "b")] * 3, "key int, v double, g string")
    assert missingness.kruskal(df, ["key"], "v", "g").first().h is None


def test_repeating_a_subject_changes_no_profile(spark):
    rows = [("a", "r1", "f0"), ("a", "r2", "f1"), ("b", "r3", "f1"), ("c", "r4", "f0")]
    one = spark.createDataFrame([(s, "m", f, 1.0) for _, s, f in rows], "sample_id string, modality string, feature string, value double")
    samples = spark.createDataFrame(sorted({(s, g) for g, s, _ in rows}), "sample_id string, group_id string")
    twice = one.withColumn("sample_id", F.concat("sample_id", F.lit("x"))).unionByName(one)
    more = samples.withColumn("sample_id", F.concat("sample_id", F.lit("x"))).unionByName(samples)
    got = [{(r.group_id, r.feature): r.missing for r in groups.missing_profile(c, s, c).collect()} for c, s in ((one, samples), (twice, more))]
    assert got[0] == got[1] and got[0][("a", "f0")] == 0.5


def test_concordance_without_pairs_and_with_ties(spark):
    make = lambda rows: spark.createDataFrame(rows, "time double, event int, risk double")
    assert metrics.concordance(make([(1.0, 0, 1.0), (2.0, 0, 2.0)])).first().c_index == 0.5
    assert metrics.concordance(make([(1.0, 1, 2.0), (2.0, 1, 2.0), (3.0, 0, 1.0)])).first().c_index == pytest.approx(2.5 / 3)


def test_folds_do_not_depend_on_row_order(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") % 3).alias("y"), (F.col("id") % 40).cast("string").alias("group_id"))
    for make in (lambda x: splits.stratified(x, 4, "y"), lambda x: splits.grouped(x, 4, "y"), lambda x: splits.k_fold(x, 4)):
        assert sorted(map(tuple, make(df).collect())) == sorted(map(tuple, make(df.repartition(7)).collect()))
    broken = splits.k_fold(df, 4)
    assert {r.rule: r.n for r in splits.violations(df, broken).collect()}["divided group"] > 0


def test_hourly_progress_counts_a_run_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = '{"run_id": "%s", "method_id": "m", "primary_value": %s, "finished": "2024-01-01T%02d:10:00Z"}\n'
    (tmp_path / "in" / "a.json").write_text(row % ("a", 1.0, 0) + row % ("b", 2.0, 0) + row % ("a", 1.0, 0) + row % ("z", 0.0, 9))
    rows = progress.landed(spark, str(tmp_path / "in"), "run_id string, method_id string, primary_value double, finished timestamp")
    progress.run(progress.hourly(rows), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert [(r.n, r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 1.5)]
