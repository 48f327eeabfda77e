import duckdb

from modalens.llm import queries


def test_near_duplicates_equal_their_sql(spark, tmp_path):
    base = [f"w{i}" for i in range(30)]
    texts = ["", None, " \t", "one", "ONE", "one two", " ".join(base), " ".join(base[:-1]), " ".join(base[:-4]), " ".join(base[3:]).upper(), "a\u00a0b c", " ".join(base)]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op2_near_duplicates(spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = con.execute(queries.oracle_sql()["op2_near_duplicates"]).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) == len(texts)
    assert {r[0]: r[2] for r in want}[11] == 6 and {r[0]: r[2] for r in want}[4] == 3
