"""Queries over sources and sinks. The files are written from the given tables into the shared folder, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from modalens.operators import align, clean
from modalens.session import table
from modalens.sources import adapters as A
from modalens.sources import matrix
from modalens.storage import scratch

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _part_file(spark, sf_dir, sep: str = ";", gene_names: bool = False) -> str:
    """Parts by size and price, with decimal commas in every third row and a missing price in every seventh."""
    key, at = F.col("p_partkey"), scratch(spark, "parts")
    price = F.format_string("%.2f", F.round("p_retailprice", 2))
    price = F.when(key % 7 == 0, F.lit("NA")).when(key % 3 == 0, F.replace(price, F.lit("."), F.lit(","))).otherwise(price)
    named = [F.concat(F.lit("N"), F.col("p_size").cast("string")).alias("Gene Name")] if gene_names else []
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), key.cast("string")).alias("id"), *named, F.col("p_size").cast("string").alias("size"), price.alias("price"))
    rows.write.option("header", True).option("sep", sep).csv(at)
    return at


_PARTS_SQL = """SELECT 'P' || p_partkey AS id, 'size' AS col, p_size::DOUBLE AS value FROM part
UNION ALL SELECT 'P' || p_partkey, 'price', round(p_retailprice, 2) FROM part WHERE p_partkey % 7 <> 0"""


@query(f"SELECT id AS sample_id, 'parts' AS modality, col AS feature, value FROM ({_PARTS_SQL})")
def s2_read_matrix(spark, sf_dir):
    """S1 to S4: the delimiter is found, ids and cells cleaned, the wide file becomes long."""
    return matrix.read_matrix(spark, _part_file(spark, sf_dir), "parts")


@query(f"SELECT col AS sample_id, 'parts' AS modality, id AS feature, value FROM ({_PARTS_SQL})")
def s16_feature_by_sample(spark, sf_dir):
    return matrix.read_matrix(spark, _part_file(spark, sf_dir, "|"), "parts", transposed=True)


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def s5_read_clinical(spark, sf_dir):
    at = scratch(spark, "clinical")
    padded = F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")).alias("c_mktsegment")
    table(spark, sf_dir, "customer").select("c_custkey", padded, "c_nationkey").write.option("header", True).option("sep", "\t").csv(at)
    return matrix.read_clinical(spark, at).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("SELECT l_orderkey::VARCHAR AS sample_id, 'lines' AS modality, l_returnflag AS feature, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY ALL")
def s6_tidy_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_orderkey", F.col("l_orderkey").cast("string"))
    return matrix.tidy_cells(rows, "l_orderkey", "l_returnflag", "l_quantity", "lines").withColumn("value", F.round("value", 6))


@query("""SELECT l_orderkey, arg_min(l_quantity, l_linenumber) FILTER (l_returnflag = 'A') AS "A", arg_min(l_quantity, l_linenumber) FILTER (l_returnflag = 'N') AS "N",
 arg_min(l_quantity, l_linenumber) FILTER (l_returnflag = 'R') AS "R" FROM (SELECT l_orderkey, l_returnflag, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY 1""")
def s7_tidy_clinical(spark, sf_dir):
    keys = ["l_orderkey", "l_returnflag", "l_linenumber"]
    rows = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.min("l_quantity").alias("l_quantity"))
    return matrix.tidy_clinical(rows, "l_orderkey", "l_returnflag", "l_quantity", "l_linenumber").select("l_orderkey", "A", "N", "R")


@query("SELECT c_custkey::VARCHAR AS sample_id, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR END AS nation FROM customer")
def s8_condensed_factors(spark, sf_dir):
    """Ragged lines: a segment for every customer, a nation for every other, and lines that aren't factors."""
    at, key = scratch(spark, "condensed"), F.col("c_custkey").cast("string")
    tab = F.lit("\t")
    line = lambda kind, name, v, *more: F.concat(F.lit("E"), tab, tab, key, tab, F.lit(kind), tab, F.lit(name), tab, v, *more)
    nation = F.when(F.col("c_custkey") % 2 == 0, line("factor", "nation", F.col("c_nationkey").cast("string"), tab, F.lit("url")))
    lines = F.array_compact(F.array(line("factor", "segment", F.col("c_mktsegment")), line("characteristic", "name", F.col("c_name")), nation))
    table(spark, sf_dir, "customer").select(F.explode(lines).alias("value")).write.text(at)
    return matrix.condensed_factors(spark, at).select("sample_id", "segment", "nation")


@query(f"""SELECT col AS sample_id, 'counts' AS modality, id AS feature, value, 'N' || p_size AS symbol FROM ({_PARTS_SQL}) JOIN part ON id = 'P' || p_partkey""")
def s9_raw_counts(spark, sf_dir):
    cells, symbols = matrix.raw_counts(spark, _part_file(spark, sf_dir, "\t", gene_names=True), "counts")
    return cells.join(symbols, "feature").select("sample_id", "modality", "feature", "value", "symbol")


@query("SELECT l_linenumber::VARCHAR AS sample_id, 'supply' AS modality, l_suppkey::VARCHAR AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY ALL")
def s10_json_maps(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").cast("string").alias("k")).agg(F.sum("l_quantity").cast("string").alias("v"))
    records = per.groupBy(F.col("l_suppkey").cast("string").alias("f")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("j"))
    return matrix.json_map_cells(records, "f", "j", "supply")


@query("SELECT o_orderkey, o_orderpriority AS priority, o_orderstatus AS status FROM orders")
def s11_factor_string(spark, sf_dir):
    text = F.concat(F.lit("status:"), "o_orderstatus", F.lit(" | priority:"), "o_orderpriority")
    return matrix.factor_string(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("f")), "o_orderkey", "f").select("o_orderkey", "priority", "status")


@query("""WITH g AS (SELECT DISTINCT l_orderkey::VARCHAR AS sample_id, unnest([l_returnflag, 'L' || l_suppkey]) AS feature FROM lineitem)
SELECT sample_id, 'fusion' AS modality, feature, 1.0::DOUBLE AS value FROM g WHERE feature IN (SELECT feature FROM g GROUP BY 1 HAVING count(*) >= 5)""")
def s12_fusion_cells(spark, sf_dir):
    sign = F.when(F.col("l_orderkey") % 2 == 0, "::").otherwise("--")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("s"), F.concat("l_returnflag", sign, F.lit("L"), F.col("l_suppkey").cast("string")).alias("f"))
    return matrix.fusion_cells(rows, "s", "f")


@query("""SELECT l_orderkey AS sample_id, 'lines' AS modality, l_returnflag AS feature, arg_min(q, l_linenumber) AS value
FROM (SELECT l_orderkey, l_returnflag, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def s13_cleaned_symbols(spark, sf_dir):
    name = F.concat("l_returnflag", F.lit(" ("), F.col("l_linenumber").cast("string"), F.lit(")"))
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id"), F.lit("lines").alias("modality"), name.alias("feature"), "l_linenumber").agg(F.min("l_quantity").alias("value"))
    return matrix.cleaned_symbols(cells, "l_linenumber")


@query(f"""WITH {A.EMBEDDINGS_SQL}, t AS (SELECT sample_id, value AS target FROM cells WHERE modality = 'emb_hi' AND feature = 'd40')
SELECT sample_id, feature, value, target FROM cells JOIN t USING (sample_id) WHERE modality = 'emb_lo'""")
def s14_target_of(spark, sf_dir):
    cells = A.embeddings(spark, sf_dir).cells
    target = matrix.target_of(cells.filter("modality = 'emb_hi'"), "d40")
    return cells.filter("modality = 'emb_lo'").join(target, "sample_id").select("sample_id", "feature", "value", "target")


@query("SELECT c_custkey || CASE WHEN c_nationkey < 5 THEN '.N' ELSE '' END AS sample_id, CASE WHEN c_nationkey < 5 THEN 'Normal' ELSE 'Tumor' END AS label FROM customer")
def s15_suffix_label(spark, sf_dir):
    ident = F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_nationkey") < 5, ".N").otherwise(""))
    return table(spark, sf_dir, "customer").select(ident.alias("sample_id")).withColumn("label", matrix.suffix_label(F.col("sample_id")))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS w, CASE WHEN o_orderkey % 4 <> 3 THEN '' WHEN o_orderkey % 11 = 0 THEN 'invalid JSON' WHEN o_orderkey % 13 = 0 THEN 'row is not an object' ELSE '' END AS problem FROM orders)
SELECT ['parquet', 'csv', 'json', 'jsonl'][w + 1] AS source, CASE WHEN problem = '' THEN o_orderkey::VARCHAR END AS dataset_id, problem FROM o""")
def s17_record_scan(spark, sf_dir):
    """Orders in files of four formats; lines of the last are cut, or aren't objects, and come back as problems."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("dataset_id"), F.col("o_orderstatus").alias("family"))
    part = lambda i: o.filter(F.col("dataset_id").cast("long") % 4 == i)
    at = {f: scratch(spark, f) for f in ("parquet", "csv", "json", "jsonl")}
    part(0).write.parquet(at["parquet"])
    part(1).write.option("header", True).csv(at["csv"])
    part(2).write.json(at["json"])
    key, text = F.col("dataset_id").cast("long"), F.to_json(F.struct("dataset_id", "family"))
    bad = F.when(key % 11 == 0, F.expr("substring(j, 1, length(j) - 3)")).when(key % 13 == 0, F.lit("[1, 2]")).otherwise(F.col("j"))
    part(3).withColumn("j", text).select(bad.alias("value")).write.text(at["jsonl"])
    records, problems = matrix.scan_records(spark, at, ["dataset_id", "family"])
    return records.select("source", "dataset_id", F.lit("").alias("problem")).unionByName(problems.select("source", F.lit(None).cast("string").alias("dataset_id"), "problem"))


@query(f"""WITH {A.EMBEDDINGS_SQL} SELECT 'cells' AS part, modality AS name, count(*) AS n, round(sum(value), 4) AS total FROM cells GROUP BY ALL
UNION ALL SELECT 'samples', y::VARCHAR, count(*), NULL FROM samples GROUP BY y UNION ALL SELECT 'descriptor', modality, count(DISTINCT feature), NULL FROM cells GROUP BY modality""")
def k1_dataset(spark, sf_dir):
    """The landing layout, written and read back."""
    s, at = A.embeddings(spark, sf_dir), scratch(spark, "dataset")
    matrix.write_dataset(s.cells, s.samples, at)
    cells, samples, descriptor = spark.read.parquet(f"{at}/cells"), spark.read.parquet(f"{at}/samples"), spark.read.json(f"{at}/descriptor")
    none = F.lit(None).cast("double").alias("total")
    out = cells.groupBy(F.lit("cells").alias("part"), F.col("modality").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    out = out.unionByName(samples.groupBy(F.lit("samples").alias("part"), F.col("y").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"), none))
    return out.unionByName(descriptor.select(F.lit("descriptor").alias("part"), F.col("modality").alias("name"), F.col("n_features").alias("n"), none))


@query("SELECT l_returnflag AS model, round(avg(l_discount), 6) AS score, round(min(l_discount), 6) AS ci_low, round(max(l_discount), 6) AS ci_high FROM lineitem GROUP BY 1")
def k2_reports(spark, sf_dir):
    """A table of metrics, written with numeric intervals and read back."""
    at = scratch(spark, "reports")
    scores = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.avg("l_discount").alias("score"), F.min("l_discount").alias("ci_low"), F.max("l_discount").alias("ci_high"))
    matrix.write_reports(at, metrics=scores)
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{at}/metrics")
    return back.select("model", *[F.round(c, 6).alias(c) for c in ("score", "ci_low", "ci_high")])


@query("""SELECT c_custkey, 'TCGA-' || c_custkey AS id FROM customer""")
def f6_aliquot_preset(spark, sf_dir):
    """Barcodes with a sample part, with a whole aliquot part, or with neither."""
    key = F.col("c_custkey")
    tail = F.when(key % 3 == 0, "-01A").when(key % 3 == 1, "-01A-11R-1234-07").otherwise("")
    raw = F.concat(F.lit(" TCGA-"), key.cast("string"), tail, F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", clean.normalized(raw, **clean.PRESETS["tcga"]).alias("id"))


@query(f"""WITH {A.ORDERS_SQL}, c AS (SELECT sample_id, CASE WHEN label <> 'P' THEN target END AS target FROM samples)
SELECT modality, feature, count(*) AS n, (SELECT count(*) FROM c WHERE target IS NULL) AS dropped FROM cells WHERE sample_id IN (SELECT sample_id FROM c WHERE target IS NOT NULL) GROUP BY ALL""")
def f9_coded_only(spark, sf_dir):
    s = A.orders(spark, sf_dir)
    coded = s.samples.withColumn("target", F.when(F.col("label") != "P", F.col("target")))
    cells, samples, dropped = clean.coded_only(s.cells, coded, "target")
    return cells.groupBy("modality", "feature").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(dropped)).select("modality", "feature", "n", "dropped")


@query(f"""WITH {A.EMBEDDINGS_SQL}, v AS (SELECT modality, feature, CASE WHEN modality = 'emb_lo' AND feature <> 'd03' THEN value END AS value FROM cells),
f AS (SELECT modality, feature, count(value) AS n FROM v GROUP BY ALL), m AS (SELECT modality, sum(n) AS t FROM f GROUP BY 1)
SELECT modality, feature, CASE WHEN t = 0 THEN 'modality dropped: no numeric data' WHEN n = 0 THEN 'feature dropped: no observed value' ELSE 'kept' END AS note FROM f JOIN m USING (modality)""")
def f10_observed(spark, sf_dir):
    s = A.embeddings(spark, sf_dir)
    seen = F.when((F.col("modality") == "emb_lo") & (F.col("feature") != "d03"), F.col("value"))
    return clean.observed(s.cells.withColumn("value", seen), s.features)


@query(f"WITH {A.EMBEDDINGS_SQL}, k AS (SELECT vec_id::VARCHAR AS sample_id FROM embeddings WHERE vec_id % 3 = 0) SELECT modality, count(*) AS n, round(sum(value), 4) AS total FROM cells SEMI JOIN k USING (sample_id) GROUP BY 1")
def j3_reindexed(spark, sf_dir):
    s = A.embeddings(spark, sf_dir)
    kept = align.reindexed(s.cells, s.samples.filter(F.col("sample_id").cast("long") % 3 == 0))
    return kept.groupBy("modality").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH i AS (SELECT o_orderkey::VARCHAR AS dataset_id, o_orderstatus AS family, o_orderpriority AS scenario FROM orders), l AS (SELECT l_orderkey::VARCHAR AS dataset_id, l_returnflag AS method_id, l_discount AS v FROM lineitem),
r AS (SELECT method_id, family, scenario, count(*) AS scored FROM l JOIN i USING (dataset_id) WHERE v > 0 GROUP BY ALL), f AS (SELECT method_id, family, scenario, count(*) AS failed FROM l JOIN i USING (dataset_id) WHERE v = 0 GROUP BY ALL)
SELECT method_id, family, scenario, coalesce(scored, 0) AS scored, coalesce(failed, 0) AS failed, coalesce(scored, 0) + coalesce(failed, 0) AS attempted FROM r FULL JOIN f USING (method_id, family, scenario)""")
def j10_failures_in_cells(spark, sf_dir):
    index = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("dataset_id"), F.col("o_orderstatus").alias("family"), F.col("o_orderpriority").alias("scenario"))
    rows = A.result_rows(spark, sf_dir)
    return align.attempts(rows.filter("primary_value > 0"), rows.filter("primary_value = 0"), index, ["method_id"], ["family", "scenario"])


@query(f"""WITH {A.RESULT_ROWS_SQL} SELECT 'classical' AS family, method_id AS model, primary_value AS score FROM rows WHERE arm = 'F'
UNION ALL SELECT 'neural', method_id, primary_value FROM rows WHERE arm = 'O'""")
def j11_result_sets(spark, sf_dir):
    r = A.result_rows(spark, sf_dir).select("arm", F.col("method_id").alias("model"), F.col("primary_value").alias("score"))
    return align.result_sets(classical=r.filter("arm = 'F'").drop("arm"), neural=r.filter("arm = 'O'").drop("arm"))
