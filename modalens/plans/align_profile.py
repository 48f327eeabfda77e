"""Queries over cleaning, alignment, profiles and normalisation, each with its DuckDB twin."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalens.operators import align, clean, normalize, profile
from modalens.session import table
from modalens.sources import adapters as A

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


#: Messy strings that both engines derive from the events table, one in each of ten forms.
_MESSY = """CASE event_id % 10 WHEN 0 THEN ' NA ' WHEN 1 THEN 'n.d.' WHEN 2 THEN '-' WHEN 3 THEN replace(v, '.', ',') WHEN 4 THEN '1.' || replace(v, '.', ',')
 WHEN 5 THEN ' ' || v || ' ' WHEN 6 THEN 'inf' WHEN 7 THEN v || 'd' WHEN 8 THEN 'x' || v ELSE v END"""
_MESSY_SQL = f"""m AS (SELECT event_id, {_MESSY} AS raw FROM (SELECT event_id, (floor(value * 100) / 100)::DECIMAL(12, 2)::VARCHAR AS v FROM events)),
t AS (SELECT event_id, trim(raw) AS s FROM m), k AS (SELECT event_id, CASE WHEN lower(s) NOT IN ({", ".join(f"'{x}'" for x in clean.NA_TOKENS)}) THEN s END AS s FROM t),
n AS (SELECT event_id, s, CASE WHEN regexp_matches(s, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(s AS DOUBLE) END AS v,
 replace(replace(s, '.', ''), ',', '.') AS c FROM k)"""


def _messy(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", (F.floor(F.col("value") * 100) / 100).cast("decimal(12,2)").cast("string"))
    return e.select("event_id", F.expr(_MESSY).alias("raw"))


@query(f"WITH {_MESSY_SQL} SELECT event_id, s AS masked FROM k")
def f1_na_mask(spark, sf_dir):
    return _messy(spark, sf_dir).select("event_id", clean.na_masked(F.col("raw")).alias("masked"))


@query(f"WITH {_MESSY_SQL} SELECT event_id, v AS value FROM n")
def f2_number(spark, sf_dir):
    return _messy(spark, sf_dir).select("event_id", clean.number(clean.na_masked(F.col("raw"))).alias("value"))


@query(f"""WITH {_MESSY_SQL} SELECT event_id, coalesce(v, CASE WHEN regexp_matches(c, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')
 THEN try_cast(c AS DOUBLE) END) AS value FROM n""")
def f3_rescued(spark, sf_dir):
    return _messy(spark, sf_dir).select("event_id", clean.rescued(F.col("raw")).alias("value"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '#([0-9]+)') THEN regexp_extract(p_brand, '#([0-9]+)', 1) ELSE p_brand END AS id FROM part")
def f4_captured(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", clean.captured(F.col("p_brand"), "#([0-9]+)").alias("id"))


@query("""WITH s AS (SELECT c_custkey, '  ' || c_name || ' ' || c_mktsegment || '-0' || ' ' AS id FROM customer)
SELECT c_custkey, trim(upper(regexp_replace(regexp_replace(regexp_replace(trim(id), '#0+', ''), '[AEIOU]+', ''), '-0$', ''))) AS id FROM s""")
def f5_normalized(spark, sf_dir):
    raw = F.concat(F.lit("  "), "c_name", F.lit(" "), "c_mktsegment", F.lit("-0 "))
    return table(spark, sf_dir, "customer").select("c_custkey", clean.normalized(raw, ("#0+", "[AEIOU]+"), ("-0$",), upper=True).alias("id"))


_FILES_SQL = """SELECT c_custkey, '/data/' || lower(c_mktsegment) || '/' || CASE c_custkey % 9 WHEN 0 THEN 'Clinical_v2.csv' WHEN 1 THEN 'rnaseq.tsv' WHEN 2 THEN 'proteome.meta.txt' WHEN 3 THEN 'HM450k.csv' WHEN 4 THEN 'mirna_x.csv'
 WHEN 5 THEN 'gistic.tsv' WHEN 6 THEN 'metabolites.csv' WHEN 7 THEN 'somatic.maf' ELSE 'plate.csv' END AS path FROM customer"""


@query(f"""WITH f AS ({_FILES_SQL}) SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'clinical' WHEN 1 THEN 'rna' WHEN 2 THEN 'clinical' WHEN 3 THEN 'methylation' WHEN 4 THEN 'rna' WHEN 5 THEN 'cnv' WHEN 6 THEN 'clinical'
 WHEN 7 THEN 'mutation' ELSE 'other' END AS role FROM f""")
def f7_role(spark, sf_dir):
    names = F.array(*map(F.lit, ("Clinical_v2.csv", "rnaseq.tsv", "proteome.meta.txt", "HM450k.csv", "mirna_x.csv", "gistic.tsv", "metabolites.csv", "somatic.maf", "plate.csv")))
    path = F.concat(F.lit("/data/"), F.lower("c_mktsegment"), F.lit("/"), F.get(names, (F.col("c_custkey") % 9).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", clean.role(path).alias("role"))


_VERDICTS = ("batch-confounded (no marginal gain)", "predictive (adds marginal signal)", "informative alone (fusion gain not significant)", "redundant (subsumed by rna)", "informative but non-additive", "no detectable signal (control-like)", "predictive, perhaps", "predictive (standalone)")


@query("""SELECT CASE l_linenumber % 8 WHEN 0 THEN 'batch_confounded' WHEN 1 THEN 'predictive' WHEN 5 THEN 'control_like' WHEN 6 THEN '__unmapped__' WHEN 7 THEN 'predictive' ELSE 'not_additive' END AS role, count(*) AS n FROM lineitem GROUP BY 1""")
def f17_verdict_roles(spark, sf_dir):
    verdict = F.get(F.array(*map(F.lit, _VERDICTS)), (F.col("l_linenumber") % 8).cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy(clean.verdict_role(verdict).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE l_suppkey % 7 WHEN 0 THEN 'control' WHEN 1 THEN 'stress test' WHEN 2 THEN 'sensitivity probe' WHEN 3 THEN 'fusion' WHEN 4 THEN 'leave-one-out' WHEN 5 THEN 'neural single' ELSE 'single modality' END AS kind, count(*) AS n FROM lineitem GROUP BY 1""")
def f18_model_kinds(spark, sf_dir):
    names = ("control::linear::FUSION", "stress::batch-blocked-FUSION", "sensitivity::batch-adjusted-FUSION", "linear::FUSION", "linear::FUSION-minus-rna", "neural::rna", "linear::rna")
    name = F.get(F.array(*map(F.lit, names)), (F.col("l_suppkey") % 7).cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy(clean.model_kind(name).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (o_orderstatus <> 'P') AS n_kept, count(*) FILTER (o_orderstatus = 'P') AS n_dropped FROM orders")
def f8_targets_dropped(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("y"))
    return clean.targets_dropped(o, "y")


@query(f"""WITH {A.ORDERS_SQL}, c AS (SELECT label, row_number() OVER (ORDER BY (label = 'F')::INT, label) - 1 AS code FROM (SELECT DISTINCT label FROM samples))
SELECT sample_id, label, code::INT AS code FROM samples JOIN c USING (label)""")
def f12_encoded(spark, sf_dir):
    return clean.encoded(A.orders(spark, sf_dir).samples, "label", positive="F").select("sample_id", "label", "code")


_EVENT_SQL = """CASE o_orderkey % 10 WHEN 0 THEN '1:DECEASED' WHEN 1 THEN '0 :LIVING' WHEN 2 THEN ' Alive ' WHEN 3 THEN 'Relapsed' WHEN 4 THEN 'positive' WHEN 5 THEN 'no_event' WHEN 6 THEN '2' WHEN 7 THEN 'y' WHEN 8 THEN '1.0' ELSE 'Progression' END"""


@query("SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 1.0 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 0 WHEN 6 THEN 2 WHEN 8 THEN 1 WHEN 9 THEN 1 END::DOUBLE AS event_code FROM orders")
def f13_event(spark, sf_dir):
    return clean.event(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_EVENT_SQL).alias("s")), "s").select("o_orderkey", "event_code")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 20 > 0 THEN (o_orderkey % 2)::DOUBLE END AS event_code FROM orders")
def f13_numeric_event(spark, sf_dir):
    s = F.when(F.col("o_orderkey") % 20 == 0, "dead").otherwise((F.col("o_orderkey") % 2).cast("string"))
    return clean.event(table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")), "s").select("o_orderkey", "event_code")


@query("SELECT doc_id, coalesce(lang, 'NA') || ' | ' || CASE WHEN doc_id % 3 = 0 THEN 'NA' ELSE source END AS group_id FROM documents")
def f14_group_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("src", F.when(F.col("doc_id") % 3 != 0, F.col("source")))
    return d.select("doc_id", clean.group_key("lang", "src").alias("group_id"))


@query(f"WITH {A.EMBEDDINGS_SQL} SELECT modality || '::' || feature AS name, count(*) AS n FROM cells GROUP BY 1")
def f15_fusion_names(spark, sf_dir):
    return A.embeddings(spark, sf_dir).cells.groupBy(clean.early_fusion_name().alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.ORDERS_SQL} SELECT modality, feature, 0::BIGINT AS n_inf, round(var_samp(value), 4) AS variance FROM cells GROUP BY ALL HAVING var_samp(value) > 0")
def f11_structural_gate(spark, sf_dir):
    return clean.structural_gate(A.orders(spark, sf_dir).cells).withColumn("variance", F.round("variance", 4))


_COUNTS_SQL = """counts AS (SELECT l_suppkey::VARCHAR AS sample_id, p_brand AS feature, sum(l_quantity) AS value
 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


def _counts(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return li.join(p, "l_partkey").groupBy(F.col("l_suppkey").cast("string").alias("sample_id"), F.lit("rna").alias("modality"), F.col("p_brand").alias("feature")).agg(
        F.sum("l_quantity").alias("value")
    )


@query(f"WITH {_COUNTS_SQL} SELECT sample_id, feature, round(log2(value * 1e6 / sum(value) OVER (PARTITION BY sample_id) + 1), 6) AS value FROM counts")
def f16_log_cpm(spark, sf_dir):
    return rounded(clean.log_cpm(_counts(spark, sf_dir)).select("sample_id", "feature", "value"), "value")


@query(f"""WITH {_COUNTS_SQL}, g AS (SELECT feature, avg(ln(value)) AS lg FROM counts GROUP BY 1 HAVING min(value) > 0 AND count(*) = (SELECT count(DISTINCT sample_id) FROM counts))
SELECT sample_id, round(exp(median(ln(value) - lg)), 6) AS factor FROM counts JOIN g USING (feature) GROUP BY 1""")
def n2_median_of_ratios(spark, sf_dir):
    return rounded(normalize.median_of_ratios(_counts(spark, sf_dir), least_features=1), "factor")


@query(f"""WITH {_COUNTS_SQL}, lib AS (SELECT sample_id, sum(value) AS lib, quantile_cont(value, 0.75) / sum(value) AS q FROM counts WHERE value > 0 GROUP BY 1),
mean AS (SELECT avg(q) AS mq FROM lib), ref AS (SELECT sample_id AS rid, lib AS rlib FROM lib, mean ORDER BY abs(q - mq), sample_id LIMIT 1),
r AS (SELECT feature, value AS rv FROM counts JOIN ref ON rid = sample_id WHERE value > 0),
p AS (SELECT c.sample_id, ln(c.value / lib) / ln(2) - ln(rv / rlib) / ln(2) AS m, (ln(c.value / lib) + ln(rv / rlib)) / ln(2) / 2 AS a,
  (lib - c.value) / lib / c.value + (rlib - rv) / rlib / rv AS v FROM counts c JOIN r USING (feature) JOIN lib USING (sample_id), ref WHERE c.value > 0),
k AS (SELECT *, rank() OVER (PARTITION BY sample_id ORDER BY m) + (count(*) OVER (PARTITION BY sample_id, m) - 1) / 2 AS rm,
  rank() OVER (PARTITION BY sample_id ORDER BY a) + (count(*) OVER (PARTITION BY sample_id, a) - 1) / 2 AS ra, count(*) OVER (PARTITION BY sample_id) AS n FROM p),
w AS (SELECT sample_id, sum(m / v) / sum(1 / v) AS l FROM k WHERE rm >= floor(n * 0.3) + 1 AND rm <= n - floor(n * 0.3)
  AND ra >= floor(n * 0.05) + 1 AND ra <= n - floor(n * 0.05) AND v > 0 GROUP BY 1),
f AS (SELECT sample_id, coalesce(l, 0) AS l FROM lib LEFT JOIN w USING (sample_id))
SELECT sample_id, round(exp(l * ln(2) - (SELECT avg(l * ln(2)) FROM f)), 6) AS factor FROM f""")
def n1_tmm(spark, sf_dir):
    return rounded(normalize.tmm(_counts(spark, sf_dir)), "factor")


@query("""WITH ids AS (SELECT doc_id::VARCHAR AS id FROM documents), ref AS (SELECT DISTINCT doc_id::VARCHAR AS id FROM labels),
r AS (SELECT avg((l_orderkey::VARCHAR IN (SELECT id FROM ref))::INT) AS row_share FROM (SELECT DISTINCT l_orderkey FROM lineitem)),
c AS (SELECT avg((id IN (SELECT id FROM ref))::INT) AS column_share FROM ids)
SELECT round(row_share, 6) AS row_share, round(column_share, 6) AS column_share, column_share > row_share AS transpose FROM r, c""")
def j1_orientation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.lit("row").alias("axis"), F.col("l_orderkey").cast("string").alias("label"))
    columns = table(spark, sf_dir, "documents").select(F.lit("column").alias("axis"), F.col("doc_id").cast("string").alias("label"))
    ref = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("sample_id"))
    return rounded(align.orientation(rows.unionByName(columns), ref), "row_share", "column_share")


@query(f"""WITH {A.ORDERS_SQL} SELECT sample_id FROM samples WHERE sample_id IN (SELECT sample_id FROM cells GROUP BY 1 HAVING count(DISTINCT modality) = 2)""")
def j2_common_samples(spark, sf_dir):
    s = A.orders(spark, sf_dir)
    return align.common_samples(s.cells, s.samples)


_LONG = ["l_orderkey", "l_linenumber"]


@query("""SELECT l_orderkey::VARCHAR || '-' || l_linenumber AS sample_id, 'lines' AS modality, 'quantity' AS feature, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY ALL""")
def j4_collapsed(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in _LONG]).alias("sample_id"), F.lit("lines").alias("modality"), F.lit("quantity").alias("feature"), F.col("l_quantity").alias("value")
    )
    return rounded(align.collapsed(cells), "value")


@query("""SELECT user_id, event_type, event_id, round(value, 6) AS value FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def j5_first_kept(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value")).withColumn("at", F.col("event_id"))
    return align.first_kept(e, ["user_id", "event_type"], "at").drop("at")


@query(f"""WITH {A.EMBEDDINGS_SQL}, b AS (SELECT DISTINCT CASE WHEN label < 5 THEN 'emb_lo' ELSE 'other' END AS modality FROM embeddings), f AS (SELECT DISTINCT modality FROM features)
SELECT modality, 'no batch' AS problem FROM f WHERE modality NOT IN (SELECT modality FROM b)
UNION ALL SELECT modality, 'no modality' FROM b WHERE modality NOT IN (SELECT modality FROM f)""")
def j6_unmatched_batches(spark, sf_dir):
    s = A.embeddings(spark, sf_dir)
    b = table(spark, sf_dir, "embeddings").select(F.when(F.col("label") < 5, "emb_lo").otherwise("other").alias("modality"))
    return align.unmatched_batches(b, s.features)


@query("""WITH ids AS (SELECT 'text' AS modality, doc_id::VARCHAR AS sample_id FROM documents UNION ALL SELECT DISTINCT 'emb', vec_id::VARCHAR FROM embeddings),
k AS (SELECT *, sample_id IN (SELECT doc_id::VARCHAR FROM labels) AS hit FROM ids), o AS (SELECT modality, sample_id, row_number() OVER (PARTITION BY modality ORDER BY sample_id) AS rn FROM k WHERE NOT hit)
SELECT k.modality, count(*) AS n_ids, count(*) FILTER (hit) AS n_matched, coalesce((SELECT string_agg(sample_id, ',' ORDER BY sample_id) FROM o WHERE o.modality = k.modality AND rn <= 8), '') AS unmatched,
 count(*) FILTER (hit) >= 10 AS ok FROM k GROUP BY k.modality""")
def j7_preview(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.lit("text").alias("modality"), F.col("doc_id").cast("string").alias("sample_id"))
    ids = ids.unionByName(table(spark, sf_dir, "embeddings").select(F.lit("emb").alias("modality"), F.col("vec_id").cast("string").alias("sample_id")))
    return align.preview(ids, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("sample_id")))


@query("""WITH w AS (SELECT DISTINCT o_orderkey AS k FROM orders), o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 5), f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity <= 2)
SELECT k AS dataset_id, 'missing' AS problem FROM w WHERE k NOT IN (SELECT k FROM o UNION SELECT k FROM f) UNION ALL SELECT k, 'unexpected' FROM o WHERE k NOT IN (SELECT k FROM w)""")
def j8_outstanding(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "dataset_id")
    want = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dataset_id"))
    return align.outstanding(want, li.filter("l_quantity > 5"), li.filter("l_quantity <= 2"), ["dataset_id"])


@query(f"""WITH {A.RESULT_ROWS_SQL}, p AS (SELECT dataset_id, method_id, avg(primary_value) FILTER (arm = 'O') AS unsafe, avg(primary_value) FILTER (arm = 'F') AS safe FROM rows GROUP BY ALL)
SELECT dataset_id, method_id, round(unsafe, 6) AS unsafe, round(safe, 6) AS safe, round(unsafe - safe, 6) AS gap FROM p WHERE unsafe IS NOT NULL AND safe IS NOT NULL""")
def j9_paired_arms(spark, sf_dir):
    return rounded(align.paired_arms(A.result_rows(spark, sf_dir), ["dataset_id", "method_id"], "arm", "primary_value", "O", "F"), "unsafe", "safe", "gap")


_PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_name")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n, count(DISTINCT {c}) AS n_distinct, count(*) FILTER ({c} IS NULL) AS n_missing,
 count(*) FILTER (try_cast({c}::VARCHAR AS DOUBLE) IS NOT NULL) AS n_numeric, count(*) FILTER (try_cast({c}::VARCHAR AS DOUBLE) IS NOT NULL) >= 0.8 * count({c}) AS "numeric",
 count(DISTINCT {c}) = count({c}) AND count(DISTINCT {c}) > 1 AND NOT count(*) FILTER (try_cast({c}::VARCHAR AS DOUBLE) IS NOT NULL) >= 0.8 * count({c}) AS looks_like_id FROM orders"""
        for c in _PROFILED
    ).replace("FROM orders", "FROM (SELECT *, 'order ' || o_orderkey AS o_name FROM orders)")
)
def c1_clinical_profile(spark, sf_dir):
    return profile.clinical(_orders(spark, sf_dir))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("o_name", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).select(*_PROFILED)


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", value, place FROM (SELECT value, row_number() OVER (ORDER BY value) AS place FROM (SELECT DISTINCT {c}::VARCHAR AS value FROM (SELECT *, 'order ' || o_orderkey AS o_name FROM orders))) WHERE place <= 4""" for c in _PROFILED))
def c1_examples(spark, sf_dir):
    return profile.examples(_orders(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


_TARGETS = ("o_orderstatus", "o_totalprice", "o_orderkey", "one")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", task, n_missing, n_distinct, CASE WHEN task = 'classification' THEN smallest END AS smallest, CASE WHEN task = 'classification' THEN largest END AS largest,
 CASE WHEN task = 'classification' AND n_distinct > 1 THEN smallest >= 0.4 * largest END AS balanced, CASE WHEN task = 'regression' THEN low END AS low, CASE WHEN task = 'regression' THEN high END AS high, n_numeric, CASE WHEN task = 'classification' THEN n_distinct > 1 ELSE n_numeric >= 10 END AS ok
FROM (SELECT *, CASE WHEN n_numeric >= 0.8 * present AND n_distinct > 12 THEN 'regression' ELSE 'classification' END AS task FROM (SELECT 0::BIGINT AS n_missing, count(*) AS n_distinct, min(m) AS smallest, max(m) AS largest, sum(m)::BIGINT AS present,
 coalesce(sum(m) FILTER (x IS NOT NULL), 0)::BIGINT AS n_numeric, min(x) AS low, max(x) AS high FROM (SELECT v, count(*) AS m, try_cast(any_value(v) AS DOUBLE) AS x FROM (SELECT {c}::VARCHAR AS v FROM (SELECT *, 'one' AS one FROM orders)) GROUP BY v)))""" for c in _TARGETS))
def c2_target_preview(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("one", F.lit("one"))
    return functools.reduce(DataFrame.unionByName, [profile.target_preview(o, c).select(F.lit(c).alias("column"), "*") for c in _TARGETS])


@query("SELECT label, n, place FROM (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS place FROM (SELECT l_shipdate::VARCHAR AS label, count(*) AS n FROM lineitem GROUP BY 1)) WHERE place <= 10")
def c2_target_counts(spark, sf_dir):
    """The ten commonest classes of a target with many."""
    return profile.target_counts(table(spark, sf_dir, "lineitem"), "l_shipdate").withColumn("place", F.col("place").cast("long"))


@query(f"WITH {A.EVENTS_DAY_SQL}, p AS (SELECT y, count(*) AS n FROM samples GROUP BY 1) SELECT count(*) AS classes, min(n) AS smallest, max(n) AS largest, min(n) >= 0.4 * max(n) AS balanced FROM p")
def c2_target_profile(spark, sf_dir):
    return profile.target(A.events_day(spark, sf_dir).samples, "y")


@query(f"WITH {A.ORDERS_SQL}, p AS (SELECT group_id, count(*) AS n FROM samples GROUP BY 1) SELECT count(*) AS n_groups, max(n) AS largest, max(n) > 1 AS repeated FROM p")
def c3_group_profile(spark, sf_dir):
    return profile.groups(A.orders(spark, sf_dir).samples)


@query(f"""WITH {A.EVENTS_DAY_SQL}, p AS (SELECT batch, y, count(*) AS n FROM samples GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY batch) AS share FROM p)
SELECT batch, y, n, round(share, 6) AS share, max(share) OVER (PARTITION BY batch) > 0.9 AS one_class FROM s""")
def c4_batch_crosstab(spark, sf_dir):
    return rounded(profile.crosstab(A.events_day(spark, sf_dir).samples, "batch", "y"), "share")


@query(f"""WITH {A.EVENTS_DAY_SQL}, g AS (SELECT y, count(DISTINCT group_id) AS g FROM samples GROUP BY 1)
SELECT count(*) AS n, count(DISTINCT group_id) AS n_groups, (SELECT min(g) FROM g) AS fewest_groups, count(*) = count(DISTINCT group_id) AS no_op, (SELECT min(g) FROM g) < 2 AS error FROM samples""")
def c5_grouping(spark, sf_dir):
    return profile.grouping(A.events_day(spark, sf_dir).samples, "y")


@query(f"""WITH {A.EVENTS_DAY_SQL}, g AS (SELECT group_id, (count(DISTINCT y) > 1)::INT AS vy, (count(DISTINCT batch) > 1)::INT AS vb FROM samples GROUP BY 1)
SELECT 'y' AS "column", sum(vy)::BIGINT AS n_varying, 0::BIGINT AS n_missing FROM g UNION ALL SELECT 'batch', sum(vb)::BIGINT, 0::BIGINT FROM g""")
def c6_impure_groups(spark, sf_dir):
    return profile.impure(A.events_day(spark, sf_dir).samples, ["y", "batch"])


@query("""SELECT 'no outcome' AS rule, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'not in every table', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'duplicate rows', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)""")
def c7_exclusions(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return profile.exclusions([
        ("no outcome", o.filter("o_orderstatus = 'P'")),
        ("not in every table", o.join(li.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_anti")),
        ("duplicate rows", li.groupBy(*_LONG).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")),
    ])


@query("""WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority || o_orderstatus || (o_totalprice > 400000)::VARCHAR END AS label, CASE WHEN o_custkey % 50 > 0 THEN o_custkey END AS g FROM orders),
c AS (SELECT l_orderkey AS k, l_returnflag AS m, l_linestatus AS f, sum(l_quantity::BIGINT) AS v FROM lineitem GROUP BY ALL),
d AS (SELECT k, count(DISTINCT m) AS tables, list(m || f || v ORDER BY m, f) AS cells FROM c GROUP BY 1), z AS (SELECT label, count(*) AS size FROM s GROUP BY 1)
SELECT 'no outcome' AS rule, count(*) AS n FROM s WHERE label IS NULL UNION ALL SELECT 'no subject', count(*) FROM s WHERE g IS NULL
UNION ALL SELECT 'not in every table', count(*) FROM s LEFT JOIN d USING (k) WHERE coalesce(tables, 0) < (SELECT count(DISTINCT m) FROM c) UNION ALL SELECT 'small class', count(*) FROM s JOIN z USING (label) WHERE size < 60
UNION ALL SELECT 'duplicate rows', count(*) - count(DISTINCT cells) FROM s JOIN d USING (k)""")
def c7_exclusion_rules(spark, sf_dir):
    """All five rules over orders, whose tables are their line items by return flag."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    label = F.when(F.col("o_orderstatus") != "P", F.concat("o_orderpriority", "o_orderstatus", (F.col("o_totalprice") > 400000).cast("string")))
    samples = o.select(F.col("o_orderkey").alias("sample_id"), label.alias("label"), F.when(F.col("o_custkey") % 50 > 0, F.col("o_custkey")).alias("group_id"))
    cells = li.groupBy(F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("modality"), F.col("l_linestatus").alias("feature")).agg(F.sum("l_quantity").cast("double").alias("value"))
    return profile.exclusion_rules(cells, samples, "label", min_class=60)


@query(f"WITH {A.EMBEDDINGS_SQL} SELECT y, count(*) AS n, round(count(*) / (SELECT count(*) FROM samples), 6) AS share FROM samples GROUP BY 1")
def c8_class_balance(spark, sf_dir):
    return rounded(profile.class_balance(A.embeddings(spark, sf_dir).samples, "y"), "share")
