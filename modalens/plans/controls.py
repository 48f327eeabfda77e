"""Queries over batch association, permuted targets, normalisation choices, nested folds and the hygiene rating."""

from __future__ import annotations

from pyspark.sql import functions as F

from modalens.operators import association, controls, groups, ledger, normalize, rows, splits
from modalens.plans.align_profile import _COUNTS_SQL, _counts
from modalens.plans.modelling import _REP_SQL, _z
from modalens.session import table
from modalens.sources import adapters as A

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_CENTRED = "c AS (SELECT d - avg(d) OVER (PARTITION BY a) - avg(d) OVER (PARTITION BY b) + avg(d) OVER () AS x, e - avg(e) OVER (PARTITION BY a) - avg(e) OVER (PARTITION BY b) + avg(e) OVER () AS y FROM f)"


def _structure(spark, sf_dir):
    z = _z(spark, sf_dir)
    label = z.select("group_id").distinct().withColumn("batch", (F.col("group_id").cast("int") % 5).cast("string"))
    return association.structure_by_batch(groups.distances(z), label, "batch")


@query(f"""WITH {_REP_SQL}, d AS (SELECT p.group_id AS a, q.group_id AS b, avg(abs(p.value - q.value)) AS d FROM z p JOIN z q USING (modality, feature) GROUP BY ALL),
f AS (SELECT d.*, (a::INT % 5 <> b::INT % 5)::INT::DOUBLE AS e FROM d), {_CENTRED} SELECT (SELECT count(DISTINCT group_id) FROM samples) AS n, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS dcor FROM c""")
def g6_structure_by_batch(spark, sf_dir):
    return _structure(spark, sf_dir).select("n", F.round("dcor", 6).alias("dcor"))


@query()
def g6_structure_by_batch_permuted(spark, sf_dir):
    return _structure(spark, sf_dir)


def _customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("group_id"), F.round("c_acctbal", -2).alias("t"), F.col("c_mktsegment").alias("batch"))


@query(f"""WITH g AS (SELECT c_custkey AS g, round(c_acctbal, -2) AS t, c_mktsegment AS s FROM customer), r AS (SELECT g, s, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2 AS r FROM g),
f AS (SELECT p.g AS a, q.g AS b, abs(p.r - q.r) AS d, (p.s <> q.s)::INT::DOUBLE AS e FROM r p, r q), {_CENTRED} SELECT (SELECT count(*) FROM g) AS n, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS dcor FROM c""")
def g8_continuous_by_batch(spark, sf_dir):
    return association.continuous_by_batch(_customers(spark, sf_dir), "t", "batch", reps=0).select("n", F.round("dcor", 6).alias("dcor"))


@query()
def g8_continuous_by_batch_permuted(spark, sf_dir):
    return association.continuous_by_batch(_customers(spark, sf_dir), "t", "batch")


def _train(spark, sf_dir):
    """Customers as groups: folds by key, strata by segment, the target is whether the balance is above 5,000."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_custkey").alias("group_id"), F.col("c_mktsegment").alias("stratum"), (F.col("c_acctbal") > 5000).cast("int").alias("y"))
    folds = c.select("sample_id", (F.col("group_id") % 5).cast("int").alias("outer_fold"))
    return controls.training_groups(c, folds, "y", "stratum")


_TRAIN_SQL = "t AS (SELECT k.f AS outer_fold, c_custkey AS g, c_mktsegment AS s, (c_acctbal > 5000)::INT AS y FROM customer, (SELECT DISTINCT (c_custkey % 5)::INT AS f FROM customer) k WHERE c_custkey % 5 <> k.f)"


@query(f"""WITH {_TRAIN_SQL}, c AS (SELECT outer_fold, s, y, count(*) AS c FROM t GROUP BY ALL), n AS (SELECT outer_fold, s, sum(c) AS n FROM c GROUP BY ALL), x AS (SELECT outer_fold, n, lgamma(n + 1) AS l FROM n UNION ALL SELECT outer_fold, 0, -lgamma(c + 1) FROM c)
SELECT outer_fold, sum(n)::BIGINT AS n_groups, round(sum(l), 5) AS log_assignments FROM x GROUP BY 1""")
def m23_attainable(spark, sf_dir):
    return controls.attainable(_train(spark, sf_dir)).withColumn("log_assignments", F.round("log_assignments", 5))


@query()
def m23_permuted_targets(spark, sf_dir):
    return controls.permuted_targets(_train(spark, sf_dir))


@query(f"""WITH {_TRAIN_SQL}, p AS (SELECT t.*, CASE WHEN outer_fold = 0 THEN y WHEN outer_fold = 1 THEN 1 - y WHEN g % 7 = 0 THEN 1 - y ELSE y END AS p FROM t WHERE NOT (outer_fold = 2 AND g % 11 = 0)),
o AS (SELECT outer_fold, s, sum(k) AS k FROM (SELECT outer_fold, s, y AS v, 1 AS k FROM t UNION ALL SELECT outer_fold, s, p, -1 FROM p) GROUP BY outer_fold, s, v HAVING sum(k) <> 0)
SELECT outer_fold, 'other groups' AS rule, count(*) AS n FROM t WHERE outer_fold = 2 AND g % 11 = 0 GROUP BY 1 UNION ALL SELECT outer_fold, 'other targets', count(DISTINCT s) FROM o GROUP BY 1
UNION ALL SELECT outer_fold, 'nothing moves', 1 FROM p GROUP BY 1 HAVING count(*) FILTER (y <> p) = 0""")
def m24_permutation_audit(spark, sf_dir):
    """A candidate with faults of its own in every fold: left in place, turned over, groups missing, some turned over."""
    t = _train(spark, sf_dir)
    some = F.when(F.col("outer_fold") == 0, F.col("y")).when((F.col("outer_fold") == 1) | (F.col("group_id") % 7 == 0), 1 - F.col("y")).otherwise(F.col("y"))
    return controls.audit(t, t.filter("NOT (outer_fold = 2 AND group_id % 11 = 0)").select("outer_fold", "group_id", some.alias("permuted")))


@query(f"""WITH {_COUNTS_SQL}, g AS (SELECT feature, avg(ln(value)) AS lg FROM counts GROUP BY 1 HAVING min(value) > 0 AND count(*) = (SELECT count(DISTINCT sample_id) FROM counts)), f AS (SELECT sample_id, exp(median(ln(value) - lg)) AS factor FROM counts JOIN g USING (feature) GROUP BY 1)
SELECT sample_id, feature, round(log2(value / factor + 1), 6) AS value, 'median_of_ratios' AS normalization, true AS whole_matrix FROM counts LEFT JOIN f USING (sample_id)
UNION ALL SELECT sample_id, feature, round(log2(value * 1e6 / sum(value) OVER (PARTITION BY sample_id) + 1), 6), 'log2cpm', false FROM counts""")
def n3_normalised(spark, sf_dir):
    c = _counts(spark, sf_dir)
    out = normalize.normalised(c, "median_of_ratios", least_features=1).unionByName(normalize.normalised(c, "log2cpm"))
    return out.select("sample_id", "feature", F.round("value", 6).alias("value"), "normalization", "whole_matrix")


@query(f"""WITH {_COUNTS_SQL}, h AS (SELECT *, sample_id::BIGINT % 3 AS own FROM counts), k AS (SELECT DISTINCT own::INT AS outer_fold FROM h), n AS (SELECT outer_fold, count(DISTINCT sample_id) AS n FROM h, k WHERE own <> outer_fold GROUP BY 1),
g AS (SELECT outer_fold, feature, avg(ln(value)) AS lg FROM h, k JOIN n USING (outer_fold) WHERE own <> outer_fold GROUP BY ALL HAVING min(value) > 0 AND count(*) = any_value(n)), f AS (SELECT outer_fold, sample_id, exp(median(ln(value) - lg)) AS factor FROM h JOIN g USING (feature) GROUP BY ALL)
SELECT outer_fold, sample_id, feature, round(log2(value / factor + 1), 6) AS value FROM h CROSS JOIN k LEFT JOIN f USING (outer_fold, sample_id)""")
def n3_normalised_by_fold(spark, sf_dir):
    c = _counts(spark, sf_dir)
    folds = c.select("sample_id", F.expr("int(bigint(sample_id) % 3)").alias("outer_fold")).distinct()
    return normalize.normalised_by_fold(c, folds, 3, "median_of_ratios", least_features=1).select("outer_fold", "sample_id", "feature", F.round("value", 6).alias("value"))


@query()
def n3_normalised_tmm(spark, sf_dir):
    return normalize.normalised(_counts(spark, sf_dir), "tmm").select("sample_id", "feature", "value", "normalization", "whole_matrix")


@query("""WITH f AS (SELECT 's' || l_suppkey::VARCHAR AS flag FROM lineitem GROUP BY l_suppkey HAVING avg(l_discount) > 0.0501), v AS (SELECT l_returnflag AS modality, avg((l_linestatus = 'F')::INT) > 0.9 AS confounded, avg(l_tax) > 0.04 AS dead FROM lineitem GROUP BY 1),
c AS (SELECT avg((l_quantity > 20)::INT) > 0.9 AS leak FROM lineitem GROUP BY l_linenumber), s AS (SELECT (SELECT count(*) FROM f) AS n_flags, (SELECT bool_or(leak) FROM c) AS leakage,
(SELECT string_agg(modality, ', ' ORDER BY modality) FROM v WHERE confounded) AS con, (SELECT string_agg(modality, ', ' ORDER BY modality) FROM v WHERE dead) AS dead, (SELECT string_agg('missingness or batch: ' || flag, '; ' ORDER BY flag) FROM (SELECT flag FROM f ORDER BY flag LIMIT 3)) AS fl)
SELECT CASE WHEN leakage OR n_flags >= 3 THEN 'high concern' WHEN n_flags >= 1 THEN 'moderate concerns' ELSE 'clean' END AS rating, n_flags, leakage,
 coalesce(nullif(concat_ws('; ', 'correct batch effects: ' || con, 'consider dropping: ' || dead, fl, CASE WHEN leakage THEN 'audit splits for leakage' END), ''), 'nothing critical') AS advice FROM s""")
def u9_hygiene(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    flags = li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("flag")).agg(F.avg("l_discount").alias("m")).filter("m > 0.0501")
    seen = li.groupBy(F.col("l_returnflag").alias("modality")).agg((F.avg((F.col("l_linestatus") == "F").cast("int")) > 0.9).alias("batch_confounded"), F.avg("l_tax").alias("m"))
    seen = seen.withColumn("verdict", F.when(F.col("m") > 0.04, "no detectable signal").otherwise("predictive"))
    leaks = li.groupBy("l_linenumber").agg((F.avg((F.col("l_quantity") > 20).cast("int")) > 0.9).alias("leak"))
    return ledger.hygiene(flags, seen, leaks, n_samples=60)


_NEST_SQL = """s AS (SELECT c_custkey AS i, c_custkey // 3 AS g, (c_custkey // 3 % 4)::INT AS own FROM customer), k AS (SELECT DISTINCT own AS outer_fold FROM s), tr AS (SELECT outer_fold, i, g FROM s, k WHERE own <> outer_fold),
p AS (SELECT outer_fold, i, g, CASE WHEN i % 17 = 0 THEN i % 3 ELSE g % 3 END AS f FROM s, k WHERE (own <> outer_fold AND NOT (outer_fold = 1 AND i % 13 = 0)) OR (outer_fold = 2 AND i % 19 = 0)),
v AS (SELECT outer_fold, 'outside of training' AS rule, count(*) AS n FROM p ANTI JOIN tr USING (outer_fold, i) GROUP BY ALL UNION ALL SELECT outer_fold, 'left out', count(*) FROM tr ANTI JOIN p USING (outer_fold, i) GROUP BY ALL
UNION ALL SELECT outer_fold, 'divided group', count(*) FROM (SELECT outer_fold, g FROM p GROUP BY ALL HAVING count(DISTINCT f) > 1) GROUP BY ALL),
r AS (SELECT unnest(['outside of training', 'left out', 'placed twice', 'divided group', 'empty side']) AS rule) SELECT outer_fold, rule, coalesce(n, 0) AS n FROM k CROSS JOIN r LEFT JOIN v USING (outer_fold, rule)"""


@query(f"WITH {_NEST_SQL}")
def x10_inner_violations(spark, sf_dir):
    """Inner folds with planted faults: samples left out in one outer fold, strangers in another, groups divided in all."""
    key, g = F.col("c_custkey"), F.floor(F.col("c_custkey") / 3)
    s = table(spark, sf_dir, "customer").select(key.alias("sample_id"), g.alias("group_id"), (g % 4).cast("int").alias("own"))
    k = s.select(F.col("own").alias("outer_fold")).distinct()
    inside = (F.col("own") != F.col("outer_fold")) & ~((F.col("outer_fold") == 1) & (F.col("sample_id") % 13 == 0))
    placed = s.join(F.broadcast(k)).filter(inside | ((F.col("outer_fold") == 2) & (F.col("sample_id") % 19 == 0)))
    fold = F.when(F.col("sample_id") % 17 == 0, F.col("sample_id") % 3).otherwise(F.col("group_id") % 3).cast("int").alias("inner_fold")
    return splits.inner_violations(s, s.select("sample_id", F.col("own").alias("outer_fold")), placed.select("sample_id", "outer_fold", fold))


@query("SELECT outer_fold, count(*) AS groups, round(var_pop(y), 2) AS variance FROM (SELECT (o_custkey % 5)::INT AS outer_fold, o_custkey, min(o_totalprice) AS y FROM orders GROUP BY ALL) GROUP BY 1")
def x11_regression_support(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("group_id"), F.col("o_totalprice").alias("y"))
    folds = o.select("sample_id", (F.col("group_id") % 5).cast("int").alias("outer_fold"))
    return splits.regression_support(o, folds, "y").withColumn("variance", F.round("variance", 2))


@query(f"""WITH {A.SURVIVAL_SQL}, f AS (SELECT *, (sample_id::BIGINT % 3)::INT AS own FROM surv), k AS (SELECT DISTINCT own AS outer_fold FROM f)
SELECT outer_fold, (SELECT count(*) FROM f WHERE own <> outer_fold AND event = 1) AS training_events, (SELECT count(*) FROM f x, f y WHERE x.own = outer_fold AND y.own = outer_fold AND x.event = 1 AND y.time > x.time) AS pairs FROM k""")
def x11_survival_support(spark, sf_dir):
    s = A.survival(spark, sf_dir).withColumn("group_id", F.col("sample_id"))
    return splits.survival_support(s, s.select("sample_id", F.expr("int(bigint(sample_id) % 3)").alias("outer_fold")))


def _roles(spark, sf_dir):
    q = F.col("l_quantity")
    called = F.when(q > 40, "X").when(q > 20, "A").when(F.col("l_tax") > 0.01, "N")
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n_samples"), F.col("l_suppkey").alias("dataset"), F.col("l_returnflag").alias("truth"), called.alias("called"))


@query("""WITH p AS (SELECT l_linenumber AS n_samples, l_returnflag AS truth, CASE WHEN l_quantity > 40 THEN 'X' WHEN l_quantity > 20 THEN 'A' WHEN l_tax > 0.01 THEN 'N' END AS called FROM lineitem),
r AS (SELECT DISTINCT n_samples, truth AS role FROM p), s AS (SELECT n_samples, role, count(*) FILTER (truth = role) AS t, count(*) FILTER (called = role) AS c, count(*) FILTER (truth = role AND called = role) AS h FROM r JOIN p USING (n_samples) GROUP BY ALL)
SELECT n_samples, sum(t)::BIGINT AS n, count(*) AS roles, round(avg(2 * h / (t + c)), 6) AS role_f1 FROM s GROUP BY 1""")
def r9_pooled_role_f1(spark, sf_dir):
    return rows.pooled_role_f1(_roles(spark, sf_dir), ["n_samples"]).withColumn("role_f1", F.round("role_f1", 6))


@query()
def r9_pooled_role_interval(spark, sf_dir):
    return rows.pooled_role_interval(_roles(spark, sf_dir), ["n_samples"], "dataset")
