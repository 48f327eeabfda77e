"""Queries over the ledger's evidence: batch verdicts, trust checks, families of claims, audits, calibration, survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from modalens.operators import batch, groups, ledger, metrics, missingness, models, rows, survival
from modalens.plans.modelling import _folds, _users
from modalens.plans.scores import predictions
from modalens.session import table
from modalens.sources import adapters as A

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("""WITH s AS (SELECT l_returnflag AS modality, avg((l_linestatus = 'F')::INT) > 0.6 AS structured FROM lineitem GROUP BY 1),
a AS (SELECT l_returnflag AS x, count(*) AS a FROM lineitem GROUP BY 1), b AS (SELECT l_linestatus AS y, count(*) AS b FROM lineitem GROUP BY 1), c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY ALL),
v AS (SELECT sum(o * o * 1.0::DOUBLE / (a * b)) - 1 AS v2 FROM c JOIN a USING (x) JOIN b USING (y)) SELECT modality, structured, sqrt(v2) > 0.2 AS confounded, structured AND sqrt(v2) > 0.2 AS batch_confounded FROM s, v""")
def u5_batch_confounded(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    seen = li.groupBy(F.col("l_returnflag").alias("modality")).agg((F.avg((F.col("l_linestatus") == "F").cast("int")) > 0.6).alias("structured"))
    study = batch.confounded(missingness.contingency_chi2(li.withColumn("study", F.lit(0)), ["study"], "l_returnflag", "l_linestatus"))
    return ledger.batch_confounded(seen, study)


@query("""WITH s AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT count(DISTINCT o_custkey) AS g FROM orders), c AS (SELECT max(score) AS m FROM (SELECT avg((l_quantity > 20)::INT) AS score FROM lineitem GROUP BY l_linenumber)),
b AS (SELECT count(*) FILTER (l_returnflag = 'A') AS k FROM (SELECT DISTINCT l_returnflag FROM lineitem)), t AS (SELECT count(*) FILTER (p < 0.0499) AS k FROM (SELECT avg(l_discount) AS p FROM lineitem GROUP BY l_suppkey))
SELECT 'controls at chance' AS "check", CASE WHEN m > 0.45 + 0.12 THEN 'fail' ELSE 'pass' END AS status FROM c UNION ALL SELECT 'independent subjects', 'pass' UNION ALL SELECT 'sample size', CASE WHEN g >= 40 THEN 'pass' ELSE 'caution' END FROM g
UNION ALL SELECT 'balanced classes', CASE WHEN min(n) >= 0.4 * max(n) THEN 'pass' ELSE 'caution' END FROM s UNION ALL SELECT 'no batch confounding', CASE WHEN k > 0 THEN 'caution' ELSE 'pass' END FROM b
UNION ALL SELECT 'no target-linked missingness', CASE WHEN k > 0 THEN 'caution' ELSE 'pass' END FROM t""")
def u10_trust_checklist(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    controls = li.groupBy("l_linenumber").agg(F.avg((F.col("l_quantity") > 20).cast("int")).alias("score")).withColumn("ci_low", F.lit(None).cast("double"))
    flags = li.select(F.col("l_returnflag").alias("modality"), (F.col("l_returnflag") == "A").alias("batch_confounded")).distinct()
    tests = li.groupBy("l_suppkey").agg((F.avg("l_discount") < 0.0499).alias("flag"))
    return ledger.checklist(A.orders(spark, sf_dir).samples, ledger.leaks(controls, 0.45), flags, tests, "group_id", "label").select("check", "status")


@query(f"""WITH {A.EMBEDDINGS_SQL}, r AS (SELECT modality, feature, round(abs(corr(value, y)), 6) AS importance FROM cells JOIN samples USING (sample_id) GROUP BY ALL)
SELECT modality, feature, importance, row_number() OVER w AS place FROM r WINDOW w AS (PARTITION BY modality ORDER BY importance DESC, feature) QUALIFY row_number() OVER w <= 8""")
def u11_top_features(spark, sf_dir):
    s = A.embeddings(spark, sf_dir)
    strength = F.round(F.abs(F.corr("value", F.col("y").cast("double"))), 6).alias("importance")
    return ledger.top_features(s.cells.join(s.samples, "sample_id").groupBy("modality", "feature").agg(strength), 8)


@query("""WITH a AS (SELECT l_returnflag AS family, l_linestatus AS condition, l_linenumber AS n, l_quantity > 40 AS alarm, l_tax > 0.0799 AS leak, l_discount < 0.01 AS fc, l_quantity < 5 AS fa, l_discount * 10 AS f1, l_tax AS ctrl FROM lineitem),
g AS (SELECT family, condition, n, count(*) AS datasets, avg(f1) AS mean_role_f1, count(*) FILTER (alarm) AS alarms, bool_or(leak) AS any_leak, count(*) FILTER (fc) AS false_certifications, count(*) FILTER (fa) AS false_alarms, avg(ctrl) AS mean_control FROM a GROUP BY ALL),
p AS (SELECT *, alarms / datasets AS p, 1.959963984540054 AS z FROM g)
SELECT family, condition, n, datasets, round(mean_role_f1, 6) AS mean_role_f1, alarms, round((p + z*z/(2*datasets) - z*sqrt(p*(1-p)/datasets + z*z/(4*datasets*datasets))) / (1 + z*z/datasets), 6) AS alarm_low,
 round((p + z*z/(2*datasets) + z*sqrt(p*(1-p)/datasets + z*z/(4*datasets*datasets))) / (1 + z*z/datasets), 6) AS alarm_high, round(sqrt(p*(1-p)/datasets), 6) AS alarm_mcse, false_certifications, CASE WHEN any_leak THEN datasets ELSE 0 END AS certification_base,
 false_alarms, CASE WHEN any_leak THEN 0 ELSE datasets END AS alarm_base, round(mean_control, 6) AS mean_control FROM p""")
def r9_audit_summary(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("condition"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") > 40).alias("alarm"), (F.col("l_tax") > 0.0799).alias("leak"),
        (F.col("l_discount") < 0.01).alias("false_certification"), (F.col("l_quantity") < 5).alias("false_alarm"), (F.col("l_discount") * 10).alias("role_f1"), F.array("l_tax", F.lit(None).cast("double")).alias("controls"),
    )
    out = rows.audit_summary(a, ["family", "condition", "n"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_role_f1", "alarm_low", "alarm_high", "alarm_mcse", "mean_control")})


@query("""WITH t AS (SELECT l_returnflag AS family, l_suppkey AS test, avg(l_discount) / 50 AS p FROM lineitem GROUP BY ALL)
SELECT family, count(*) AS n_tests, round(min(p), 9) AS min_p, round(least(1, min(p) * count(*)), 7) AS min_p_holm, least(1, min(p) * count(*)) < 0.05 AS warning FROM t GROUP BY 1""")
def g12_families(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_suppkey").alias("test")).agg((F.avg("l_discount") / 50).alias("p"))
    return groups.families(t).withColumns({"min_p": F.round("min_p", 9), "min_p_holm": F.round("min_p_holm", 7)})


@query()
def e14_calibration_line(spark, sf_dir):
    return metrics.calibration_line(predictions(spark, sf_dir), ["model"])


@query()
def g9_batch_association(spark, sf_dir):
    """Log-rank scores with permutation p, of events and of censoring."""
    return survival.batch_association(_users(spark, sf_dir), reps=199)


def _survival_study(spark, sf_dir):
    """Users, with their first week's counts and means by event type as two modalities."""
    s = A.survival(spark, sf_dir)
    first = table(spark, sf_dir, "events").filter(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) < 7)
    per = first.groupBy(F.col("user_id").cast("string").alias("sample_id"), F.col("event_type").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("counts"), F.avg("value").alias("means"))
    cells = per.unpivot(["sample_id", "feature"], ["counts", "means"], "modality", "value")
    return cells, s.select("sample_id", "time", "event")


@query()
def m19_cox_grid(spark, sf_dir):
    """M12 and M19: ridge Cox on components of every training side, each modality, the fusion and the fusion without each."""
    cells, samples = _survival_study(spark, sf_dir)
    folds = samples.select("sample_id", F.expr("int(bigint(sample_id) % 3)").alias("outer_fold"))
    return survival.cox_grid(cells, samples, folds)


@query()
def m27_batch_adjusted(spark, sf_dir):
    """The fusion on cells centred by batch inside training folds."""
    s = A.embeddings(spark, sf_dir)
    return models.batch_adjusted(s.cells, s.samples, _folds(s)).groupBy("model", "outer_fold").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") == F.col("y")).cast("int")).alias("accuracy"))
