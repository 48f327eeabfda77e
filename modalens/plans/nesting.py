"""Queries over nested models, permuted features, local scales, claims, subgroups and the gate of result rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from modalens import audit as whole
from modalens.operators import align, bootstrap, clean, fusion, groups, ledger, missingness, models, nested, rows, scales, splits
from modalens.plans.missing_batch import MISSING_SQL
from modalens.plans.modelling import _REP_SQL, _vectors, _z
from modalens.plans.scores import PRED_SQL, auroc_sql, predictions, rounded
from modalens.session import table
from modalens.sources import adapters as A
from modalens.sources import matrix
from modalens.storage import scratch, written

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _profiles(spark, sf_dir):
    """Distances of users' missingness profiles, and their rates of days with an error."""
    s = A.events_day(spark, sf_dir)
    rep = groups.missing_profile(s.cells, s.samples, s.features).withColumnRenamed("missing", "value")
    users = s.samples.groupBy("group_id").agg(F.avg("y").alias("rate")).withColumn("batch", F.col("group_id").cast("long") % 3)
    return groups.distances(rep), users


def _scaled(out):
    return rounded(out, "statistic", "at_all")


_LOCAL_SQL = f"""WITH {_REP_SQL}, g AS (SELECT DISTINCT group_id, group_id::INT % 5 AS t FROM samples), n AS (SELECT count(*)::DOUBLE AS n FROM g),
d AS (SELECT p.group_id AS a, q.group_id AS b, avg(abs(p.value - q.value)) AS d, any_value(abs(u.t - v.t))::DOUBLE AS e FROM z p JOIN z q USING (modality, feature) JOIN g u ON u.group_id = p.group_id JOIN g v ON v.group_id = q.group_id GROUP BY ALL),
x AS (SELECT a, b, CASE WHEN a = b THEN 0 ELSE d - sum(d) OVER (PARTITION BY b) / (n - 1) END AS x, dense_rank() OVER (PARTITION BY b ORDER BY d) AS k FROM d, n),
y AS (SELECT a, b, CASE WHEN a = b THEN 0 ELSE e - sum(e) OVER (PARTITION BY b) / (n - 1) END AS x, dense_rank() OVER (PARTITION BY b ORDER BY e) AS k FROM d, n),
c AS (SELECT x.k AS k, y.k AS l, sum(x.x * y.x) AS s FROM x JOIN y ON y.a = x.b AND y.b = x.a GROUP BY ALL),
grid AS (SELECT k, l, coalesce(s, 0) AS s FROM (SELECT DISTINCT k FROM x) CROSS JOIN (SELECT DISTINCT k AS l FROM y) LEFT JOIN c USING (k, l)),
up AS (SELECT k, l, sum(s) OVER (PARTITION BY l ORDER BY k) AS s FROM grid), cum AS (SELECT k, l, sum(s) OVER (PARTITION BY k ORDER BY l) AS s FROM up),
ex AS (SELECT k, sum(sum(x)) OVER (ORDER BY k) AS e FROM x GROUP BY k), ey AS (SELECT k AS l, sum(sum(x)) OVER (ORDER BY k) AS e FROM y GROUP BY k),
wx AS (SELECT greatest(p.k, q.k) AS k, sum(p.x * q.x) AS v FROM x p JOIN x q ON p.a = q.b AND p.b = q.a GROUP BY 1), wy AS (SELECT greatest(p.k, q.k) AS k, sum(p.x * q.x) AS v FROM y p JOIN y q ON p.a = q.b AND p.b = q.a GROUP BY 1),
vx AS (SELECT k, sum(coalesce(v, 0)) OVER (ORDER BY k) - e * e / (n * n) AS v FROM ex LEFT JOIN wx USING (k), n), vy AS (SELECT l, sum(coalesce(v, 0)) OVER (ORDER BY l) - e * e / (n * n) AS v FROM ey LEFT JOIN (SELECT k AS l, v FROM wy) USING (l), n)
SELECT k, l, round(CASE WHEN vx.v > 1e-12 AND vy.v > 1e-12 THEN least(1, (s - ex.e * ey.e / (n * n)) / sqrt(vx.v * vy.v)) ELSE 0 END, 5) AS correlation FROM cum JOIN ex USING (k) JOIN ey USING (l) JOIN vx USING (k) JOIN vy USING (l), n"""


def _structure(spark, sf_dir):
    d = groups.distances(_z(spark, sf_dir))
    names = d.select(F.col("a").alias("group_id")).unionByName(d.select(F.col("b").alias("group_id"))).distinct()
    return d, names.withColumn("t", F.col("group_id").cast("int") % 5)


@query(_LOCAL_SQL)
def g5_local_correlations(spark, sf_dir):
    """The map of all local scales between groups' representations and a target of theirs."""
    d, named = _structure(spark, sf_dir)
    return scales.local_map(d, scales.label_distances(d, named, "t")).withColumn("correlation", F.round("correlation", 5))


@query()
def g5_local_scales(spark, sf_dir):
    d, users = _profiles(spark, sf_dir)
    return _scaled(scales.multiscale(d, scales.label_distances(d, users, "rate"), reps=199))


@query()
def g6_local_scales(spark, sf_dir):
    d, named = _structure(spark, sf_dir)
    return _scaled(scales.multiscale(d, scales.label_distances(d, named, "t", "categorical"), reps=199))


@query()
def g8_local_scales(spark, sf_dir):
    """Midranks of a continuous target against other sites."""
    d, users = _profiles(spark, sf_dir)
    ranked = groups.average_ranks(users.withColumn("_all", F.lit(0)), ["_all"], "rate", "r")
    return _scaled(scales.multiscale(scales.label_distances(d, ranked, "batch", "categorical"), scales.label_distances(d, ranked, "r"), reps=199))


def _tested(spark, sf_dir, target, kind, reps):
    s = A.events_day(spark, sf_dir)
    profile = groups.missing_profile(s.cells, s.samples, s.features)
    users = s.samples.groupBy("group_id").agg(F.avg("y").alias("rate")).withColumn("batch", F.col("group_id").cast("long") % 3)
    return groups.feature_association(profile, users, target, reps, kind=kind)


_RANK_SQL = f"""{A.EVENTS_DAY_SQL}, n AS (SELECT group_id, count(DISTINCT sample_id) AS n, avg(y) AS rate, any_value(group_id::BIGINT) % 3 AS batch FROM samples GROUP BY 1), s AS (SELECT group_id, modality, feature, count(DISTINCT sample_id) AS s FROM cells JOIN samples USING (sample_id) GROUP BY ALL),
p AS (SELECT group_id, modality, feature, 1 - coalesce(s, 0) / n AS v, rate, batch FROM n CROSS JOIN features LEFT JOIN s USING (group_id, modality, feature)),
r AS (SELECT *, rank() OVER (PARTITION BY modality, feature ORDER BY v) + (count(*) OVER (PARTITION BY modality, feature, v) - 1) / 2 AS rv, rank() OVER (PARTITION BY modality, feature ORDER BY rate) + (count(*) OVER (PARTITION BY modality, feature, rate) - 1) / 2 AS rt FROM p)"""


@query(f"WITH {_RANK_SQL} SELECT modality, feature, round(coalesce(abs(corr(rv, rt)), 0), 6) AS observed FROM r GROUP BY ALL")
def g11_observed(spark, sf_dir):
    return _tested(spark, sf_dir, "rate", "continuous", 1).select("modality", "feature", F.round("observed", 6).alias("observed"))


@query(f"""WITH {_RANK_SQL}, c AS (SELECT modality, feature, batch, sum(rv) AS s, count(*) AS m FROM r GROUP BY ALL), t AS (SELECT modality, feature, sum(k::DOUBLE * k * k - k) AS ties FROM (SELECT modality, feature, v, count(*) AS k FROM r GROUP BY ALL) GROUP BY ALL),
h AS (SELECT modality, feature, sum(m)::DOUBLE AS n, sum(s * s / m) AS q FROM c GROUP BY ALL) SELECT modality, feature, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 5) AS observed FROM h JOIN t USING (modality, feature)""")
def g11_observed_by_class(spark, sf_dir):
    return _tested(spark, sf_dir, "batch", "categorical", 1).select("modality", "feature", F.round("observed", 5).alias("observed"))


@query()
def g11_association_by_class(spark, sf_dir):
    """Kruskal-Wallis of each feature's missing share by site, with p and the p of the maximum over features."""
    return _tested(spark, sf_dir, "batch", "categorical", 999)


@query()
def g11_summary(spark, sf_dir):
    return groups.association_summary(_tested(spark, sf_dir, "rate", "continuous", 999))


@query("""WITH t AS (SELECT l_returnflag AS claim, l_linestatus AS modality, 'm' || (l_linenumber % 2) AS method, CASE WHEN l_linenumber <= 2 THEN 'primary' ELSE 'secondary' END AS evidence, avg(l_discount) / 3 AS p FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber),
e AS (SELECT claim, modality, count(*) AS n FROM t WHERE evidence = 'primary' GROUP BY ALL), c AS (SELECT claim, sum(n)::BIGINT AS eligible, bool_or(claim = 'N' AND modality = 'F') AS extra FROM e GROUP BY 1),
r AS (SELECT *, least(1, p * (count(*) OVER (PARTITION BY claim) - row_number() OVER w + 1)) AS raw FROM t WHERE evidence = 'primary' WINDOW w AS (PARTITION BY claim ORDER BY p, modality, method)),
h AS (SELECT *, max(raw) OVER (PARTITION BY claim ORDER BY p, modality, method ROWS UNBOUNDED PRECEDING) AS holm FROM r),
f AS (SELECT claim, count(*) AS n_primary, count(*) FILTER (holm <= 0.05) AS warnings, min(holm) AS min_holm, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM h GROUP BY 1),
s AS (SELECT claim, count(*) AS n_secondary, min(p) AS low FROM t WHERE evidence = 'secondary' GROUP BY 1)
SELECT claim, CASE WHEN claim = 'N' THEN 'refused' ELSE 'tested' END AS status, eligible + (claim = 'N')::INT AS eligible, n_primary, CASE WHEN claim <> 'N' THEN warnings END AS warnings, CASE WHEN claim <> 'N' THEN warnings > 0 END AS any_warning,
 round(CASE WHEN claim <> 'N' THEN min_holm END, 7) AS min_holm, CASE WHEN claim <> 'N' THEN methods END AS methods, n_secondary, round(low, 9) AS min_p_secondary FROM c JOIN f USING (claim) JOIN s USING (claim)""")
def g12_claims(spark, sf_dir):
    """Claims over primary and secondary tests; one expects a primary test more than it has and is refused."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("claim"), F.col("l_linestatus").alias("modality"), "l_linenumber").agg((F.avg("l_discount") / 3).alias("p"))
    t = t.select("claim", "modality", F.concat(F.lit("m"), (F.col("l_linenumber") % 2).cast("string")).alias("method"), F.when(F.col("l_linenumber") <= 2, "primary").otherwise("secondary").alias("evidence"), "p")
    first = F.col("claim").eqNullSafe("N") & (F.col("modality") == F.lit("F"))
    expected = t.filter("evidence = 'primary'").groupBy("claim", "modality").agg(F.count(F.lit(1)).alias("n"))
    expected = expected.withColumn("n", F.col("n") + F.when(first, 1).otherwise(0))
    return groups.claims(t, expected).withColumns({"min_holm": F.round("min_holm", 7), "min_p_secondary": F.round("min_p_secondary", 9)})


def _nested(spark, sf_dir):
    s, samples, folds = _vectors(spark, sf_dir, 2)
    return s.cells, samples, folds, splits.inner(samples, folds, 2, "y")


@query()
def m16_nested_stacking(spark, sf_dir):
    from modalens.operators import metrics

    return metrics.confusion_scores(nested.nested_stacking(*_nested(spark, sf_dir)), ["model"])


@query()
def m17_nested_best_single(spark, sf_dir):
    from modalens.operators import metrics

    return metrics.confusion_scores(nested.nested_best_single(*_nested(spark, sf_dir), make=models.logistic), ["model"])


@query(f"""WITH {PRED_SQL}, a AS ({auroc_sql('model, outer_fold').replace('round(', '(').replace(', 6)', ')')})
SELECT outer_fold, model AS modality, round(auroc, 6) AS auroc FROM a QUALIFY row_number() OVER (PARTITION BY outer_fold ORDER BY auroc DESC, model) = 1""")
def m17_choice(spark, sf_dir):
    """Which modality a fold takes, by its stored inner predictions."""
    p = predictions(spark, sf_dir).withColumnRenamed("model", "modality").withColumn("probs", F.array(1 - F.col("score"), F.col("score")))
    return nested.best_single(nested.inner_scores(p)).withColumn("auroc", F.round("auroc", 6))


_LINE_FOLDS_SQL = f"""{A.ORDERS_SQL}, f AS (SELECT sample_id, target - avg(target) OVER () AS y, (group_id::BIGINT % 3)::INT AS own FROM samples), k AS (SELECT DISTINCT own AS outer_fold FROM f), feats AS (SELECT DISTINCT modality, feature FROM cells),
tr AS (SELECT k.outer_fold, f.sample_id, f.y, modality, feature, c.value FROM f CROSS JOIN feats JOIN k ON own <> outer_fold LEFT JOIN cells c USING (sample_id, modality, feature)),
im AS (SELECT *, coalesce(value, median(value) OVER (PARTITION BY outer_fold, modality, feature)) AS v FROM tr), g AS (SELECT outer_fold, modality, feature, count(*) AS n, corr(v, y) ** 2 AS r2 FROM im GROUP BY ALL)"""


def _priced(spark, sf_dir):
    s = A.orders(spark, sf_dir)
    return s.cells, s.samples.withColumnRenamed("target", "y"), s.samples.select("sample_id", (F.col("group_id").cast("long") % 3).cast("int").alias("outer_fold"))


@query(f"WITH {_LINE_FOLDS_SQL} SELECT outer_fold, modality, feature, round(r2 / (1 - r2) * (n - 2), 4) AS f, row_number() OVER (PARTITION BY outer_fold ORDER BY r2 DESC, modality, feature) AS place FROM g")
def m4_selected_linear(spark, sf_dir):
    return models.selected_linear(*_priced(spark, sf_dir)).withColumn("f", F.round("f", 4)).withColumn("place", F.col("place").cast("long"))


@query()
def m10_forest_regression(spark, sf_dir):
    from modalens.operators import metrics

    return metrics.regression_scores(models.out_of_fold_regression(*_priced(spark, sf_dir), model="forest", make=lambda n: models.forest_regression(n, trees=50), top=4), ["model"])


@query()
def m11_boosting_regression(spark, sf_dir):
    from modalens.operators import metrics

    return metrics.regression_scores(models.out_of_fold_regression(*_priced(spark, sf_dir), model="boosting", make=lambda n: models.boosting_regression(n, rounds=20)), ["model"])


@query()
def m11_boosting_classes(spark, sf_dir):
    """Three classes, each against the rest."""
    from modalens.operators import metrics

    s, samples, folds = _vectors(spark, sf_dir, 3)
    return metrics.confusion_scores(models.out_of_fold(s.cells, samples, folds, lambda n: models.AgainstRest(lambda m: models.boosting(m, rounds=10), n), "boosting", top=16), ["model"])


@query()
def m18_intermediate_fusion(spark, sf_dir):
    from modalens.operators import metrics

    s, samples, folds = _vectors(spark, sf_dir, 2)
    return metrics.confusion_scores(fusion.intermediate_fusion(s.cells, samples, folds, rounds=3, steps=20), ["model"])


@query()
def m26_permutation_importance(spark, sf_dir):
    s, samples, folds = _vectors(spark, sf_dir, 2)
    return rounded(nested.permutation_importance(s.cells, samples, folds), "importance", "sd")


@query()
def u11_top_by_importance(spark, sf_dir):
    """The features whose permutation costs the fusion's model most."""
    s, samples, folds = _vectors(spark, sf_dir, 2)
    return ledger.top_features(rounded(nested.permutation_importance(s.cells, samples, folds), "importance"), 8)


@query(f"""WITH {A.SURVIVAL_SQL}, x AS (SELECT sample_id, unnest(['t', 'e', 'falls', 'x', 'flat']) AS feature, unnest([time, event::DOUBLE, 100 / time, x, 1.0]) AS value, time, event FROM surv),
p AS (SELECT feature, time, value, count(*) AS m FROM x GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY feature ORDER BY time) + dense_rank() OVER (PARTITION BY feature ORDER BY value) AS s FROM p),
o AS (SELECT feature, count(*) = count(DISTINCT time) AND count(*) = count(DISTINCT value) AND count(DISTINCT time) > 1 AND min(s) = max(s) AS inverted FROM r GROUP BY 1),
c AS (SELECT feature, bool_and(value = time) AS time_copy, bool_and(value = event) AS event_copy FROM x GROUP BY 1)
SELECT 'given' AS modality, feature, time_copy, event_copy, (time_copy OR event_copy) AND (SELECT bool_or(time_copy) AND bool_or(event_copy) FROM c) AS joint, inverted FROM c JOIN o USING (feature)""")
def m25_survival_copies(spark, sf_dir):
    s = A.survival(spark, sf_dir)
    planted = F.map_from_arrays(F.array(*map(F.lit, ("t", "e", "falls", "x", "flat"))), F.array("time", F.col("event").cast("double"), 100 / F.col("time"), "x", F.lit(1.0)))
    return models.survival_copies(s.select("sample_id", F.lit("given").alias("modality"), F.explode(planted).alias("feature", "value")), s)


@query(f"""WITH {PRED_SQL}, a AS ({auroc_sql('model, stratum')}) SELECT model, stratum, n, CASE WHEN n >= 20 THEN auroc END AS auroc FROM a""")
def e10_scored_strata(spark, sf_dir):
    strata, _ = bootstrap.subgroup_scores(predictions(spark, sf_dir), reps=20)
    return rounded(strata.select("model", "stratum", "n", "auroc"), "auroc")


@query()
def e10_subgroup_intervals(spark, sf_dir):
    return rounded(bootstrap.subgroup_scores(predictions(spark, sf_dir), reps=500)[0], "auroc", "ci_low", "ci_high")


@query()
def e10_subgroup_gap(spark, sf_dir):
    """Largest less smallest AUROC over strata, with the interval of the joint draws."""
    return rounded(bootstrap.subgroup_scores(predictions(spark, sf_dir), reps=500)[1], "gap", "ci_low", "ci_high")


@query()
def u4_control_gate(spark, sf_dir):
    """Controls with intervals from their own replicates, at the level 0.05 by their number, and the leak gate on them."""
    from modalens.operators import metrics

    p = predictions(spark, sf_dir).withColumn("model", F.concat(F.lit("control::"), "model"))
    score = metrics.auroc(p, ["model"]).select("model", F.col("auroc").alias("score"))
    out = ledger.leaks(score.join(bootstrap.control_intervals(p), "model", "left"))
    return rounded(out.select(F.col("model").alias("name"), "score", "ci_low", "ci_high", "leak"), "score", "ci_low", "ci_high")


_PHASES = "CASE WHEN l_linenumber = 1 THEN 'clean' WHEN l_linenumber = 2 THEN 'late' WHEN l_linenumber = 3 THEN 'broken' ELSE 'unruly' END"
_GATE_SQL = f"""WITH r AS (SELECT {_PHASES} AS phase, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_quantity::BIGINT) AS dataset_id, CASE WHEN l_linenumber = 3 AND l_suppkey % 2 = 0 THEN 'control' ELSE 'm' || l_returnflag END AS method_id, l_linestatus AS arm, l_linenumber AS repeat,
 CASE WHEN l_linenumber = 3 AND l_partkey % 50 = 0 THEN NULL WHEN l_linenumber = 3 AND l_suppkey % 2 = 0 THEN 0.7 ELSE l_discount * 5 END AS v, l_partkey % 100 = 0 AS excused,
 CASE WHEN l_linenumber > 3 AND l_quantity > 49 THEN 'other' ELSE 'main' END AS profile, l_linenumber = 2 AND l_tax > 0.07 AS stale FROM lineitem),
k AS (SELECT DISTINCT phase FROM r),
f AS (SELECT phase, 'row rule' AS rule, count(*) AS n FROM r WHERE v > 0.5 GROUP BY 1 UNION ALL SELECT phase, 'several profiles', 1 FROM r GROUP BY 1 HAVING count(DISTINCT profile) > 1
 UNION ALL SELECT phase, 'unexplained null', count(*) FROM r WHERE v IS NULL AND NOT excused GROUP BY 1 UNION ALL SELECT phase, 'control above chance', 1 FROM r WHERE method_id = 'control' GROUP BY 1 HAVING avg(v) > 0.62 UNION ALL SELECT phase, 'stale row', count(*) FROM r WHERE stale GROUP BY 1
 UNION ALL SELECT phase, 'repeated key', count(*) FROM (SELECT phase FROM r GROUP BY phase, dataset_id, method_id, arm, repeat HAVING count(*) > 1) GROUP BY 1
 UNION ALL SELECT 'absent', 'missing task', 1)"""


def _gated(spark, sf_dir):
    n = F.col("l_linenumber")
    phase = F.when(n == 1, "clean").when(n == 2, "late").when(n == 3, "broken").otherwise("unruly")
    control = (n == 3) & (F.col("l_suppkey") % 2 == 0)
    value = F.when((n == 3) & (F.col("l_partkey") % 50 == 0), None).when(control, 0.7).otherwise(F.col("l_discount") * 5)
    r = table(spark, sf_dir, "lineitem").select(
        phase.alias("phase"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey")], F.col("l_quantity").cast("long").cast("string")).alias("dataset_id"), F.when(control, "control").otherwise(F.concat(F.lit("m"), "l_returnflag")).alias("method_id"), F.col("l_linestatus").alias("arm"), n.alias("repeat"),
        value.alias("primary_value"), (F.col("l_partkey") % 100 == 0).alias("excused"), F.when((n > 3) & (F.col("l_quantity") > 49), "other").otherwise("main").alias("profile"), ((n == 2) & (F.col("l_tax") > 0.07)).alias("late"),
    )
    key = ["phase", "dataset_id", "method_id", "arm", "repeat"]
    lost = spark.createDataFrame([("absent", "d", "m", "a", 1)], "phase string, dataset_id string, method_id string, arm string, repeat long")
    expected = r.select("phase", "dataset_id", "method_id", "arm", F.col("repeat").cast("long")).unionByName(lost)
    return rows.record_gate(r.withColumn("repeat", F.col("repeat").cast("long")), r.filter("excused").select(*key).withColumn("repeat", F.col("repeat").cast("long")), expected, {"primary_value": {"range": (0.0, 0.5)}}, stale=F.col("late"))




@query(f"{_GATE_SQL} SELECT phase, rule, CASE WHEN rule = 'stale row' THEN 'warning' ELSE 'error' END AS severity, n FROM f")
def r7_findings(spark, sf_dir):
    return _gated(spark, sf_dir)[0]


@query(f"""{_GATE_SQL}, e AS (SELECT phase FROM k UNION SELECT 'absent'), g AS (SELECT e.phase, coalesce(sum(n) FILTER (rule <> 'stale row'), 0)::BIGINT AS errors, coalesce(sum(n) FILTER (rule = 'stale row'), 0)::BIGINT AS warnings FROM e LEFT JOIN f USING (phase) GROUP BY 1)
SELECT phase, errors, warnings, CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM g""")
def r7_gate(spark, sf_dir):
    """Verdicts of four phases with planted faults and of one that was expected and has no rows."""
    return _gated(spark, sf_dir)[1]


def _landed(spark, sf_dir):
    """Orders as a landed study: moments of their lines and of their parts, whether they are closed, by customer and priority."""
    s = A.orders(spark, sf_dir)
    samples = s.samples.select("sample_id", (F.col("label") == "F").cast("int").alias("y"), "group_id", "batch")
    folder = scratch(spark, "landed")
    matrix.write_dataset(s.cells, samples, folder)
    return whole.audit_files(spark, folder, folds=3, reps=200)


@query()
def audit_verdicts(spark, sf_dir):
    """The whole audit, from landed files to what each modality adds."""
    return rounded(_landed(spark, sf_dir).verdicts, "alone", "gain", "gain_p", "cka")


@query("""WITH r AS (SELECT l_orderkey::VARCHAR AS s, CASE WHEN l_linenumber % 3 > 0 THEN 'G' || l_suppkey END AS g, l_suppkey AS e, l_quantity AS v FROM lineitem)
SELECT s AS sample_id, 'rna' AS modality, coalesce(g, e::VARCHAR) AS feature, round(avg(v), 6) AS value FROM r GROUP BY ALL""")
def s6_molecular_cells(spark, sf_dir):
    """Records with a nested gene, written and read as JSON; a third have no symbol."""
    at, symbol = scratch(spark, "molecular"), F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("G"), F.col("l_suppkey").cast("string")))
    rows_ = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("sampleId"), F.struct(symbol.alias("hugoGeneSymbol")).alias("gene"), F.col("l_suppkey").alias("entrezGeneId"), F.col("l_quantity").alias("value"))
    rows_.write.json(at)
    return rounded(matrix.molecular_cells(spark.read.json(at), "rna"), "value")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders)
SELECT o_orderkey::VARCHAR AS "sampleId", o_orderpriority AS "PRIORITY", o_orderstatus AS "STATUS", c_nationkey::VARCHAR AS "NATION", c_mktsegment AS "SEGMENT", o_custkey::VARCHAR AS "PATIENT_ID" FROM o LEFT JOIN customer ON c_custkey = o_custkey""")
def s7_joined_clinical(spark, sf_dir):
    """Customers as the patients of orders; both have a status, of which the order's stands."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    attrs = lambda *xs: F.explode(F.array(*[F.struct(F.lit(n).alias("attr"), F.col(v).cast("string").alias("value"), F.lit(i).alias("position")) for i, (n, v) in enumerate(xs)])).alias("x")
    own = o.select(F.col("o_orderkey").cast("string").alias("sampleId"), F.col("o_custkey").cast("string").alias("patientId"), attrs(("STATUS", "o_orderstatus"), ("PRIORITY", "o_orderpriority"))).select("sampleId", "patientId", "x.*")
    other = c.select(F.col("c_custkey").cast("string").alias("patientId"), attrs(("STATUS", "c_mktsegment"), ("SEGMENT", "c_mktsegment"), ("NATION", "c_nationkey"))).select("patientId", "x.*")
    return matrix.joined_clinical(own, other, "position")


@query("SELECT l_linenumber::VARCHAR AS sample_id, 'metabolites' AS modality, l_suppkey::VARCHAR AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY ALL")
def s10_json_documents(spark, sf_dir):
    """Documents of all three forms: lists, maps from numbers, single records."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").cast("string").alias("k")).agg(F.sum("l_quantity").cast("string").alias("v"))
    one = per.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("DATA"))
    one = one.select((F.col("l_suppkey") % 3).alias("form"), F.floor(F.col("l_suppkey") / 30).alias("doc"), "l_suppkey", F.struct(F.col("l_suppkey").cast("string").alias("metabolite_name"), "DATA").alias("r"))
    docs = one.filter("form = 0").groupBy("doc").agg(F.to_json(F.collect_list("r")).alias("j")).select("j")
    docs = docs.unionByName(one.filter("form = 1").groupBy("doc").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("l_suppkey").cast("string"), "r")))).alias("j")).select("j"))
    return matrix.json_document_cells(docs.unionByName(one.filter("form = 2").select(F.to_json("r").alias("j"))), "j", "metabolites")


@query(f"""WITH {A.EVENTS_DAY_SQL}, {MISSING_SQL} SELECT modality, count(*) AS n_samples, round(avg(missing_fraction), 6) AS mean_fraction, round(max(missing_fraction), 6) AS max_fraction FROM missing GROUP BY 1""")
def k3_public_view(spark, sf_dir):
    s = A.events_day(spark, sf_dir)
    tables = {"missing": missingness.sample_missing(s.cells, s.samples, s.features), "batches": s.samples.select("sample_id", "batch")}
    return rounded(matrix.public_tables(tables)["missing_summary"], "mean_fraction", "max_fraction")


@query("SELECT o_orderkey, o_orderstatus AS y FROM orders WHERE o_orderstatus <> 'P'")
def f8_with_target(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(" ").alias("y"))
    return clean.with_target(o, "y")


@query("SELECT o_orderkey::VARCHAR AS sample_id, 'lines' AS modality, o_orderpriority AS batch FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 'parts', o_orderstatus FROM orders")
def j6_sample_batches(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), "o_orderpriority", "o_orderstatus")
    return align.sample_batches(o, {"lines": "o_orderpriority", "parts": "o_orderstatus"}, A.orders(spark, sf_dir).features)


@query("""WITH a AS (SELECT DISTINCT doc_id::VARCHAR AS s FROM documents), b AS (SELECT DISTINCT vec_id::VARCHAR AS s FROM embeddings), k AS (SELECT DISTINCT doc_id::VARCHAR AS s FROM labels), m AS (SELECT count(*) AS matched_all FROM k WHERE s IN (SELECT s FROM a) AND s IN (SELECT s FROM b)),
o AS (SELECT 'emb' AS modality, s FROM b WHERE s NOT IN (SELECT s FROM k) UNION ALL SELECT 'text', s FROM a WHERE s NOT IN (SELECT s FROM k)), f AS (SELECT string_agg(s, ', ' ORDER BY s) AS odd FROM (SELECT s FROM o WHERE modality = (SELECT min(modality) FROM o) ORDER BY s LIMIT 3))
SELECT (SELECT count(*) FROM k) AS n_clinical, 2::BIGINT AS n_layers, matched_all, matched_all < 0.5 * (SELECT count(*) FROM k) AS low_overlap, CASE WHEN matched_all < 0.5 * (SELECT count(*) FROM k) THEN 'low overlap, ids like ' || odd END AS hint, matched_all >= 10 AS ok FROM m, f""")
def j7_overall(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.lit("text").alias("modality"), F.col("doc_id").cast("string").alias("sample_id"))
    ids = ids.unionByName(table(spark, sf_dir, "embeddings").select(F.lit("emb").alias("modality"), F.col("vec_id").cast("string").alias("sample_id")))
    return align.overall_preview(ids, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("sample_id")))


_SEVERITY = "CASE WHEN l_tax < 0.03 THEN 'clean' WHEN l_tax < 0.06 THEN 'mild' ELSE 'severe' END"


def _flagged(spark, sf_dir):
    severity = F.when(F.col("l_tax") < 0.03, "clean").when(F.col("l_tax") < 0.06, "mild").otherwise("severe")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), severity.alias("severity"), (F.col("l_discount") + F.col("l_tax") > 0.1).alias("flag"))


@query(f"""WITH r AS (SELECT l_returnflag AS family, {_SEVERITY} AS severity, count(*)::DOUBLE AS n, sum((l_discount + l_tax > 0.1)::INT)::DOUBLE AS k FROM lineitem GROUP BY ALL), c AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM r)
SELECT family, severity, n::BIGINT AS n, k::BIGINT AS flagged, round(p, 6) AS rate, round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM c""")
def r11_flag_rates(spark, sf_dir):
    return rounded(rows.flag_rates(_flagged(spark, sf_dir), ["family"]), "rate", "low", "high")


@query(f"""WITH r AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'null' ELSE 'predictive' END AS family, CASE l_linenumber % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'unsafe' ELSE 'standard' END AS arm, l_linenumber AS size, l_discount * 10 AS v FROM lineitem),
m AS (SELECT size, avg(v) AS v FROM r WHERE family = 'predictive' AND arm = 'standard' GROUP BY 1), w AS (SELECT count(*) AS k, sum((v < lag - 0.02)::INT)::DOUBLE AS n FROM (SELECT v, lag(v) OVER (ORDER BY size) AS lag FROM m)),
o AS (SELECT avg(v) FILTER (family = 'null') AS nul, avg(v) FILTER (arm = 'unsafe') - avg(v) FILTER (arm = 'safe') AS gap FROM r), f AS (SELECT l_returnflag AS family, avg((l_discount + l_tax > 0.1)::INT) FILTER ({_SEVERITY} = 'severe') - avg((l_discount + l_tax > 0.1)::INT) FILTER ({_SEVERITY} = 'clean') AS v FROM lineitem GROUP BY 1)
SELECT 'null mean at chance' AS "check", round(nul, 6) AS value, abs(nul - 0.5) > 0.05 AS deviates FROM o UNION ALL SELECT 'leakage gap above zero', round(gap, 6), gap <= 0 FROM o UNION ALL SELECT 'more data is not worse', coalesce(n, 0), coalesce(n, 0) > 0 FROM w WHERE k > 1 UNION ALL SELECT 'severe above clean: ' || family, round(v, 6), v <= 0 FROM f""")
def r12_expected_order(spark, sf_dir):
    n = F.col("l_linenumber")
    r = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", "null").otherwise("predictive").alias("family"), F.when(n % 3 == 0, "safe").when(n % 3 == 1, "unsafe").otherwise("standard").alias("arm"), n.alias("size"), (F.col("l_discount") * 10).alias("value")
    )
    return rounded(rows.expected_order(r, _flagged(spark, sf_dir)), "value")


@query("""WITH w AS (SELECT DISTINCT o_orderstatus AS family, o_orderkey AS u FROM orders), d AS (SELECT l_orderkey AS u, max(epoch(l_shipdate::TIMESTAMP)) AS t FROM lineitem WHERE l_quantity > 30 GROUP BY 1),
p AS (SELECT (count(*) - 1) / ((max(t) - min(t)) / 3600) AS rate, (epoch(TIMESTAMP '2030-01-01') - max(t)) / 3600 AS age FROM d), f AS (SELECT family, count(*) AS expected, count(t) AS completed, count(*) - count(t) AS outstanding FROM w LEFT JOIN d USING (u) GROUP BY 1)
SELECT family, expected, completed, outstanding, round(rate, 6) AS per_hour, round(outstanding / rate, 4) AS eta_hours, round(age, 4) AS newest_age_hours, row_number() OVER (ORDER BY outstanding DESC, family) = 1 AND outstanding > 0 AS active FROM f, p""")
def r14_progress_report(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("dataset_id"), F.col("l_shipdate").alias("finished"))
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("family"), F.col("o_orderkey").alias("dataset_id"))
    out = rows.progress_report(done, expected, F.lit("2030-01-01").cast("timestamp"))
    return out.withColumns({"per_hour": F.round("per_hour", 6), "eta_hours": F.round("eta_hours", 4), "newest_age_hours": F.round("newest_age_hours", 4)})


@query()
def u8_blocked_optimism(spark, sf_dir):
    """The fusion's score under grouped folds less that under folds which never divide a batch, from runs of both."""
    s = A.embeddings(spark, sf_dir)
    cells, samples = written(s.cells, "cells"), written(s.samples, "samples")
    standard = models.out_of_fold(cells, samples, splits.grouped(samples, 3, "y"), model="linear::FUSION")
    return rounded(whole.optimism(whole.class_scores(standard, ["model"]), models.batch_blocked(cells, samples, 3)), "standard", "blocked", "optimism_gap")
