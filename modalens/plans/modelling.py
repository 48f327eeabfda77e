"""Queries over group-level tests, in-fold preprocessing and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from modalens.operators import groups, metrics, models, splits
from modalens.plans.scores import rounded
from modalens.sources import adapters as A

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"""WITH {A.EVENTS_DAY_SQL}, n AS (SELECT group_id, count(DISTINCT sample_id) AS n FROM samples GROUP BY 1), s AS (SELECT group_id, modality, feature, count(DISTINCT sample_id) AS s FROM cells JOIN samples USING (sample_id) GROUP BY ALL)
SELECT group_id, modality, feature, round(1 - coalesce(s, 0) / n, 6) AS missing FROM n CROSS JOIN features LEFT JOIN s USING (group_id, modality, feature)""")
def g1_missing_profile(spark, sf_dir):
    s = A.events_day(spark, sf_dir)
    return rounded(groups.missing_profile(s.cells, s.samples, s.features), "missing")


@query(f"WITH {A.EMBEDDINGS_SQL} SELECT group_id, modality, feature, round(median(value), 6) AS value FROM cells JOIN samples USING (sample_id) GROUP BY ALL")
def g2_representation(spark, sf_dir):
    s = A.embeddings(spark, sf_dir)
    return rounded(groups.representation(s.cells, s.samples, "median"), "value")


_REP_SQL = f"""{A.EMBEDDINGS_SQL}, rep AS (SELECT group_id, modality, feature, avg(value) AS value FROM cells JOIN samples USING (sample_id) GROUP BY ALL),
sc AS (SELECT modality, feature, avg(value) AS c, stddev_pop(value) AS s FROM rep GROUP BY ALL), z AS (SELECT group_id, modality, feature, (value - c) / s AS value FROM rep JOIN sc USING (modality, feature) WHERE s > 0)"""


def _z(spark, sf_dir):
    s = A.embeddings(spark, sf_dir)
    return groups.standardized(groups.representation(s.cells, s.samples))


@query(f"WITH {_REP_SQL} SELECT group_id, modality, feature, round(value, 5) AS value FROM z")
def g3_standardized(spark, sf_dir):
    return _z(spark, sf_dir).select("group_id", "modality", "feature", F.round("value", 5).alias("value"))


@query(f"WITH {_REP_SQL} SELECT p.group_id AS a, q.group_id AS b, round(avg(abs(p.value - q.value)), 5) AS d FROM z p JOIN z q USING (modality, feature) WHERE p.group_id < q.group_id GROUP BY ALL")
def g4_distances(spark, sf_dir):
    return groups.distances(_z(spark, sf_dir)).withColumn("d", F.round("d", 5))


@query(f"""WITH {_REP_SQL}, g AS (SELECT group_id, group_id::INT % 5 AS t FROM (SELECT DISTINCT group_id FROM samples)),
d AS (SELECT p.group_id AS a, q.group_id AS b, avg(abs(p.value - q.value)) AS d FROM z p JOIN z q USING (modality, feature) GROUP BY ALL), f AS (SELECT d.*, (x.t <> y.t)::DOUBLE AS e FROM d JOIN g x ON x.group_id = a JOIN g y ON y.group_id = b),
c AS (SELECT d - avg(d) OVER (PARTITION BY a) - avg(d) OVER (PARTITION BY b) + avg(d) OVER () AS x, e - avg(e) OVER (PARTITION BY a) - avg(e) OVER (PARTITION BY b) + avg(e) OVER () AS y FROM f)
SELECT (SELECT count(*) FROM g) AS n, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 5) AS dcor FROM c""")
def g5_distance_correlation(spark, sf_dir):
    d = groups.distances(_z(spark, sf_dir))
    label = lambda c: F.col(c).cast("int") % 5
    e = d.select("a", "b", (label("a") != label("b")).cast("double").alias("d"))
    return groups.distance_correlation(d, e).withColumn("dcor", F.round("dcor", 5))


def _users(spark, sf_dir):
    s = A.survival(spark, sf_dir)
    return s.select(F.col("sample_id").alias("group_id"), F.when(F.col("x") > 2, "many").otherwise("few").alias("label"), "batch", "time", "event")


@query(f"""WITH {A.SURVIVAL_SQL}, u AS (SELECT CASE WHEN x > 2 THEN 'many' ELSE 'few' END AS l, batch AS b FROM surv), a AS (SELECT l, count(*) AS a FROM u GROUP BY 1), k AS (SELECT b, count(*) AS nb FROM u GROUP BY 1),
n AS (SELECT count(*)::DOUBLE AS n, least(count(DISTINCT l), count(DISTINCT b)) AS k FROM u), c AS (SELECT l, b, count(*) AS o FROM u GROUP BY ALL), x AS (SELECT sum(o * o * n / (a * nb)) - max(n) AS chi2, max(n) AS n, max(k) AS k FROM c JOIN a USING (l) JOIN k kk USING (b), n)
SELECT n::BIGINT AS n, round(chi2, 5) AS chi2, round(sqrt(chi2 / (n * (k - 1))), 5) AS cramers_v FROM x""")
def g7_class_by_batch(spark, sf_dir):
    out = groups.class_by_batch(_users(spark, sf_dir), "label", "batch", reps=199)
    return out.select("n", F.round("chi2", 5).alias("chi2"), F.round("cramers_v", 5).alias("cramers_v"))


@query()
def g7_class_by_batch_permuted(spark, sf_dir):
    out = groups.class_by_batch(_users(spark, sf_dir), "label", "batch", reps=199)
    return out.select("n", F.round("chi2", 5).alias("chi2"), F.round("cramers_v", 5).alias("cramers_v"), "p")


@query(f"""WITH {A.SURVIVAL_SQL}, t AS (SELECT time, sum(event) AS d FROM surv GROUP BY 1 HAVING sum(event) > 0),
r AS (SELECT t.time, t.d, s.batch, count(*) AS nb FROM t JOIN surv s ON s.time >= t.time GROUP BY ALL), n AS (SELECT time, sum(nb) AS n FROM r GROUP BY 1), x AS (SELECT batch, sum(nb * d / n) AS expected FROM r JOIN n USING (time) GROUP BY 1)
SELECT batch, sum(event)::BIGINT AS observed, round(coalesce(any_value(expected), 0), 5) AS expected FROM surv LEFT JOIN x USING (batch) GROUP BY 1""")
def g9_log_rank(spark, sf_dir):
    return groups.log_rank(_users(spark, sf_dir)).withColumn("expected", F.round("expected", 5))


@query()
def g11_feature_association(spark, sf_dir):
    s = A.events_day(spark, sf_dir)
    profile = groups.missing_profile(s.cells, s.samples, s.features)
    target = s.samples.groupBy("group_id").agg(F.avg("y").alias("rate"))
    return groups.feature_association(profile, target, "rate", reps=99)


def _folds(s):
    return s.samples.select("sample_id", F.expr("int(bigint(sample_id) div 7 % 5)").alias("outer_fold"))


_FOLDS_SQL = f"""{A.EMBEDDINGS_SQL}, f AS (SELECT sample_id, (sample_id::BIGINT // 7 % 5)::INT AS own FROM samples), k AS (SELECT DISTINCT own AS outer_fold FROM f),
tr AS (SELECT k.outer_fold, c.*, y FROM cells c JOIN f USING (sample_id) JOIN samples USING (sample_id), k WHERE own <> k.outer_fold)"""


@query(f"WITH {_FOLDS_SQL} SELECT outer_fold, modality, feature, round(median(value), 6) AS median FROM tr GROUP BY ALL")
def m1_fold_medians(spark, sf_dir):
    s = A.embeddings(spark, sf_dir)
    return rounded(models.fold_medians(s.cells, _folds(s)), "median")


@query(f"""WITH {_FOLDS_SQL}, m AS (SELECT outer_fold, modality, feature, avg(value) AS mu, stddev_pop(value) AS sd FROM tr GROUP BY ALL)
SELECT m.outer_fold, count(*) AS n, round(sum(abs((value - mu) / sd)), 3) AS total FROM cells JOIN f USING (sample_id) JOIN m USING (modality, feature) GROUP BY 1""")
def m5_masked_standardized(spark, sf_dir):
    s = A.embeddings(spark, sf_dir)
    z = models.masked_standardized(s.cells, _folds(s))
    return z.groupBy("outer_fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("z")), 3).alias("total"))


@query(f"""WITH {_FOLDS_SQL}, c AS (SELECT outer_fold, modality, feature, y, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS w FROM tr GROUP BY ALL),
g AS (SELECT outer_fold, modality, feature, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mu, sum(w) AS w FROM c GROUP BY ALL),
s AS (SELECT g.outer_fold, g.modality, g.feature, (sum(c.n * (c.m - mu) ** 2) / (any_value(k) - 1)) / (any_value(g.w) / (any_value(g.n) - any_value(k))) AS f FROM g JOIN c USING (outer_fold, modality, feature) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY outer_fold ORDER BY f DESC, modality, feature) AS place FROM s) SELECT outer_fold, modality, feature, round(f, 4) AS f, place FROM r WHERE place <= 10""")
def m4_selected(spark, sf_dir):
    s = A.embeddings(spark, sf_dir)
    return models.selected(s.cells, s.samples, _folds(s), top=10).withColumn("f", F.round("f", 4)).withColumn("place", F.col("place").cast("long"))


_DAY_FOLDS_SQL = f"""{A.EVENTS_DAY_SQL}, f AS (SELECT sample_id, y, (group_id::BIGINT % 5)::INT AS own FROM samples), k AS (SELECT DISTINCT own AS outer_fold FROM f),
tr AS (SELECT k.outer_fold, f.sample_id, f.y, modality, feature, c.value FROM f CROSS JOIN features JOIN k ON own <> outer_fold LEFT JOIN cells c USING (sample_id, modality, feature)),
im AS (SELECT *, coalesce(value, median(value) OVER (PARTITION BY outer_fold, modality, feature)) AS v FROM tr)"""


def _day(spark, sf_dir):
    s = A.events_day(spark, sf_dir)
    return s, s.samples.select("sample_id", (F.col("group_id").cast("long") % 5).cast("int").alias("outer_fold"))


@query(f"WITH {_DAY_FOLDS_SQL} SELECT outer_fold, modality, feature, count(value) AS n, round(any_value(v) FILTER (value IS NULL), 6) AS median, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM im GROUP BY ALL HAVING stddev_pop(v) > 0")
def m3_imputed_moments(spark, sf_dir):
    s, folds = _day(spark, sf_dir)
    return rounded(models.imputed_moments(s.cells, s.samples, folds), "median", "mean", "sd")


@query(f"""WITH {_DAY_FOLDS_SQL}, x AS (SELECT 'given' AS modality, feature, sample_id, value FROM cells UNION ALL SELECT 'given', 'flat', sample_id, 3 FROM samples)
SELECT outer_fold, modality, feature FROM (SELECT k.outer_fold, x.modality, x.feature, min(value) AS lo, max(value) AS hi FROM x JOIN f USING (sample_id) JOIN k ON own <> outer_fold GROUP BY ALL) WHERE lo < hi""")
def m2_varying_features(spark, sf_dir):
    s, folds = _day(spark, sf_dir)
    flat = s.samples.select("sample_id", F.lit("given").alias("modality"), F.lit("flat").alias("feature"), F.lit(3.0).alias("value"))
    cells = s.cells.withColumn("modality", F.lit("given")).unionByName(flat)
    return models.imputed_moments(cells, s.samples, folds).select("outer_fold", "modality", "feature")


@query(f"""WITH {_DAY_FOLDS_SQL}, c AS (SELECT outer_fold, modality, feature, y, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w FROM im GROUP BY ALL), g AS (SELECT outer_fold, modality, feature, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mu, sum(w) AS w FROM c GROUP BY ALL),
s AS (SELECT g.outer_fold, g.modality, g.feature, (sum(c.n * (c.m - mu) ** 2) / (any_value(k) - 1)) / (any_value(g.w) / (any_value(g.n) - any_value(k))) AS f FROM g JOIN c USING (outer_fold, modality, feature) GROUP BY ALL)
SELECT outer_fold, modality, feature, round(f, 4) AS f, row_number() OVER (PARTITION BY outer_fold ORDER BY f DESC, modality, feature) AS place FROM s""")
def m4_selected_imputed(spark, sf_dir):
    s, folds = _day(spark, sf_dir)
    return models.selected(s.cells, s.samples, folds).withColumn("f", F.round("f", 4)).withColumn("place", F.col("place").cast("long"))


def _vectors(spark, sf_dir, classes: int = 10):
    s = A.embeddings(spark, sf_dir)
    samples = s.samples.withColumn("y", F.col("y") % classes)
    return s, samples, splits.grouped(samples, 3, "y")


@query()
def m13_out_of_fold(spark, sf_dir):
    s, samples, folds = _vectors(spark, sf_dir)
    return metrics.confusion_scores(models.out_of_fold(s.cells, samples, folds, top=40), ["model"])


@query()
def m8_ridge(spark, sf_dir):
    s = A.orders(spark, sf_dir)
    samples = s.samples.withColumnRenamed("target", "y")
    return metrics.regression_scores(models.out_of_fold_regression(s.cells, samples, splits.grouped(samples, 3)), ["model"])


@query()
def m9_elastic_net(spark, sf_dir):
    s, samples, folds = _vectors(spark, sf_dir, 2)
    return metrics.confusion_scores(models.out_of_fold(s.cells, samples, folds, models.elastic, "elastic"), ["model"])


@query()
def m10_random_forest(spark, sf_dir):
    s, samples, folds = _vectors(spark, sf_dir)
    return metrics.confusion_scores(models.out_of_fold(s.cells, samples, folds, models.forest, "forest"), ["model"])


@query()
def m11_boosting(spark, sf_dir):
    s, samples, folds = _vectors(spark, sf_dir, 2)
    return metrics.confusion_scores(models.out_of_fold(s.cells, samples, folds, models.boosting, "boosting"), ["model"])


@query()
def m14_model_grid(spark, sf_dir):
    s, samples, folds = _vectors(spark, sf_dir, 2)
    return metrics.confusion_scores(models.model_grid(s.cells, samples, folds, {"linear": models.logistic}), ["model"])


@query()
def m15_late_fusion(spark, sf_dir):
    s, samples, folds = _vectors(spark, sf_dir, 2)
    alone = [models.out_of_fold(s.cells.filter(F.col("modality") == m), samples, folds, model=f"linear::{m}") for m in ("emb_lo", "emb_hi")]
    return metrics.confusion_scores(models.stacked(alone[0].unionByName(alone[1]), samples, folds), ["model"])


@query()
def m20_shuffled_target_control(spark, sf_dir):
    s, samples, folds = _vectors(spark, sf_dir)
    pred = models.out_of_fold(s.cells, models.shuffled_target(samples), folds, model="control::shuffled-target")
    return metrics.confusion_scores(pred, ["model"])


@query(f"""WITH {A.EVENTS_DAY_SQL} SELECT modality, feature, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS least, round(max(value), 6) AS most FROM cells GROUP BY ALL""")
def m21_shuffled_features(spark, sf_dir):
    """A permutation keeps each column's values; what moves is held by a test."""
    s = A.events_day(spark, sf_dir)
    out = models.shuffled_features(s.cells, s.samples).groupBy("modality", "feature")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


@query(f"WITH {A.EVENTS_DAY_SQL} SELECT modality, feature, (SELECT count(*) FROM samples) AS n, true AS standard FROM features")
def m22_noise_control(spark, sf_dir):
    """Cells of a standard normal in the study's full shape; `standard`: mean and spread within five standard errors."""
    s = A.events_day(spark, sf_dir)
    out = models.noise(s.samples, s.features).groupBy("modality", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))
    near = (F.abs("m") < 5 / F.sqrt("n")) & (F.abs(F.col("d") - 1) < 5 / F.sqrt(2 * F.col("n")))
    return out.select("modality", "feature", "n", near.alias("standard"))


@query(f"""WITH {A.ORDERS_SQL}, x AS (SELECT sample_id, 'given' AS modality, unnest(['same', 'line', 'other']) AS feature, unnest([target, target * 2 + 1, length(label)::DOUBLE]) AS value FROM samples),
p AS (SELECT x.*, target AS y FROM x JOIN samples USING (sample_id)) SELECT modality, feature, bool_and(value = y) AS equal, count(DISTINCT (value, y)) = count(DISTINCT value) AND count(DISTINCT (value, y)) = count(DISTINCT y) AS bijection, feature <> 'other' AS affine FROM p GROUP BY ALL""")
def m25_target_copies(spark, sf_dir):
    s = A.orders(spark, sf_dir).samples
    x = s.select("sample_id", F.lit("given").alias("modality"), F.explode(F.map_from_arrays(F.array(F.lit("same"), F.lit("line"), F.lit("other")), F.array("target", F.col("target") * 2 + 1, F.length("label").cast("double")))).alias("feature", "value"))
    return models.target_copies(x, s, "target")


@query()
def m28_masked(spark, sf_dir):
    s = A.embeddings(spark, sf_dir)
    parts = [models.masked(s.cells, 0.2, mechanism=m, samples=s.samples).withColumn("mechanism", F.lit(m)) for m in ("mcar", "mar", "mnar", "batch", "sample")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("mechanism", "modality").agg(F.count(F.lit(1)).alias("n"))
