"""Queries over missingness and batch diagnostics, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from modalens.operators import batch, missingness, projection
from modalens.sources import adapters as A
from modalens.storage import written

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


MISSING_SQL = """
width AS (SELECT modality, count(DISTINCT feature) AS n_features FROM features GROUP BY 1),
seen AS (SELECT sample_id, modality, count(DISTINCT feature) AS n_seen FROM cells WHERE value IS NOT NULL GROUP BY ALL),
missing AS (SELECT s.sample_id, w.modality, w.n_features, w.n_features - coalesce(n_seen, 0) AS n_missing,
                   (w.n_features - coalesce(n_seen, 0)) / w.n_features AS missing_fraction
            FROM (SELECT DISTINCT sample_id FROM samples) s CROSS JOIN width w LEFT JOIN seen USING (sample_id, modality))
"""


def _day_missing(spark, sf_dir):
    s = A.events_day(spark, sf_dir)
    return s, missingness.sample_missing(s.cells, s.samples, s.features)


@query(f"WITH {A.EVENTS_DAY_SQL}, {MISSING_SQL} SELECT sample_id, modality, n_features, n_missing, round(missing_fraction, 6) AS missing_fraction FROM missing")
def d1_sample_missing(spark, sf_dir):
    return rounded(_day_missing(spark, sf_dir)[1], "missing_fraction")


@query(f"""WITH {A.EVENTS_DAY_SQL},
f AS (SELECT modality, feature, 1 - count(DISTINCT sample_id) / (SELECT count(DISTINCT sample_id) FROM samples) AS mf FROM cells GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY mf DESC, feature) AS place FROM f)
SELECT modality, feature, round(mf, 6) AS missing_fraction, place FROM r WHERE place <= 25""")
def d2_feature_missing(spark, sf_dir):
    s = A.events_day(spark, sf_dir)
    return rounded(missingness.feature_missing(s.cells, s.samples), "missing_fraction").withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {A.EVENTS_DAY_SQL}, {MISSING_SQL}
SELECT modality, sum(n_features)::BIGINT AS n_cells, sum(n_missing)::BIGINT AS n_missing, count(*) FILTER (n_missing > 0) AS samples_with_missing,
       round(max(missing_fraction), 6) AS max_fraction, round(avg(missing_fraction), 6) AS mean_fraction FROM missing GROUP BY 1""")
def d3_missing_totals(spark, sf_dir):
    return rounded(missingness.totals(_day_missing(spark, sf_dir)[1]), "max_fraction", "mean_fraction")


def chi2_tail_sql(x: str, df: str) -> str:
    """The upper tail of chi-square: a finite sum for even degrees of freedom, for one degree the normal tail by Simpson's rule."""
    even = f"exp(-({x}) / 2) * list_sum([(({x}) / 2) ** i / gamma(i + 1) FOR i IN range(0, (({df}) // 2)::BIGINT)])"
    step = f"(sqrt(least({x}, 200)) / 2000)"
    one = f"1 - sqrt(2 / pi()) * {step} / 3 * list_sum([exp(-0.5 * ((i * {step}) ** 2)) * CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END FOR i IN range(0, 2001)])"
    return f"CASE WHEN ({df}) = 1 THEN {one} WHEN ({df}) % 2 = 0 THEN {even} END"


def kruskal_sql(source: str, value: str, group: str) -> str:
    """Tie-corrected H over a relation, as SQL that ends in (n, k, h)."""
    return f"""kr AS (SELECT {value} AS v, {group} AS g, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2 AS r FROM {source}),
kp AS (SELECT g, sum(r) AS s, count(*) AS m FROM kr GROUP BY g),
kt AS (SELECT sum(t::DOUBLE * t * t - t) AS ties FROM (SELECT count(*) AS t FROM kr GROUP BY v)),
kh AS (SELECT sum(m)::BIGINT AS n, count(*) AS k, sum(s * s / m) AS q FROM kp)
, kk AS (SELECT n, k, (12 / (n::DOUBLE * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n::DOUBLE * n * n - n)) AS h FROM kh, kt) SELECT n, k, round(h, 5) AS h, round({chi2_tail_sql('h', 'k - 1')}, 6) AS p FROM kk"""


def _kruskal(spark, sf_dir, group):
    s, missing = _day_missing(spark, sf_dir)
    rows = missing.join(s.samples, "sample_id").withColumn("all", F.lit(0))
    return missingness.kruskal(rows, ["all"], "missing_fraction", group).select("n", "k", F.round("h", 5).alias("h"), F.round("p", 6).alias("p"))


@query(f"WITH {A.EVENTS_DAY_SQL}, {MISSING_SQL}, ms AS (SELECT * FROM missing JOIN samples USING (sample_id)), {kruskal_sql('ms', 'missing_fraction', 'y')}")
def d4_missing_by_class(spark, sf_dir):
    return _kruskal(spark, sf_dir, "y")


@query(f"WITH {A.EVENTS_DAY_SQL}, {MISSING_SQL}, ms AS (SELECT * FROM missing JOIN samples USING (sample_id)), {kruskal_sql('ms', 'missing_fraction', 'batch')}")
def d4_missing_by_batch(spark, sf_dir):
    return _kruskal(spark, sf_dir, "batch")


def chi2_sql(source: str, a: str, b: str) -> str:
    return f"""o AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {source} GROUP BY ALL),
ra AS (SELECT a, sum(o) AS na FROM o GROUP BY 1), rb AS (SELECT b, sum(o) AS nb FROM o GROUP BY 1),
meta AS (SELECT (SELECT sum(o) FROM o)::DOUBLE AS n, (SELECT count(*) FROM ra) AS ka, (SELECT count(*) FROM rb) AS kb),
grid AS (SELECT coalesce(o.o, 0) AS o, na * nb / n AS e, n, ka, kb FROM ra CROSS JOIN rb CROSS JOIN meta LEFT JOIN o ON o.a = ra.a AND o.b = rb.b),
gap AS (SELECT e, n, ka, kb, abs(o - e) - CASE WHEN ka = 2 AND kb = 2 THEN least(0.5, abs(o - e)) ELSE 0 END AS g FROM grid),
chi AS (SELECT n, ka, kb, sum(g * g / e) AS chi2 FROM gap GROUP BY ALL)
SELECT n::BIGINT AS n, round(chi2, 5) AS chi2, ((ka - 1) * (kb - 1))::DOUBLE AS df, round(sqrt(chi2 / (n * (least(ka, kb) - 1))), 6) AS cramers_v, round({chi2_tail_sql("chi2", "(ka - 1) * (kb - 1)")}, 6) AS p FROM chi"""


def _chi2(rows, a, b):
    return missingness.contingency_chi2(rows, [], a, b).select("n", F.round("chi2", 5).alias("chi2"), "df", F.round("cramers_v", 6).alias("cramers_v"), F.round("p", 6).alias("p"))


@query(f"WITH {A.EVENTS_DAY_SQL}, {MISSING_SQL}, ms AS (SELECT (n_missing > 0)::INT AS any_missing, y FROM missing JOIN samples USING (sample_id)), {chi2_sql('ms', 'any_missing', 'y')}")
def d5_any_missing_by_class(spark, sf_dir):
    s, missing = _day_missing(spark, sf_dir)
    return _chi2(missing.join(s.samples, "sample_id").withColumn("any_missing", (F.col("n_missing") > 0).cast("int")), "any_missing", "y")


@query(f"""WITH {A.EVENTS_DAY_SQL}, {MISSING_SQL}, t AS (SELECT sample_id, count(*) AS target FROM e GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY missing_fraction) + (count(*) OVER (PARTITION BY missing_fraction) - 1) / 2 AS ra,
             rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2 AS rb FROM missing JOIN t USING (sample_id))
SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r""")
def d6_missing_spearman(spark, sf_dir):
    _, missing = _day_missing(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = e.groupBy(F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("sample_id")).agg(F.count(F.lit(1)).alias("target"))
    rows = missing.join(t, "sample_id").withColumn("target", F.col("target").cast("double")).withColumn("all", F.lit(0))
    return missingness.spearman(rows, ["all"], "missing_fraction", "target").select("n", F.round("rho", 6).alias("rho"))


@query(f"""WITH {A.EVENTS_DAY_SQL}, {MISSING_SQL}
SELECT modality, CASE WHEN p <= 0 THEN 0 WHEN p <= 1 THEN 1 WHEN p <= 5 THEN 5 WHEN p <= 10 THEN 10 WHEN p <= 25 THEN 25 WHEN p <= 50 THEN 50 ELSE 100 END AS bin,
       count(*) AS n_samples FROM (SELECT modality, missing_fraction * 100 AS p FROM missing) GROUP BY ALL""")
def d7_missing_histogram(spark, sf_dir):
    return missingness.histogram(_day_missing(spark, sf_dir)[1])


@query("""WITH t AS (SELECT p_brand AS family, p_partkey::VARCHAR AS test, (p_partkey * 7919 % 1009 + 1) / 1010 AS p FROM part),
r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, test) AS i FROM t),
s AS (SELECT *, list_sum([1 / j FOR j IN range(1, m + 1)]) AS c FROM r)
SELECT family, test, round(p, 6) AS p,
 round(least(1, min(p * m / i) OVER (PARTITION BY family ORDER BY i DESC)), 6) AS p_bh,
 round(least(1, min(p * m / i * c) OVER (PARTITION BY family ORDER BY i DESC)), 6) AS p_by,
 round(least(1, max(p * (m - i + 1)) OVER (PARTITION BY family ORDER BY i)), 6) AS p_holm FROM s""")
def d8_adjusted(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tests = part.select(F.col("p_brand").alias("family"), F.col("p_partkey").cast("string").alias("test"), ((F.col("p_partkey") * 7919 % 1009 + 1) / 1010).alias("p"))
    return rounded(missingness.adjusted(tests, ["family"]), "p", "p_bh", "p_by", "p_holm")


ANOVA_SQL = """am AS (SELECT avg(v) AS mu FROM av), ap AS (SELECT g, count(*) AS m, sum(v - mu) AS s, sum((v - mu) * (v - mu)) AS q FROM av, am GROUP BY g),
aa AS (SELECT sum(m)::BIGINT AS n, count(*) AS k, sum(s * s / m) AS b, sum(s) AS s, sum(q) AS q FROM ap)
SELECT n, k, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 4) AS f, round((b - s * s / n) / (q - s * s / n), 6) AS eta2 FROM aa"""


@query(f"""WITH {A.EVENTS_DAY_SQL}, av AS (SELECT modality, feature, value AS v, batch AS g FROM cells JOIN samples USING (sample_id)), am AS (SELECT modality, feature, avg(v) AS mu FROM av GROUP BY ALL),
ap AS (SELECT modality, feature, g, count(*) AS m, sum(v - mu) AS s, sum((v - mu) * (v - mu)) AS q FROM av JOIN am USING (modality, feature) GROUP BY ALL),
aa AS (SELECT modality, feature, sum(m)::BIGINT AS n, count(*) AS k, sum(s * s / m) AS b, sum(s) AS s, sum(q) AS q FROM ap GROUP BY ALL)
SELECT modality, feature, n, k, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 4) AS f, round((b - s * s / n) / (q - s * s / n), 6) AS eta2 FROM aa""")
def b4_batch_anova(spark, sf_dir):
    s = A.events_day(spark, sf_dir)
    out = batch.anova(s.cells.join(s.samples, "sample_id"), ["modality", "feature"], "value", "batch")
    return out.select("modality", "feature", "n", "k", F.round("f", 4).alias("f"), F.round("eta2", 6).alias("eta2"))


@query(f"""WITH {A.EVENTS_DAY_SQL}, kr AS (SELECT modality, feature, value AS v, batch AS g, rank() OVER (PARTITION BY modality, feature ORDER BY value) + (count(*) OVER (PARTITION BY modality, feature, value) - 1) / 2 AS r FROM cells JOIN samples USING (sample_id)),
kp AS (SELECT modality, feature, g, sum(r) AS s, count(*) AS m FROM kr GROUP BY ALL), kt AS (SELECT modality, feature, sum(t::DOUBLE * t * t - t) AS ties FROM (SELECT modality, feature, v, count(*) AS t FROM kr GROUP BY ALL) GROUP BY ALL),
kh AS (SELECT modality, feature, sum(m)::BIGINT AS n, count(*) AS k, sum(s * s / m) AS q FROM kp GROUP BY ALL), kk AS (SELECT kh.*, (12 / (n::DOUBLE * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n::DOUBLE * n * n - n)) AS h FROM kh JOIN kt USING (modality, feature))
SELECT modality, feature, n, k, round(h, 5) AS h, round({chi2_tail_sql('h', 'k - 1')}, 6) AS p FROM kk""")
def b5_batch_kruskal(spark, sf_dir):
    s = A.events_day(spark, sf_dir)
    out = missingness.kruskal(s.cells.join(s.samples, "sample_id"), ["modality", "feature"], "value", "batch", drop_single=False)
    return out.select("modality", "feature", "n", "k", F.round("h", 5).alias("h"), F.round("p", 6).alias("p"))


@query(f"WITH {A.EVENTS_DAY_SQL}, {chi2_sql('samples', 'batch', 'y')}")
def b7_batch_confounding(spark, sf_dir):
    return _chi2(A.events_day(spark, sf_dir).samples, "batch", "y")


@query(f"WITH {A.ORDERS_SQL}, av AS (SELECT target AS v, batch AS g FROM samples), {ANOVA_SQL}")
def b8_batch_target_anova(spark, sf_dir):
    out = batch.anova(A.orders(spark, sf_dir).samples, [], "target", "batch")
    return out.select("n", "k", F.round("f", 4).alias("f"), F.round("eta2", 6).alias("eta2"))




@query(f"""WITH {A.EMBEDDINGS_SQL}, f AS (SELECT sample_id, (sample_id::BIGINT // 7 % 5)::INT AS outer_fold FROM samples),
x AS (SELECT c.*, outer_fold, batch FROM cells c JOIN f USING (sample_id) JOIN samples USING (sample_id)),
k AS (SELECT DISTINCT outer_fold FROM f),
am AS (SELECT k.outer_fold, modality, feature, avg(value) AS am FROM x, k WHERE x.outer_fold <> k.outer_fold GROUP BY ALL),
bm AS (SELECT k.outer_fold, modality, feature, batch, avg(value) AS bm FROM x, k WHERE x.outer_fold <> k.outer_fold GROUP BY ALL)
SELECT am.outer_fold, x.sample_id, modality, feature, round(x.value - coalesce(bm - am, 0), 6) AS value
FROM x JOIN am USING (modality, feature) LEFT JOIN bm USING (modality, feature, batch) WHERE bm.outer_fold = am.outer_fold""")
def b9_batch_centring(spark, sf_dir):
    s = A.embeddings(spark, sf_dir)
    folds = s.samples.select("sample_id", F.expr("int(bigint(sample_id) div 7 % 5)").alias("outer_fold"))
    return rounded(batch.centred(s.cells, s.samples, folds), "value")


@query(f"""WITH {A.EVENTS_DAY_SQL}, f AS (SELECT batch, group_id::BIGINT % 5 AS outer_fold FROM samples),
v AS (SELECT batch, outer_fold, count(*) AS n_val FROM f GROUP BY ALL), t AS (SELECT batch, sum(n_val) AS n FROM v GROUP BY 1)
SELECT outer_fold::INT AS outer_fold, batch, (n - n_val)::BIGINT AS n_train FROM v JOIN t USING (batch) WHERE n - n_val < 500""")
def b10_centring_guard(spark, sf_dir):
    s = A.events_day(spark, sf_dir)
    folds = s.samples.select("sample_id", (F.col("group_id").cast("long") % 5).cast("int").alias("outer_fold"))
    return batch.centring_guard(s.samples, folds, least=500)


@query(f"""WITH {A.EMBEDDINGS_SQL}, p AS (SELECT vec_id, embedding::DOUBLE[64] AS c, label FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE array_distance(a.c, b.c) END) AS d FROM p a, p b GROUP BY ALL),
n AS (SELECT label AS other, count(*) AS n FROM p GROUP BY 1),
s AS (SELECT vec_id, max(CASE WHEN label = other AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN label <> other THEN d / n END) AS b,
             max(CASE WHEN label = other THEN n END) AS m FROM d JOIN n USING (other) GROUP BY vec_id)
SELECT count(*) AS n, round(avg(CASE WHEN m = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM s""")
def b3_silhouette(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    points = e.select(F.col("vec_id").cast("string").alias("sample_id"), F.col("embedding").cast("array<double>").alias("coordinates"), "label").withColumn("all", F.lit(0))
    return batch.silhouette(points, "label", ["all"]).select("n", F.round("silhouette", 5).alias("silhouette"))


def _projected(spark, sf_dir):
    """Coordinates of each modality's samples on ten components."""
    s = A.embeddings(spark, sf_dir)
    parts = [projection.components(s.cells.filter(F.col("modality") == m))[0].withColumn("modality", F.lit(m)) for m in ("emb_hi", "emb_lo")]
    return s, parts[0].unionByName(parts[1]).join(s.samples.select("sample_id", "y", "batch"), "sample_id")


@query()
def b2_explained(spark, sf_dir):
    cells = A.embeddings(spark, sf_dir).cells
    parts = [projection.components(cells.filter(F.col("modality") == m))[1].withColumn("modality", F.lit(m)) for m in ("emb_hi", "emb_lo")]
    return rounded(parts[0].unionByName(parts[1]), "explained")


@query()
def b6_structured(spark, sf_dir):
    """Each modality's batch structure on its components: silhouette, F and H of the first one, and the flag of both."""
    _, p = _projected(spark, sf_dir)
    first = p.withColumn("pc1", F.col("coordinates")[0])
    s = batch.silhouette(p, "batch", ["modality"]).select("modality", "silhouette")
    h = missingness.kruskal(first, ["modality"], "pc1", "batch", drop_single=False).select("modality", "h", F.col("p").alias("p_kruskal"))
    a = batch.anova(first, ["modality"], "pc1", "batch").select("modality", "f", "eta2", "p")
    return rounded(batch.structured(s, a, ["modality"]).join(h, "modality"), "silhouette", "f", "eta2", "p", "h", "p_kruskal")


@query(f"WITH {A.EVENTS_DAY_SQL}, {chi2_sql('samples', 'batch', 'y')}".replace("AS p FROM chi", "AS p, false AS confounded FROM chi"))
def b7_confounded_flag(spark, sf_dir):
    test = missingness.contingency_chi2(A.events_day(spark, sf_dir).samples, [], "batch", "y")
    return batch.confounded(test).select("n", F.round("chi2", 5).alias("chi2"), "df", F.round("cramers_v", 6).alias("cramers_v"), F.round("p", 6).alias("p"), "confounded")


#: Other names of the same queries.
QUERIES |= {"b3_silhouette_dimensions": QUERIES["b3_silhouette"], "b4_batch_anova_features": QUERIES["b4_batch_anova"], "b5_batch_kruskal_features": QUERIES["b5_batch_kruskal"], "b9_batch_centring_features": QUERIES["b9_batch_centring"]}


def flagship(spark, sf_dir):
    """Does missingness track the outcome or the batch? Statistic, p and adjusted p of each test."""
    s, missing = _day_missing(spark, sf_dir)
    rows = written(missing.join(s.samples, "sample_id").select("modality", "missing_fraction", "y", "batch"), "missing")  # read by every test, in files of AQE's size
    tests = None
    for name in ("y", "batch"):
        t = missingness.kruskal(rows, ["modality"], "missing_fraction", name).withColumn("test", F.concat_ws(":", "modality", F.lit(name)))
        tests = t if tests is None else tests.unionByName(t)
    return missingness.adjusted(tests.withColumn("family", F.lit("missingness")), ["family"]).select("test", "n", "k", "h", "p", "p_bh", "p_by", "p_holm")


@query()
def missingness_audit(spark, sf_dir):
    return flagship(spark, sf_dir)
