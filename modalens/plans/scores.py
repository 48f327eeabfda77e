"""Queries over metrics, uncertainty, splits and result rows, each with its DuckDB twin."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalens.operators import bootstrap, ledger, metrics, provenance, rows, splits
from modalens.session import table
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


#: Stored predictions: line items, with price as the score of a large quantity.
PRED_SQL = """pred AS (SELECT l_linestatus AS model, l_orderkey::VARCHAR || '-' || l_linenumber AS sample_id, (l_orderkey % 5)::INT AS outer_fold, (l_quantity > 25)::INT AS y,
 least(l_extendedprice / 100000, 1.0) AS score, (l_extendedprice > 50000)::INT AS pred, l_suppkey::VARCHAR AS group_id, l_returnflag AS stratum FROM lineitem)"""


def predictions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_linestatus").alias("model"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("sample_id"),
        (F.col("l_orderkey") % 5).cast("int").alias("outer_fold"), (F.col("l_quantity") > 25).cast("int").alias("y"), F.least(F.col("l_extendedprice") / 100000, F.lit(1.0)).alias("score"),
        (F.col("l_extendedprice") > 50000).cast("int").alias("pred"), F.col("l_suppkey").cast("string").alias("group_id"), F.col("l_returnflag").alias("stratum"),
    )


def auroc_sql(keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, sum(y)::BIGINT AS n_pos, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auroc
FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2 AS r FROM pred) GROUP BY {keys}"""


@query(f"WITH {PRED_SQL} {auroc_sql('model')}")
def e1_auroc(spark, sf_dir):
    return rounded(metrics.auroc(predictions(spark, sf_dir), ["model"]), "auroc")


@query(f"""WITH p AS (SELECT 'all' AS model, l_returnflag AS y0, c.cls, CASE c.cls WHEN 'A' THEN l_discount WHEN 'N' THEN l_tax ELSE l_quantity / 100 END AS score FROM lineitem, (VALUES ('A'), ('N'), ('R')) c(cls)),
pred AS (SELECT model, cls, (y0 = cls)::INT AS y, score FROM p), a AS ({auroc_sql('model, cls')}) SELECT model, round(avg(auroc), 5) AS macro_auroc FROM a GROUP BY model""")
def e1_macro_auroc(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.lit("all").alias("model"), F.col("l_returnflag").alias("y"), F.explode(F.array(
        F.struct(F.lit("A").alias("cls"), F.col("l_discount").alias("score")), F.struct(F.lit("N").alias("cls"), F.col("l_tax").alias("score")),
        F.struct(F.lit("R").alias("cls"), (F.col("l_quantity") / 100).alias("score")),
    )).alias("x")).select("model", "y", "x.*")
    return metrics.macro_auroc(li, ["model"]).withColumn("macro_auroc", F.round("macro_auroc", 5))


@query(f"""WITH {PRED_SQL}, s AS (SELECT model, score, sum(y) AS p, count(*) AS m FROM pred GROUP BY ALL),
r AS (SELECT model, p, sum(p) OVER w AS tp, sum(m) OVER w AS k FROM s WINDOW w AS (PARTITION BY model ORDER BY score DESC)) SELECT model, round(sum(p * tp / k) / sum(p), 6) AS average_precision FROM r GROUP BY 1""")
def e2_average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(predictions(spark, sf_dir), ["model"]), "average_precision")


@query(f"""WITH {PRED_SQL}, c AS (SELECT model, sum((y = 1 AND pred = 1)::INT)::DOUBLE AS tp, sum((y = 0 AND pred = 0)::INT)::DOUBLE AS tn, sum((y = 0 AND pred = 1)::INT)::DOUBLE AS fp, sum((y = 1 AND pred = 0)::INT)::DOUBLE AS fn FROM pred GROUP BY 1)
SELECT model, (tp + tn + fp + fn)::BIGINT AS n, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
 round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""")
def e3_confusion_scores(spark, sf_dir):
    return rounded(metrics.confusion_scores(predictions(spark, sf_dir), ["model"]), "accuracy", "balanced_accuracy", "f1", "macro_f1", "mcc")


@query("""SELECT l_returnflag AS model, count(*) AS n, round(1 - sum((y - s) ** 2) / (var_pop(y) * count(*)), 5) AS r2, round(sqrt(avg((y - s) ** 2)), 4) AS rmse, round(avg(abs(y - s)), 4) AS mae, round(corr(y, s), 6) AS pearson, round(corr(ry, rs), 6) AS spearman
FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY l_returnflag ORDER BY s) + (count(*) OVER (PARTITION BY l_returnflag, s) - 1) / 2 AS rs
 FROM (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500 AS s FROM lineitem)) GROUP BY 1""")
def e4_regression_scores(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("score"))
    out = metrics.regression_scores(p, ["model"])
    return out.withColumns({"r2": F.round("r2", 5), "rmse": F.round("rmse", 4), "mae": F.round("mae", 4), "pearson": F.round("pearson", 6), "spearman": F.round("spearman", 6)})


@query(f"""WITH {A.SURVIVAL_SQL}, p AS (SELECT i.x AS ri, j.x AS rj FROM surv i JOIN surv j ON j.time > i.time WHERE i.event = 1)
SELECT count(*) AS pairs, round(avg(CASE WHEN ri > rj THEN 1 WHEN ri = rj THEN 0.5 ELSE 0 END), 6) AS c_index FROM p""")
def e5_concordance(spark, sf_dir):
    return rounded(metrics.concordance(A.survival(spark, sf_dir).withColumnRenamed("x", "risk")), "c_index")


@query(f"""WITH {PRED_SQL}, pq AS (FROM pred UNION ALL BY NAME SELECT * REPLACE ('flat' AS model, 0.5 AS score) FROM pred WHERE model = 'F'), b AS (SELECT model, least(floor(score * 10), 9)::INT AS bin, count(*) AS m, avg(score) AS ms, avg(y) AS my FROM pq GROUP BY ALL),
g AS (SELECT model, sum(m * abs(my - ms)) AS g FROM b GROUP BY 1) SELECT model, count(*) AS n, CASE WHEN model <> 'flat' THEN round(avg((score - y) ** 2), 6) END AS brier, CASE WHEN model <> 'flat' THEN round(any_value(g) / count(*), 6) END AS ece FROM pq JOIN g USING (model) GROUP BY 1""")
def e6_calibration(spark, sf_dir):
    p = predictions(spark, sf_dir)
    flat = p.filter("model = 'F'").withColumn("model", F.lit("flat")).withColumn("score", F.lit(0.5))  # a constant score has none
    return rounded(metrics.calibration(p.unionByName(flat), ["model"]), "brier", "ece")


@query(f"WITH {PRED_SQL} SELECT model, least(floor(score * 10), 9)::INT AS bin, count(*) AS m, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS mean_y FROM pred GROUP BY ALL")
def e6_reliability(spark, sf_dir):
    return rounded(metrics.reliability(predictions(spark, sf_dir), ["model"]), "mean_score", "mean_y")


@query()
def e7_auroc_interval(spark, sf_dir):
    return bootstrap.auroc_interval(predictions(spark, sf_dir), ["model"], reps=1000)


@query()
def e8_paired_gain(spark, sf_dir):
    p = predictions(spark, sf_dir)
    two = p.withColumn("model", F.lit("coarse")).withColumn("score", F.floor(F.col("score") * 10) / 10)
    return bootstrap.paired_gain(p.withColumn("model", F.lit("fine")).unionByName(two), "fine", "coarse", reps=1000)


def _fold_scores(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return metrics.auroc(p.filter("model = 'F'"), ["outer_fold"]).select("outer_fold", F.col("auroc").alias("one")).join(
        metrics.auroc(p.filter("model = 'O'"), ["outer_fold"]).select("outer_fold", F.col("auroc").alias("two")), "outer_fold"
    )


@query(f"""WITH {PRED_SQL}, a AS ({auroc_sql('model, outer_fold').replace('round(', '(').replace(', 6)', ')')}),
g AS (SELECT max(auroc) FILTER (model = 'F') - max(auroc) FILTER (model = 'O') AS g FROM a GROUP BY outer_fold)
SELECT count(*) AS k, round(avg(g), 6) AS gain, round(avg(g) / sqrt(var_samp(g) * (1 / count(*) + 1 / (count(*) - 1))), 4) AS t,
 round(1 - abs(avg(g) / sqrt(var_samp(g) * (1 / count(*) + 1 / (count(*) - 1)))) / sqrt(4 + (avg(g) / sqrt(var_samp(g) * (1 / count(*) + 1 / (count(*) - 1)))) ** 2) * (1 + 2 / (4 + (avg(g) / sqrt(var_samp(g) * (1 / count(*) + 1 / (count(*) - 1)))) ** 2)), 5) AS p FROM g""")
def e9_corrected_t(spark, sf_dir):
    return bootstrap.corrected_t(_fold_scores(spark, sf_dir), []).select("k", F.round("gain", 6).alias("gain"), F.round("t", 4).alias("t"), F.round("p", 5).alias("p"))


@query(f"WITH {PRED_SQL}, a AS ({auroc_sql('model, stratum')}) SELECT model, stratum, n, n_pos, auroc, round(max(auroc) OVER (PARTITION BY model) - min(auroc) OVER (PARTITION BY model), 5) AS gap FROM a")
def e10_subgroups(spark, sf_dir):
    from pyspark.sql import Window

    out = rounded(metrics.auroc(predictions(spark, sf_dir), ["model", "stratum"]), "auroc")
    w = Window.partitionBy("model")
    return out.withColumn("gap", F.round(F.max("auroc").over(w) - F.min("auroc").over(w), 5))


@query("""WITH r AS (SELECT l_returnflag AS method_id, sum((l_discount > 0.05)::INT)::DOUBLE AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), c AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM r)
SELECT method_id, n::BIGINT AS n, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS low,
 round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS high FROM c""")
def e11_wilson(spark, sf_dir):
    r = A.result_rows(spark, sf_dir).groupBy("method_id").agg(F.sum((F.col("primary_value") > 0.05).cast("double")).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return rounded(r.select("method_id", "n", low.alias("low"), high.alias("high")), "low", "high")


@query()
def e12_mean_interval(spark, sf_dir):
    return bootstrap.mean_interval(A.result_rows(spark, sf_dir), "group_id", "primary_value", reps=2000)


@query()
def e13_sign_flip(spark, sf_dir):
    from modalens.operators import align

    pairs = align.paired_arms(A.result_rows(spark, sf_dir), ["group_id"], "arm", "primary_value", "O", "F")
    return bootstrap.sign_flip(pairs, "group_id", "gap", reps=999)


@query(f"WITH {PRED_SQL} SELECT model, round(avg(y), 6) AS prevalence FROM pred GROUP BY 1")
def e15_prevalence(spark, sf_dir):
    return rounded(metrics.prevalence(predictions(spark, sf_dir), ["model"]), "prevalence")


@query(f"WITH {A.EVENTS_DAY_SQL}, c AS (SELECT min(g) AS c FROM (SELECT count(DISTINCT group_id) AS g FROM samples GROUP BY y)) SELECT greatest(2, least(500, c, (SELECT count(DISTINCT group_id) FROM samples)))::BIGINT AS folds FROM c")
def x1_clamp(spark, sf_dir):
    return splits.clamp(A.events_day(spark, sf_dir).samples, 500, "y", "group_id")


def _even(folds, samples, label):
    """Rows of each class and fold: what every stratified split must have, whatever the hash."""
    per = folds.join(samples, "sample_id").groupBy(label, "outer_fold").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(label).agg(F.count(F.lit(1)).alias("folds"), F.sum("n").alias("rows"), F.min("n").alias("smallest"), F.max("n").alias("largest"))


_EVEN = "count(*) AS rows, (count(*) // 5)::BIGINT AS smallest, ((count(*) + 4) // 5)::BIGINT AS largest"


@query(f"WITH {A.ORDERS_SQL} SELECT 'all' AS label, 5::BIGINT AS folds, {_EVEN} FROM samples")
def x2_k_fold(spark, sf_dir):
    s = A.orders(spark, sf_dir).samples.select("sample_id", F.lit("all").alias("label"))
    return _even(splits.k_fold(s, 5), s, "label")


@query(f"WITH {A.ORDERS_SQL} SELECT label, 5::BIGINT AS folds, {_EVEN} FROM samples GROUP BY label")
def x3_stratified(spark, sf_dir):
    s = A.orders(spark, sf_dir).samples.select("sample_id", "label")
    return _even(splits.stratified(s, 5, "label"), s, "label")


def _dealt_sql(ctes: str, table: str, k: int, group: str, label: str) -> str:
    """Rows, classes and divided groups of each fold when groups are dealt in turn; which of equal groups comes first doesn't matter."""
    return f"""WITH {ctes}, per AS (SELECT {group} AS g, {label} AS c, count(*) AS m FROM {table} GROUP BY ALL),
kind AS (SELECT g, sum(m) AS size, string_agg(c, ',' ORDER BY c) AS classes, string_agg(m::VARCHAR, ',' ORDER BY c) AS counts FROM per GROUP BY g),
place AS (SELECT g, row_number() OVER (ORDER BY classes, size DESC, counts) - 1 AS pl FROM kind), fold AS (SELECT g, CASE WHEN pl // {k} % 2 = 0 THEN pl % {k} ELSE {k} - 1 - pl % {k} END::INT AS outer_fold FROM place)
SELECT outer_fold, c AS label, sum(m)::BIGINT AS n, count(DISTINCT g) AS groups, 0::BIGINT AS violations FROM per JOIN fold USING (g) GROUP BY ALL"""


def _dealt(samples, folds, label=None, group="group_id"):
    name = F.col(label).cast("string") if label else F.lit("")
    rows = samples.select("sample_id", F.col(group).alias("g"), name.alias("label")).join(folds, "sample_id")
    bad = splits.violations(samples, folds, group).agg(F.sum("n").alias("violations"))
    return rows.groupBy("outer_fold", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("g").alias("groups")).join(F.broadcast(bad))


@query(_dealt_sql(A.ORDERS_SQL, "samples", 5, "group_id", "''"))
def x4_group_folds(spark, sf_dir):
    s = A.orders(spark, sf_dir).samples
    return _dealt(s, splits.grouped(s, 5))


@query(_dealt_sql(A.EVENTS_DAY_SQL, "samples", 5, "group_id", "y::VARCHAR"))
def x5_stratified_group_folds(spark, sf_dir):
    s = A.events_day(spark, sf_dir).samples
    return _dealt(s, splits.grouped(s, 5, "y"), "y")


@query(_dealt_sql(A.SURVIVAL_SQL, "surv", 5, "(sample_id::BIGINT % 40)", "event::VARCHAR"))
def x6_survival_folds(spark, sf_dir):
    s = A.survival(spark, sf_dir).withColumn("group_id", F.col("sample_id").cast("long") % 40)
    return _dealt(s, splits.grouped(s, 5, "event"), "event")


@query(_dealt_sql(A.EVENTS_DAY_SQL, "samples", 3, "batch", "''"))
def x7_batch_folds(spark, sf_dir):
    s = A.events_day(spark, sf_dir).samples
    return _dealt(s, splits.blocked(s, 3), group="batch")


@query(f"WITH {A.EVENTS_DAY_SQL} SELECT 'naive' AS arm, y::VARCHAR AS label, 5::BIGINT AS folds, {_EVEN} FROM samples GROUP BY y")
def x8_naive_arm(spark, sf_dir):
    s = A.events_day(spark, sf_dir).samples
    return _even(splits.naive(s, 5, "y").drop("arm"), s.withColumn("label", F.col("y").cast("string")).select("sample_id", "label"), "label").withColumn("arm", F.lit("naive"))


@query(f"""WITH {A.EVENTS_DAY_SQL}, f AS (SELECT y::VARCHAR AS c, group_id AS g, (group_id::BIGINT % 5)::INT AS own FROM samples), k AS (SELECT DISTINCT own AS outer_fold FROM f),
per AS (SELECT outer_fold, g, c, count(*) AS m FROM f, k WHERE own <> outer_fold GROUP BY ALL),
kind AS (SELECT outer_fold, g, sum(m) AS size, string_agg(c, ',' ORDER BY c) AS classes, string_agg(m::VARCHAR, ',' ORDER BY c) AS counts FROM per GROUP BY ALL),
place AS (SELECT outer_fold, g, row_number() OVER (PARTITION BY outer_fold ORDER BY classes, size DESC, counts) - 1 AS pl FROM kind), fold AS (SELECT outer_fold, g, CASE WHEN pl // 4 % 2 = 0 THEN pl % 4 ELSE 3 - pl % 4 END::INT AS inner_fold FROM place)
SELECT outer_fold, inner_fold, c AS label, sum(m)::BIGINT AS n, count(DISTINCT g) AS groups, 0::BIGINT AS violations FROM per JOIN fold USING (outer_fold, g) GROUP BY ALL""")
def x9_inner_folds(spark, sf_dir):
    """Inner folds of all outer training sides; which of equal groups comes first doesn't matter for the counts."""
    s = A.events_day(spark, sf_dir).samples
    folds = s.select("sample_id", (F.col("group_id").cast("long") % 5).cast("int").alias("outer_fold"))
    inner = written(splits.inner(s, folds, 4, "y"), "inner-folds")
    bad = splits.inner_violations(s, folds, inner).agg(F.sum("n").alias("violations"))
    rows = inner.join(s.select("sample_id", "group_id", F.col("y").cast("string").alias("label")), "sample_id")
    return rows.groupBy("outer_fold", "inner_fold", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group_id").alias("groups")).join(F.broadcast(bad))


@query(f"""WITH {A.ORDERS_SQL}, f AS (SELECT *, sample_id::BIGINT % 5 AS fold FROM samples), k AS (SELECT DISTINCT fold AS outer_fold FROM f)
SELECT outer_fold::INT AS outer_fold, CASE WHEN fold = outer_fold THEN 'assessment' ELSE 'train' END AS side, count(*) AS n, count(DISTINCT label) AS classes, count(DISTINCT group_id) AS groups FROM f, k GROUP BY ALL""")
def x11_support(spark, sf_dir):
    s = A.orders(spark, sf_dir).samples
    return splits.support(s, s.select("sample_id", (F.col("sample_id").cast("long") % 5).cast("int").alias("outer_fold")), "label")


@query(f"WITH {A.SURVIVAL_SQL} SELECT count(*) AS pairs FROM surv i JOIN surv j ON j.time > i.time WHERE i.event = 1")
def x12_comparable_pairs(spark, sf_dir):
    return splits.comparable_pairs(A.survival(spark, sf_dir))


@query()
def x13_split_digest(spark, sf_dir):
    s = A.orders(spark, sf_dir).samples
    return splits.digest(splits.k_fold(s, 5))


@query()
def h1_fingerprint(spark, sf_dir):
    s = A.events_day(spark, sf_dir)
    return provenance.fingerprint(s.cells, s.samples, "y")


def _level_sql(of, keys):
    """DuckDB SQL of one key's digest: buckets by three digits, then the buckets."""
    return f"SELECT {keys}, sha256(string_agg(h, ',' ORDER BY h)) AS d, sum(n) AS n FROM (SELECT {keys}, substr(h, 1, 3), sha256(string_agg(h, ',' ORDER BY h)) AS h, sum(n) AS n FROM {of} GROUP BY ALL) GROUP BY {keys}"


def _digest_sql(value):
    return f"""WITH {A.EMBEDDINGS_SQL}, c AS (SELECT modality, feature, 1 AS n, sha256(concat_ws(chr(1), sample_id, modality, feature, ({value})::DOUBLE::BIT::BIGINT::VARCHAR)) AS h FROM cells),
f AS ({_level_sql('c', 'modality, feature')}), g AS (SELECT modality, n, sha256(concat_ws(chr(1), modality, feature, d)) AS h FROM f), m AS ({_level_sql('g', 'modality')}),
y AS (SELECT 'samples' AS part, 1 AS n, sha256(concat_ws(chr(1), sample_id, coalesce(y::VARCHAR, 'NA'))) AS h FROM samples), t AS ({_level_sql('y', 'part')}),
r AS (SELECT n, 0 AS s, sha256(concat_ws(chr(1), 'cells', modality, d)) AS h FROM m UNION ALL SELECT 0, n, sha256(concat_ws(chr(1), part, d)) FROM t)
SELECT sum(n)::BIGINT AS n_cells, sum(s)::BIGINT AS n_samples, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM r"""


_MOVED = "CASE WHEN sample_id = '7' AND feature = (SELECT min(feature) FROM cells) THEN value + 1 ELSE value END"


@query(_digest_sql("value"))
def h1_fingerprint_vectors(spark, sf_dir):
    """The digest of all vectors, by the bits of their values."""
    s = A.embeddings(spark, sf_dir)
    return provenance.fingerprint(s.cells, s.samples, "y")


@query(f"SELECT b.digest, a.digest AS expected, a.digest = b.digest AS same FROM ({_digest_sql('value')}) a, (SELECT * FROM ({_digest_sql(_MOVED)}) UNION ALL SELECT * FROM ({_digest_sql('value')})) b")
def h2_verified(spark, sf_dir):
    """The stored digest against a study in which one vector has changed, and against the same study."""
    s = A.embeddings(spark, sf_dir)
    digest = provenance.fingerprint(s.cells, s.samples, "y").first().digest
    first = s.cells.agg(F.min("feature").alias("_first"))
    moved = s.cells.join(F.broadcast(first)).withColumn("value", F.when((F.col("sample_id") == "7") & (F.col("feature") == F.col("_first")), F.col("value") + 1).otherwise(F.col("value"))).drop("_first")
    return functools.reduce(DataFrame.unionByName, [provenance.verified(provenance.fingerprint(c, s.samples, "y"), digest) for c in (moved, s.cells)])


@query(f"""WITH {A.EVENTS_DAY_SQL}, o AS (SELECT feature, sum(value) AS v, count(*) AS n FROM cells GROUP BY 1),
c AS (SELECT feature, count(*) AS n FROM cells GROUP BY 1) SELECT 'activity' AS modality, feature, 'changed' AS problem FROM c WHERE feature = 'click'""")
def h3_drift(spark, sf_dir):
    cells = A.events_day(spark, sf_dir).cells
    other = cells.withColumn("value", F.when((F.col("feature") == "click") & (F.crc32("sample_id") % 100 == 0), F.col("value") + 1).otherwise(F.col("value")))
    return provenance.drift(cells, other)


@query(f"""WITH {A.RESULT_ROWS_SQL} SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN primary_value > 0.09 THEN 'primary_value out of range' END,
 CASE WHEN method_id NOT IN ('A', 'N') THEN 'method_id not allowed' END, CASE WHEN n_samples < 2 THEN 'n_samples out of range' END]) AS rule FROM rows) WHERE rule IS NOT NULL GROUP BY 1""")
def r1_row_rules(spark, sf_dir):
    rules = {"primary_value": {"range": (0.0, 0.09)}, "method_id": {"enum": ["A", "N"], "required": True}, "n_samples": {"range": (2.0, 100.0)}, "dataset_id": {"required": True}}
    return rows.broken(A.result_rows(spark, sf_dir), rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.RESULT_ROWS_SQL} SELECT arm, method_id, count(*) AS n FROM rows GROUP BY ALL HAVING count(DISTINCT date_trunc('year', finished)) > 1")
def r2_mixed_profiles(spark, sf_dir):
    return rows.mixed(A.result_rows(spark, sf_dir).withColumn("year", F.date_trunc("year", "finished")), ["arm", "method_id"], "year")


@query(f"WITH {A.RESULT_ROWS_SQL} SELECT dataset_id, repeat, count(*) AS n FROM rows GROUP BY ALL HAVING count(*) > 1")
def r3_duplicate_keys(spark, sf_dir):
    return rows.duplicates(A.result_rows(spark, sf_dir), ["dataset_id", "repeat"])


@query(f"WITH {PRED_SQL} SELECT model, count(*) AS n, count(*) FILTER (score < 0 OR score > 1) AS n_outside, count(*) - count(DISTINCT sample_id) AS n_repeated, min(score) = max(score) AS constant FROM pred GROUP BY 1")
def r5_prediction_checks(spark, sf_dir):
    return rows.prediction_checks(predictions(spark, sf_dir))


@query(f"WITH {A.RESULT_ROWS_SQL} SELECT arm, count(*) AS n, round(avg(primary_value), 6) AS mean, abs(avg(primary_value) - 0.05) <= 0.02 AS within FROM rows WHERE method_id = 'N' GROUP BY 1")
def r6_null_behaviour(spark, sf_dir):
    return rounded(rows.null_behaviour(A.result_rows(spark, sf_dir).filter("method_id = 'N'"), ["arm"], "primary_value", 0.05, 0.02), "mean")


@query(f"""WITH t AS (SELECT o_orderkey % 20 AS cell, o_orderstatus AS truth, CASE WHEN o_totalprice > 300000 THEN 'P' WHEN o_totalprice > 150000 THEN 'O' ELSE 'F' END AS called FROM orders),
k AS (SELECT DISTINCT truth AS k FROM t), c AS (SELECT cell, k, sum((truth = k AND called = k)::INT) AS hit, sum((truth = k)::INT) AS t, sum((called = k)::INT) AS p FROM t, k GROUP BY ALL)
SELECT cell, round(avg(CASE WHEN t + p > 0 THEN 2 * hit / (t + p) ELSE 0 END), 6) AS macro_f1, round(sum(hit) / sum(t), 6) AS accuracy FROM c WHERE t + p > 0 GROUP BY 1""")
def r8_role_recovery(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    called = F.when(F.col("o_totalprice") > 300000, "P").when(F.col("o_totalprice") > 150000, "O").otherwise("F")
    t = o.select((F.col("o_orderkey") % 20).alias("cell"), F.col("o_orderstatus").alias("y"), called.alias("pred"))
    return rounded(metrics.confusion_scores(t, ["cell"]).select("cell", "macro_f1", "accuracy"), "macro_f1", "accuracy")


@query(f"""WITH {A.RESULT_ROWS_SQL} SELECT method_id, arm, count(*) AS attempted, count(*) FILTER (primary_value >= 0.02) AS scored, round(avg(primary_value) FILTER (primary_value >= 0.02), 6) AS mean_scored,
 round(sum(primary_value) FILTER (primary_value >= 0.02) / count(*), 6) AS mean_attempted FROM rows GROUP BY ALL""")
def r10_predictive_table(spark, sf_dir):
    r = A.result_rows(spark, sf_dir).withColumn("primary_value", F.when(F.col("primary_value") >= 0.02, F.col("primary_value")))
    return rounded(rows.predictive_table(r, ["method_id", "arm"]), "mean_scored", "mean_attempted")


@query(f"""WITH {A.RESULT_ROWS_SQL} SELECT method_id, round(avg((primary_value > 0.05)::INT) FILTER (n_samples > 25), 6) AS sensitivity, round(avg((primary_value <= 0.05)::INT) FILTER (n_samples <= 25), 6) AS specificity FROM rows GROUP BY 1""")
def r11_flag_quality(spark, sf_dir):
    r = A.result_rows(spark, sf_dir).select("method_id", (F.col("primary_value") > 0.05).alias("flag"), (F.col("n_samples") > 25).alias("truth"))
    return rounded(rows.flag_quality(r, ["method_id"]), "sensitivity", "specificity")


@query(f"""WITH {A.RESULT_ROWS_SQL}, m AS (SELECT method_id, n_samples, avg(primary_value) AS v FROM rows GROUP BY ALL), l AS (SELECT *, lag(v) OVER (PARTITION BY method_id ORDER BY n_samples) AS before FROM m)
SELECT method_id, n_samples, round(v, 6) AS mean, coalesce(v < before - 0.002, false) AS worse FROM l""")
def r12_more_data_not_worse(spark, sf_dir):
    return rounded(rows.not_worse(A.result_rows(spark, sf_dir), ["method_id"], "n_samples", "primary_value", 0.002), "mean")


@query(f"WITH {A.RESULT_ROWS_SQL} SELECT method_id, arm, count(*) AS n FROM rows WHERE primary_value = 0 GROUP BY ROLLUP (method_id, arm)")
def r13_failure_counts(spark, sf_dir):
    return rows.failure_counts(A.result_rows(spark, sf_dir).filter("primary_value = 0"), ["method_id", "arm"])


@query(f"""WITH {A.RESULT_ROWS_SQL}, w AS (SELECT count(*) AS expected FROM orders) SELECT method_id, count(DISTINCT dataset_id) AS done, any_value(expected) - count(DISTINCT dataset_id) AS outstanding,
 round((count(*) - 1) / (epoch(max(finished) - min(finished)) / 3600), 6) AS per_hour FROM rows, w GROUP BY 1""")
def r14_progress(spark, sf_dir):
    n = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("expected"))
    return rounded(rows.progress(A.result_rows(spark, sf_dir), n, ["method_id"], "dataset_id", "finished"), "per_hour")


@query(f"""WITH {PRED_SQL}, m AS ({auroc_sql('model, stratum')}), b AS (SELECT stratum, model, auroc, row_number() OVER (PARTITION BY stratum ORDER BY auroc DESC, model) AS rn FROM m)
SELECT stratum, model AS best_model, auroc AS best FROM b WHERE rn = 1""")
def u7_best_model(spark, sf_dir):
    scores = rounded(metrics.auroc(predictions(spark, sf_dir), ["model", "stratum"]), "auroc")
    return ledger.best(scores, ["stratum"], "model", "auroc").select("stratum", F.col("name").alias("best_model"), F.col("value").alias("best"))


@query(f"""WITH {A.EMBEDDINGS_SQL}, m AS (SELECT feature, modality, avg(value) AS mu, stddev_pop(value) AS sd FROM cells GROUP BY ALL), z AS (SELECT sample_id, modality, feature, (value - mu) / sd AS z FROM cells JOIN m USING (feature, modality) WHERE sd > 0),
g AS (SELECT a.modality AS ma, b.modality AS mb, a.feature AS fa, b.feature AS fb, sum(a.z * b.z) AS c FROM z a JOIN z b USING (sample_id) GROUP BY ALL), s AS (SELECT ma, mb, sum(c * c) AS s FROM g GROUP BY ALL)
SELECT ab.ma AS modality_a, ab.mb AS modality_b, round(ab.s / sqrt(aa.s * bb.s), 6) AS cka FROM s ab JOIN s aa ON aa.ma = ab.ma AND aa.mb = ab.ma JOIN s bb ON bb.ma = ab.mb AND bb.mb = ab.mb WHERE ab.ma < ab.mb""")
def u1_cka(spark, sf_dir):
    return rounded(ledger.cka(A.embeddings(spark, sf_dir).cells), "cka")


#: Models over three modalities, by return flag: each alone, all together, all but one. The score of R is noise.
FOLD_SQL = f"""{PRED_SQL}, lm AS (SELECT l_returnflag AS m, (l_orderkey % 5)::INT AS outer_fold, (l_quantity > 25)::INT AS y, CASE l_returnflag WHEN 'R' THEN l_tax WHEN 'N' THEN l_extendedprice / 100000 ELSE l_extendedprice / 100000 + l_tax * 4 END AS score FROM lineitem),
ms AS (SELECT 'linear::' || m AS model, * FROM lm UNION ALL SELECT 'linear::FUSION', * FROM lm UNION ALL SELECT 'linear::FUSION-minus-' || x, lm.* FROM lm, (VALUES ('A'), ('N'), ('R')) v(x) WHERE m <> x),
fr AS (SELECT *, rank() OVER (PARTITION BY model, outer_fold ORDER BY score) + (count(*) OVER (PARTITION BY model, outer_fold, score) - 1) / 2 AS r, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS rp FROM ms),
fs AS (SELECT model, outer_fold, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS score FROM fr GROUP BY ALL),
ps AS (SELECT model, (sum(rp) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS score FROM fr GROUP BY ALL),
gg AS (SELECT right(w.model, 1) AS modality, f.score - w.score AS g FROM fs f JOIN fs w USING (outer_fold) WHERE f.model = 'linear::FUSION' AND w.model LIKE '%-minus-%'),
gt AS (SELECT modality, count(*) AS k, avg(g) AS gain, avg(g) / sqrt(var_samp(g) * (1 / count(*) + 1 / (count(*) - 1))) AS t FROM gg GROUP BY 1),
gp AS (SELECT *, 1 - abs(t) / sqrt(4 + t * t) * (1 + 2 / (4 + t * t)) AS gain_p FROM gt),
al AS (SELECT right(model, 1) AS modality, score AS alone FROM ps WHERE model NOT LIKE '%FUSION%'),
sp AS (SELECT l_suppkey, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS a, avg(l_extendedprice) FILTER (l_returnflag = 'N') AS n, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3),
ck(modality_a, modality_b, cka) AS (SELECT 'A', 'N', corr(a, n) ** 2 FROM sp UNION ALL SELECT 'A', 'R', corr(a, r) ** 2 FROM sp UNION ALL SELECT 'N', 'R', corr(n, r) ** 2 FROM sp),
pa AS (SELECT x.modality, y.modality AS partner, cka FROM al x JOIN al y ON x.modality <> y.modality AND y.alone >= x.alone JOIN ck ON modality_a = least(x.modality, y.modality) AND modality_b = greatest(x.modality, y.modality)
 QUALIFY row_number() OVER (PARTITION BY x.modality ORDER BY cka DESC, partner) = 1)"""


def _models(spark, sf_dir):
    m, price = F.col("l_returnflag"), F.col("l_extendedprice") / 100000
    score = F.when(m == "R", F.col("l_tax")).when(m == "N", price).otherwise(price + F.col("l_tax") * 4)
    minus = F.transform(F.filter(F.array(*map(F.lit, "ANR")), lambda x: x != m), lambda x: F.concat(F.lit("linear::FUSION-minus-"), x))
    names = F.concat(F.array(F.concat(F.lit("linear::"), m), F.lit("linear::FUSION")), minus)
    return table(spark, sf_dir, "lineitem").select(F.explode(names).alias("model"), (F.col("l_orderkey") % 5).cast("int").alias("outer_fold"), (F.col("l_quantity") > 25).cast("int").alias("y"), score.alias("score"))


def _ledger(spark, sf_dir):
    rows = _models(spark, sf_dir)
    folds = metrics.auroc(rows, ["model", "outer_fold"]).select("model", "outer_fold", F.col("auroc").alias("score"))
    pooled = metrics.auroc(rows, ["model"]).select("model", F.col("auroc").alias("score"))
    price = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("sample_id"), F.col("l_returnflag").alias("modality"), F.lit("price").alias("feature")).agg(F.avg("l_extendedprice").alias("value"))
    complete = price.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 3")
    return ledger.gains(folds), ledger.standalone(pooled), ledger.cka(price.join(complete, "sample_id", "left_semi"))


@query(f"WITH {FOLD_SQL} SELECT modality, k, round(gain, 6) AS gain, round(t, 3) AS t, round(gain_p, 5) AS gain_p, round(alone, 6) AS alone FROM gp JOIN al USING (modality)")
def u2_gains(spark, sf_dir):
    gains, alone, _ = _ledger(spark, sf_dir)
    out = gains.join(alone, "modality")
    return out.select("modality", "k", F.round("gain", 6).alias("gain"), F.round("t", 3).alias("t"), F.round("gain_p", 5).alias("gain_p"), F.round("alone", 6).alias("alone"))


@query(f"WITH {FOLD_SQL} SELECT modality, partner, round(cka, 5) AS cka FROM pa".replace("FROM lineitem GROUP BY 1),\npa", "FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3),\npa"))
def u3_partners(spark, sf_dir):
    _, alone, aligned = _ledger(spark, sf_dir)
    return ledger.partner(aligned, alone).select("modality", "partner", F.round("cka", 5).alias("cka"))


@query("""WITH c AS (SELECT 'control::' || l_linenumber AS name, avg((l_quantity > 20)::INT) AS score, CASE WHEN l_linenumber < 5 THEN avg((l_quantity > 20)::INT) - 0.05 * l_linenumber END AS ci_low FROM lineitem GROUP BY l_linenumber)
SELECT name, round(score, 6) AS score, (ci_low IS NULL OR ci_low > 0.45) AND score > 0.45 + 0.12 AS leak FROM c""")
def u4_leaks(spark, sf_dir):
    score = F.avg((F.col("l_quantity") > 20).cast("int"))
    c = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(score.alias("score"))
    c = c.select(F.concat(F.lit("control::"), F.col("l_linenumber").cast("string")).alias("name"), "score", F.when(F.col("l_linenumber") < 5, F.col("score") - 0.05 * F.col("l_linenumber")).alias("ci_low"))
    return ledger.leaks(c, chance=0.45).select("name", F.round("score", 6).alias("score"), "leak")


@query(f"""WITH {FOLD_SQL}, b AS (SELECT l_returnflag AS modality, avg((l_linestatus = 'F')::INT) > 0.9 AS structured FROM lineitem GROUP BY 1),
v AS (SELECT modality, structured, gain, gain_p, alone > 0.55 AS useful, partner, cka, gain > 0.01 AS pos, gain > 0.01 AND gain_p < 0.05 AS sig FROM gp JOIN al USING (modality) JOIN b USING (modality) LEFT JOIN pa USING (modality))
SELECT o.confounded, modality, CASE WHEN sig THEN 'adds_sig' WHEN pos THEN 'adds_ns' ELSE 'none' END AS gain_state, partner IS NOT NULL AND coalesce(cka > 0.5, false) AND NOT sig AS redundant,
 CASE WHEN structured AND o.confounded AND NOT sig THEN 'batch-confounded (no marginal gain)' WHEN useful AND sig THEN 'predictive (adds marginal signal)' WHEN useful AND pos THEN 'informative alone (fusion gain not significant)'
 WHEN useful AND partner IS NOT NULL AND cka > 0.5 THEN 'redundant (subsumed by ' || partner || ')' WHEN useful THEN 'informative but non-additive' ELSE 'no detectable signal (control-like)' END AS verdict
FROM v, (VALUES (true), (false)) o(confounded)""".replace("FROM lineitem GROUP BY 1),\npa", "FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3),\npa"))
def u6_verdicts(spark, sf_dir):
    gains, alone, aligned = _ledger(spark, sf_dir)
    batch = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("modality")).agg((F.avg((F.col("l_linestatus") == "F").cast("int")) > 0.9).alias("structured"))
    t = gains.join(alone, "modality").join(batch, "modality").join(ledger.partner(aligned, alone), "modality", "left")
    one = lambda c: ledger.verdicts(t.withColumn("confounded", F.lit(c))).withColumn("confounded", F.lit(c))
    return one(True).unionByName(one(False))


@query(f"""WITH {FOLD_SQL}, b AS (SELECT avg(score) AS blocked FROM fs WHERE model = 'linear::FUSION-minus-A') SELECT round(score, 6) AS standard, round(blocked, 6) AS blocked, round(score - blocked, 6) AS optimism_gap FROM ps, b WHERE model = 'linear::FUSION'""")
def u8_optimism(spark, sf_dir):
    rows = _models(spark, sf_dir)
    pooled = metrics.auroc(rows, ["model"]).select("model", F.col("auroc").alias("score"))
    blocked = metrics.auroc(rows.filter("model = 'linear::FUSION-minus-A'"), ["outer_fold"]).agg(F.avg("auroc").alias("score")).select(F.lit("stress::batch-blocked-FUSION").alias("model"), "score")
    return rounded(ledger.optimism(pooled.unionByName(blocked)), "standard", "blocked", "optimism_gap")
