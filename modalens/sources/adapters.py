"""Studies over the driver's tables: cells (observed values, long), samples (one row each) and features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalens.session import table


@dataclass
class Study:
    """cells(sample_id, modality, feature, value), samples(sample_id, y, group_id, batch), features(modality, feature)."""

    cells: DataFrame
    samples: DataFrame

    @property
    def features(self) -> DataFrame:
        return self.cells.select("modality", "feature").distinct()


def events_day(spark: SparkSession, sf_dir: str) -> Study:
    """User-days by event type. The class is whether the day has an error; that type is no feature."""
    e = table(spark, sf_dir, "events").select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("sample_id"),
        "user_id", "event_type", "value", F.weekday("ts").cast("string").alias("batch"),
    )
    cells = e.filter("event_type <> 'error'").groupBy("sample_id", F.lit("activity").alias("modality"), F.col("event_type").alias("feature")).agg(F.avg("value").alias("value"))
    samples = e.groupBy("sample_id").agg(
        F.max((F.col("event_type") == "error").cast("int")).alias("y"), F.min(F.col("user_id").cast("string")).alias("group_id"), F.min("batch").alias("batch")
    )
    return Study(cells, samples)


#: The same study in DuckDB: CTEs cells, samples, features.
EVENTS_DAY_SQL = """
e AS (SELECT user_id::VARCHAR || '|' || strftime(ts, '%Y-%m-%d') AS sample_id, user_id, event_type, value,
             (isodow(ts) - 1)::VARCHAR AS batch FROM events),
cells AS (SELECT sample_id, 'activity' AS modality, event_type AS feature, avg(value) AS value
          FROM e WHERE event_type <> 'error' GROUP BY ALL),
samples AS (SELECT sample_id, max((event_type = 'error')::INT) AS y, min(user_id::VARCHAR) AS group_id, min(batch) AS batch
            FROM e GROUP BY sample_id),
features AS (SELECT DISTINCT modality, feature FROM cells)
"""


def embeddings(spark: SparkSession, sf_dir: str) -> Study:
    """Vectors split into two modalities of 32 dimensions; ten classes, groups and batches by id."""
    e = table(spark, sf_dir, "embeddings")
    spread = e.repartition("vec_id")  # a small file is one task's, and each row makes as many cells as it has dimensions
    long = spread.select(F.col("vec_id").cast("string").alias("sample_id"), F.posexplode("embedding").alias("ix", "value"))
    cells = long.select(
        "sample_id", F.when(F.col("ix") < 32, "emb_lo").otherwise("emb_hi").alias("modality"),
        F.format_string("d%02d", "ix").alias("feature"), F.col("value").cast("double").alias("value"),
    )
    samples = e.select(
        F.col("vec_id").cast("string").alias("sample_id"), F.col("label").alias("y"),
        (F.col("vec_id") % 50).cast("string").alias("group_id"), (F.col("vec_id") % 5).cast("string").alias("batch"),
    )
    return Study(cells, samples)


EMBEDDINGS_SQL = """
cells AS (SELECT vec_id::VARCHAR AS sample_id, CASE WHEN ix < 33 THEN 'emb_lo' ELSE 'emb_hi' END AS modality,
                 printf('d%02d', ix - 1) AS feature, embedding[ix]::DOUBLE AS value
          FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS ix FROM embeddings)),
samples AS (SELECT vec_id::VARCHAR AS sample_id, label AS y, (vec_id % 50)::VARCHAR AS group_id, (vec_id % 5)::VARCHAR AS batch
            FROM embeddings),
features AS (SELECT DISTINCT modality, feature FROM cells)
"""


def orders(spark: SparkSession, sf_dir: str) -> Study:
    """Orders with the moments of their lines and of their parts; class by status, groups by customer, batch by priority."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    sample = F.col("l_orderkey").cast("string").alias("sample_id")
    a = lines.groupBy(sample).agg(*[F.avg(f"l_{c}").alias(c) for c in ("quantity", "extendedprice", "discount", "tax")])
    b = lines.join(parts, "l_partkey").groupBy(sample).agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("retailprice"))
    long = lambda x, m: x.unpivot("sample_id", [c for c in x.columns if c != "sample_id"], "feature", "value").withColumn("modality", F.lit(m))
    cells = long(a, "lines").unionByName(long(b, "parts")).select("sample_id", "modality", "feature", "value")
    o = table(spark, sf_dir, "orders")
    samples = o.select(
        F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderstatus").alias("label"), F.col("o_totalprice").alias("target"),
        F.col("o_custkey").cast("string").alias("group_id"), F.col("o_orderpriority").alias("batch"),
    )
    return Study(cells, samples)


ORDERS_SQL = """
la AS (SELECT l_orderkey::VARCHAR AS sample_id, avg(l_quantity) AS quantity, avg(l_extendedprice) AS extendedprice,
              avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1),
lb AS (SELECT l_orderkey::VARCHAR AS sample_id, avg(p_size) AS size, avg(p_retailprice) AS retailprice
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
cells AS (SELECT sample_id, 'lines' AS modality, feature, value FROM (UNPIVOT la ON quantity, extendedprice, discount, tax INTO NAME feature VALUE value)
          UNION ALL SELECT sample_id, 'parts', feature, value FROM (UNPIVOT lb ON size, retailprice INTO NAME feature VALUE value)),
samples AS (SELECT o_orderkey::VARCHAR AS sample_id, o_orderstatus AS label, o_totalprice AS target, o_custkey::VARCHAR AS group_id,
                   o_orderpriority AS batch FROM orders)
"""


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, time, event, batch, x): per user, days from the first week to the first later purchase, else to the end.

    x is the number of clicks in the first week, batch the weekday of the first event.
    """
    e = table(spark, sf_dir, "events").withColumn("day", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")))
    end = e.agg(F.max("day").alias("end"))
    later = F.col("event_type").eqNullSafe("purchase") & (F.col("day") >= 7)
    per = e.groupBy(F.col("user_id").cast("string").alias("sample_id")).agg(
        F.min(F.when(later, F.col("day"))).alias("seen"),
        F.sum(((F.col("day") < 7) & (F.col("event_type") == "click")).cast("long")).alias("x"),
        F.weekday(F.min("ts")).cast("string").alias("batch"),
    )
    return per.join(F.broadcast(end)).select(
        "sample_id", (F.coalesce("seen", "end") - 6).cast("double").alias("time"), F.col("seen").isNotNull().cast("int").alias("event"), "batch", F.col("x").cast("double").alias("x")
    )


SURVIVAL_SQL = """
ev AS (SELECT user_id::VARCHAR AS sample_id, ts, event_type, datediff('day', DATE '2024-01-01', ts::DATE) AS day FROM events),
surv AS (SELECT sample_id, (coalesce(min(day) FILTER (event_type = 'purchase' AND day >= 7), (SELECT max(day) FROM ev)) - 6)::DOUBLE AS time,
                (min(day) FILTER (event_type = 'purchase' AND day >= 7) IS NOT NULL)::INT AS event,
                (isodow(min(ts)) - 1)::VARCHAR AS batch, (count(*) FILTER (day < 7 AND event_type = 'click'))::DOUBLE AS x
         FROM ev GROUP BY sample_id)
"""


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result row per line item: dataset, method, arm, split, value, group."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("dataset_id"), F.col("l_returnflag").alias("method_id"), F.col("l_linestatus").alias("arm"),
        F.col("l_linenumber").alias("repeat"), F.col("l_discount").alias("primary_value"), F.col("l_suppkey").cast("string").alias("group_id"),
        F.col("l_quantity").alias("n_samples"), F.col("l_shipdate").alias("finished"),
    )


RESULT_ROWS_SQL = """
rows AS (SELECT l_orderkey::VARCHAR AS dataset_id, l_returnflag AS method_id, l_linestatus AS arm, l_linenumber AS repeat,
                l_discount AS primary_value, l_suppkey::VARCHAR AS group_id, l_quantity AS n_samples, l_shipdate AS finished
         FROM lineitem)
"""
