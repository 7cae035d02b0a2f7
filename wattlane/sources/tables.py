"""Driver tables and the meter-panel views defined over them.

Each view is a lazy projection of one parquet scan, so column pruning and
filters reach the scan. Missing values are NULL only: NaN is mapped to
NULL on ingest (pandas skips NaN, Spark would propagate it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Fixed value: the label rule of the `readings` view (reading above 150 = anomalous).
ANOMALY_VALUE = 150.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nan_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def readings(spark: SparkSession, sf_dir: str, nan_safe: bool = True) -> DataFrame:
    """Labelled panel: one row per reading of one building.

    ``nan_safe=True`` maps NaN readings to NULL. That CASE expression keeps
    predicates on the reading itself from reaching the parquet scan (key
    and time predicates still do); pass ``nan_safe=False`` for sources known
    to hold no NaN so that value filters are pushed down too."""
    ev = table(spark, sf_dir, "events")
    value = nan_to_null("value") if nan_safe else F.col("value")
    return ev.select(
        F.col("event_id").alias("reading_id"),
        F.col("user_id").alias("building_id"),
        F.col("ts").alias("timestamp"),
        value.alias("meter_reading"),
        (F.col("value") > F.lit(ANOMALY_VALUE)).cast("int").alias("anomaly"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with a label that is no function of the reading: ``label`` =
    1 where the event is an error, and the event's type."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("reading_id"),
        F.col("user_id").alias("building_id"),
        F.col("ts").alias("timestamp"),
        nan_to_null("value").alias("meter_reading"),
        F.col("event_type"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with a label (event_type = 'error') and a score (value)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("reading_id"),
        F.col("user_id").alias("building_id"),
        F.col("ts").alias("timestamp"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        nan_to_null("value").alias("score"),
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2x2 evaluation fixture: prediction = 1 - quality, label = toxic."""
    lb = table(spark, sf_dir, "labels")
    return lb.select(
        F.col("doc_id").alias("key"),
        F.col("toxic").alias("label"),
        (F.lit(1) - F.col("quality")).alias("prediction"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem seen as a panel over years: supplier = building.

    (timestamp, l_orderkey, l_linenumber, l_partkey, building_id, value) is
    the total order used by the single-series windows: order key and line
    number alone repeat in the driver's table."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("building_id"),
        F.col("l_shipdate").alias("timestamp"),
        nan_to_null("l_extendedprice").alias("value"),
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_partkey"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a numeric matrix: vec_id, label, embedding (array<double>)."""
    em = table(spark, sf_dir, "embeddings")
    return em.select("vec_id", "label",
                     F.col("embedding").cast("array<double>").alias("embedding"))


def readings_hourly(spark: SparkSession, sf_dir: str, stage: bool = True) -> DataFrame:
    """Every building x every hour between the global first and last hour.

    Hours without a reading hold NULL. Readings are pre-aggregated to
    (building, hour) before the join, so a hot building only weighs one
    hour's rows per join key. ``stage=True`` writes the result once to the
    shared scratch folder: the operators that use it make several passes.
    """
    from wattlane.functions.calendar import hourly_spine

    r = readings(spark, sf_dir)
    per_hour = (r.groupBy("building_id", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp"))
                .agg(F.sum("meter_reading").alias("meter_reading")))
    spine = hourly_spine(r, ["building_id"], "timestamp")
    out = spine.join(per_hour, ["building_id", "timestamp"], "left")
    if stage:
        from wattlane.session import materialize
        out = materialize(out, "readings-hourly")
    return out


# --------------------------------------------------------------------------
# The same views as DuckDB SQL text, used by the oracle queries.

SQL_READINGS = """readings AS (
  SELECT event_id AS reading_id, user_id AS building_id, ts AS "timestamp",
         CASE WHEN isnan(value) THEN NULL ELSE value END AS meter_reading,
         CAST(value > 150 AS INTEGER) AS anomaly
  FROM events)"""

SQL_LABELLED = """labelled AS (
  SELECT event_id AS reading_id, user_id AS building_id, ts AS "timestamp",
         CASE WHEN isnan(value) THEN NULL ELSE value END AS meter_reading, event_type,
         CAST(event_type = 'error' AS INTEGER) AS label
  FROM events)"""

SQL_SCORED = """scored AS (
  SELECT event_id AS reading_id, user_id AS building_id, ts AS "timestamp",
         CAST(event_type = 'error' AS INTEGER) AS label,
         CASE WHEN isnan(value) THEN NULL ELSE value END AS score
  FROM events)"""

SQL_QUALITY = """quality AS (
  SELECT doc_id AS key, toxic AS label, 1 - quality AS prediction FROM labels)"""

SQL_SHIPMENTS = """shipments AS (
  SELECT l_suppkey AS building_id, l_shipdate AS "timestamp",
         CASE WHEN isnan(l_extendedprice) THEN NULL ELSE l_extendedprice END AS value,
         l_orderkey, l_linenumber, l_partkey
  FROM lineitem)"""

SQL_READINGS_HOURLY = SQL_READINGS + """,
bounds AS (SELECT date_trunc('hour', min("timestamp")) AS lo,
                  date_trunc('hour', max("timestamp")) AS hi FROM readings),
spine AS (
  SELECT b.building_id, CAST(h.ts AS TIMESTAMP) AS "timestamp"
  FROM (SELECT DISTINCT building_id FROM readings) b
  CROSS JOIN bounds
  CROSS JOIN LATERAL (SELECT unnest(generate_series(bounds.lo, bounds.hi, INTERVAL 1 HOUR)) AS ts) h),
per_hour AS (
  SELECT building_id, date_trunc('hour', "timestamp") AS "timestamp",
         sum(meter_reading) AS meter_reading
  FROM readings GROUP BY 1, 2),
readings_hourly AS (
  SELECT s.building_id, s."timestamp", p.meter_reading
  FROM spine s LEFT JOIN per_hour p
    ON s.building_id = p.building_id AND s."timestamp" = p."timestamp")"""
