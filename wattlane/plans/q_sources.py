"""S*: scans, source checks and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlane.plans.catalog import R, register
from wattlane.session import scratch_path
from wattlane.sources import files as FS
from wattlane.sources import tables as T


def _csv_roundtrip(spark, sf_dir, schema):
    path = scratch_path(spark, "readings-csv")
    FS.write_csv(T.readings(spark, sf_dir), path)
    return FS.read_csv(spark, path, schema)


@register("S1_csv_scan_declared_schema", R + "SELECT * FROM readings")
def s1(spark, sf_dir):
    """Readings written as header CSV (S6) and scanned back with a declared schema."""
    return _csv_roundtrip(spark, sf_dir, FS.PANEL_SCHEMA)


@register("S2_csv_scan_narrow_types", R + """
SELECT CAST(building_id AS INTEGER) AS building_id, count(*) AS n_rows,
       sum(CAST(CAST(meter_reading AS FLOAT) AS DOUBLE)) AS total_reading,
       CAST(sum(CAST(anomaly AS TINYINT)) AS BIGINT) AS anomalies
FROM readings GROUP BY 1""")
def s2(spark, sf_dir):
    """Typed scan: int32 key, float32 reading, int8 label; widened to double
    before aggregating."""
    df = _csv_roundtrip(spark, sf_dir, FS.PANEL_SCHEMA_NARROW)
    return df.groupBy("building_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("meter_reading").cast("double")).alias("total_reading"),
        F.sum(F.col("anomaly").cast("int")).cast("long").alias("anomalies"))


@register("S3_required_sources", """
SELECT 'events' AS source, true AS present, 'ok' AS message, (SELECT count(*) FROM events) AS n_rows
UNION ALL
SELECT 'lineitem', true, 'ok', (SELECT count(*) FROM lineitem)""")
def s3(spark, sf_dir):
    """Status of the required sources; a missing one would read present=false."""
    return FS.source_status(spark, {"events": f"{sf_dir}/events.parquet",
                                    "lineitem": f"{sf_dir}/lineitem.parquet"})


@register("S4_optional_sources", """
SELECT 'labels' AS source, true AS present, 'ok' AS message, (SELECT count(*) FROM labels) AS n_rows
UNION ALL
SELECT 'readings_features', false, 'optional source absent, continuing', CAST(NULL AS BIGINT)""")
def s4(spark, sf_dir):
    """Optional sources: an absent feature table is reported and skipped."""
    return FS.source_status(spark, {"labels": f"{sf_dir}/labels.parquet",
                                    "readings_features": f"{sf_dir}/readings_features.parquet"},
                            required=False)


@register("S5_timestamp_parse", R + """
SELECT reading_id, CAST(strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS TIMESTAMP) AS "timestamp"
FROM readings""")
def s5(spark, sf_dir):
    """Timestamps rendered as text and parsed back without a zone."""
    r = T.readings(spark, sf_dir)
    txt = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return r.select("reading_id", F.to_timestamp_ntz(txt, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
                    .alias("timestamp"))


@register("S6_csv_sink", R + "SELECT count(*) AS n_rows, sum(meter_reading) AS total FROM readings")
def s6(spark, sf_dir):
    """CSV sink without index; the written files are read back and totalled."""
    df = _csv_roundtrip(spark, sf_dir, FS.PANEL_SCHEMA)
    return df.select(F.count(F.lit(1)).alias("n_rows"), F.sum("meter_reading").alias("total"))


@register("S7_submission", R + "SELECT reading_id AS row_id, 0 AS anomaly FROM readings")
def s7(spark, sf_dir):
    """Submission table (row_id, anomaly = 0) written as CSV and returned."""
    sub = T.readings(spark, sf_dir).select(F.col("reading_id").alias("row_id"),
                                           F.lit(0).alias("anomaly"))
    path = scratch_path(spark, "submission")
    FS.write_csv(sub, path)
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType
    return FS.read_csv(spark, path, StructType([StructField("row_id", LongType()),
                                                StructField("anomaly", IntegerType())]))
