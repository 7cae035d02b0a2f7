"""CSV sources and sinks, required/optional source checks, model persistence."""

from __future__ import annotations

import json

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DoubleType, FloatType, IntegerType, LongType,
                               StructField, StructType, TimestampNTZType)

from wattlane.sources.tables import nan_to_null

# CSV text format for timestamps without zone: microseconds kept.
NTZ_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

PANEL_SCHEMA = StructType([
    StructField("reading_id", LongType()), StructField("building_id", LongType()),
    StructField("timestamp", TimestampNTZType()), StructField("meter_reading", DoubleType()),
    StructField("anomaly", IntegerType())])

# Narrow types of the typed load: int32 key, float32 reading, int8 label.
PANEL_SCHEMA_NARROW = StructType([
    StructField("reading_id", LongType()), StructField("building_id", IntegerType()),
    StructField("timestamp", TimestampNTZType()), StructField("meter_reading", FloatType()),
    StructField("anomaly", ByteType())])


class SourceMissing(Exception):
    """A required source is absent."""


def write_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    """Header CSV without an index column; timestamps keep microseconds."""
    (df.write.mode(mode).option("header", True).option("timestampNTZFormat", NTZ_FORMAT)
     .csv(path))
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Header CSV with a declared schema (no inference pass); NaN -> NULL for
    floating columns."""
    df = (spark.read.option("header", True).option("timestampNTZFormat", NTZ_FORMAT)
          .option("mode", "FAILFAST").schema(schema).csv(path))
    fl = [f.name for f in schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: nan_to_null(c) for c in fl}) if fl else df


def try_load(spark: SparkSession, path: str, fmt: str = "parquet",
             schema: StructType | None = None) -> DataFrame | None:
    """DataFrame, or None when the path does not exist."""
    try:
        r = spark.read.format(fmt)
        if schema is not None:
            r = r.schema(schema)
        if fmt == "csv":
            r = r.option("header", True)
        df = r.load(path)
        df.schema  # resolve now so a missing path fails here
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def require(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """Load required sources or raise ``SourceMissing`` naming the first absent one."""
    out = {}
    for name, path in paths.items():
        df = try_load(spark, path, fmt)
        if df is None:
            raise SourceMissing(f"missing source: {path}")
        out[name] = df
    return out


def source_status(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet",
                  required: bool = True) -> DataFrame:
    """(source, present, message, n_rows) per source; counts are lazy
    aggregates over the present tables."""
    parts = []
    for name, path in paths.items():
        df = try_load(spark, path, fmt)
        if df is None:
            msg = f"missing file: {path}" if required else "optional source absent, continuing"
            parts.append(spark.range(1).select(
                F.lit(name).alias("source"), F.lit(False).alias("present"),
                F.lit(msg).alias("message"), F.lit(None).cast("long").alias("n_rows")))
        else:
            parts.append(df.select(
                F.lit(name).alias("source"), F.lit(True).alias("present"),
                F.lit("ok").alias("message"), F.count(F.lit(1)).alias("n_rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_model(model, path: str) -> str:
    """Spark ML models and pipelines: native writer; own models (DataFrames
    of parameters) are written as parquet by their own ``save``."""
    model.write().overwrite().save(path)
    return path


def save_meta(spark: SparkSession, path: str, meta: dict) -> str:
    """A model's parameters (bounded) as one JSON row."""
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return path


def load_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])


def load_models(spark: SparkSession, paths: dict[str, str], loaders: dict[str, Callable] | None = None):
    """Load the models that exist, skipping absent ones."""
    from pyspark.ml import PipelineModel

    out = {}
    for name, path in paths.items():
        if try_load(spark, path + "/metadata", "text") is None:
            continue
        loader = (loaders or {}).get(name, PipelineModel.load)
        out[name] = loader(path)
    return out

