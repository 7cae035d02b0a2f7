"""Stateless scoring of a stream of readings.

The reference has no streaming; its per-row operators (calendar features,
a fitted detector's score and decision) are stateless, so they run
unchanged on a streaming DataFrame. Statistics are fitted on a batch
table first and enter the stream as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wattlane.functions.calendar import add_calendar
from wattlane.session import scratch_path


def readings_stream(spark: SparkSession, path: str, schema: StructType,
                    max_files_per_trigger: int = 1) -> DataFrame:
    """``events``-shaped parquet files arriving under ``path`` as readings."""
    ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
    return ev.select(F.col("event_id").alias("reading_id"), F.col("user_id").alias("building_id"),
                     F.col("ts").alias("timestamp"), F.col("value").alias("meter_reading"))


def zscore_scorer(stats_row: dict, threshold: float = 3.0):
    """A row-wise detector from batch statistics: |z| and |z| > threshold."""
    def apply(df: DataFrame) -> DataFrame:
        z = F.abs((F.col("meter_reading") - F.lit(stats_row["mean"])) / F.lit(stats_row["std"]))
        return df.withColumns({"score": z, "prediction": (z > F.lit(threshold)).cast("int")})
    return apply


def score_stream(stream: DataFrame, scorer, sink_path: str, checkpoint: str | None = None,
                 available_now: bool = True):
    """Calendar features + scorer, appended to a parquet sink. The
    checkpoint lives in the shared scratch folder unless given."""
    spark = stream.sparkSession
    out = scorer(add_calendar(stream, minute=False))
    w = (out.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
