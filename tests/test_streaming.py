from pyspark.sql import functions as F

from wattlane.session import scratch_path
from wattlane.sources import tables as T
from wattlane.streaming.scoring import readings_stream, score_stream, zscore_scorer
from tests.conftest import SF_SMALL


def test_stream_scoring_matches_batch(spark):
    events = T.table(spark, SF_SMALL, "events")
    src = scratch_path(spark, "stream-src")
    events.repartition(3).write.parquet(src)
    stats = T.readings(spark, SF_SMALL).select(F.avg("meter_reading").alias("mean"),
                                               F.stddev_samp("meter_reading").alias("std")).first().asDict()
    sink = scratch_path(spark, "stream-sink")
    q = score_stream(readings_stream(spark, src, events.schema), zscore_scorer(stats), sink)
    q.awaitTermination(120)
    got = spark.read.parquet(sink)
    assert got.count() == events.count()
    batch = zscore_scorer(stats)(T.readings(spark, SF_SMALL))
    assert got.select("reading_id", "prediction").exceptAll(batch.select("reading_id", "prediction")).count() == 0
