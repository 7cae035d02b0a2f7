import pytest

from wattlane.session import scratch_path
from wattlane.sources import files as FS
from wattlane.sources import tables as T
from tests.conftest import SF_SMALL


def test_required_source_missing_raises(spark):
    with pytest.raises(FS.SourceMissing):
        FS.require(spark, {"events": f"{SF_SMALL}/events.parquet", "nope": f"{SF_SMALL}/nope.parquet"})


def test_source_status_reports_missing(spark):
    st = {r.source: r for r in FS.source_status(
        spark, {"events": f"{SF_SMALL}/events.parquet", "nope": f"{SF_SMALL}/nope.parquet"}).collect()}
    assert st["events"].present and st["events"].n_rows == 1000
    assert not st["nope"].present and st["nope"].n_rows is None and "missing" in st["nope"].message


def test_csv_roundtrip_keeps_microseconds_and_nulls(spark):
    r = T.readings_hourly(spark, SF_SMALL).limit(50)
    path = scratch_path(spark, "csv-test")
    FS.write_csv(r, path)
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampNTZType
    back = FS.read_csv(spark, path, StructType([StructField("building_id", LongType()),
                                                StructField("timestamp", TimestampNTZType()),
                                                StructField("meter_reading", DoubleType())]))
    assert sorted(back.collect()) == sorted(r.collect())
