"""wattlane: Spark-native analytics for panels of meter-style time series.

Every operator is a function DataFrame -> DataFrame built from the
DataFrame API, so Catalyst plans it and the work runs on the executors.
"""

from wattlane.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
