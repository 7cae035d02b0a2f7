"""Composite pipelines: the reference's public entry points as Spark plans.

Each pipeline is a function of DataFrames returning DataFrames (or a dict
of them); nothing is collected unless the caller asks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.functions.calendar import add_calendar, cyclic
from wattlane.operators import explore as X
from wattlane.operators.quality import building_stats, impute_median, ratio_to_mean
from wattlane.operators.windows import lag_rolling
from wattlane.session import materialize


def preprocess_script(df: DataFrame, value: str = "meter_reading", key: str = "building_id",
                      ts: str = "timestamp", stats_rows: Column | None = None) -> DataFrame:
    """Script variant: calendar parts incl. minute, month/hour cycles,
    median imputation, per-building stats joined back, consumption ratio.
    ``stats_rows`` restricts the rows that the building stats are taken
    from (the training part, say)."""
    # the imputation moves and writes rows, so what follows from them is added later
    out = add_calendar(impute_median(df, value, key), ts, minute=True, day_cycle=False)
    stats = building_stats(out if stats_rows is None else out.where(stats_rows), value, key, "building_")
    out = out.join(stats, [key], "left")   # small side: AQE broadcasts by measured size
    return out.withColumn("consumption_ratio", ratio_to_mean(F.col(value), F.col("building_mean")))


def preprocess_dashboard(df: DataFrame, value: str = "meter_reading", key: str = "building_id",
                         ts: str = "timestamp") -> DataFrame:
    """Dashboard variant: calendar parts, month/hour/weekday cycles, median imputation."""
    return add_calendar(impute_median(df, value, key), ts, minute=False, day_cycle=True)


def additional_features(df: DataFrame, value: str = "meter_reading", key: str = "building_id",
                        ts: str = "timestamp", tiebreak: str = "reading_id") -> DataFrame:
    """hour, day_of_week, month, is_weekend, hour/day cycles, lag 1 / 24 and
    24-row rolling mean / std per building (row semantics)."""
    t = F.col(ts)
    out = df.withColumns({"hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t),
                          "is_weekend": (F.weekday(t) >= 5).cast("int")})
    hs, hc = cyclic(F.col("hour"), 24)
    ds, dc = cyclic(F.col("day_of_week"), 7)
    out = out.withColumns({"hour_sin": hs, "hour_cos": hc, "day_sin": ds, "day_cos": dc})
    return lag_rolling(out, [key], [ts, tiebreak], value, (1, 24), 24, value)


def time_features(df: DataFrame, value: str, order: Sequence[str] = ("timestamp",),
                  keys: Sequence[str] = (), prefix: str = "energy") -> DataFrame:
    """Minute cycle, lag 1 / 24, rolling mean / std and ratio to the rolling
    mean. ``order[0]`` is the timestamp. ``keys=()`` treats the table as one
    series; the positions are still computed without a single-partition
    window."""
    ms, mc = cyclic(F.minute(order[0]), 60)
    out = df.withColumns({"minute_sin": ms, "minute_cos": mc})
    return lag_rolling(out, keys, list(order), value, (1, 24), 24, prefix, ratio=True)


def flagship(spark, sf_dir: str) -> DataFrame:
    """Readings -> calendar features -> median imputation -> 24-row lag and
    rolling features per building -> IQR outlier flags and caps -> per
    (building, hour): rows, outliers, sum of capped readings, and the
    24-row rolling sums in whole cents (exact integers, so both engines
    agree to the last digit) with the number of full windows."""
    from wattlane.operators.quality import cap_outliers
    from wattlane.sources.tables import readings

    from wattlane.operators.quality import group_null_stats

    r = readings(spark, sf_dir)
    # one small pass serves the imputation and the per-building routing
    st = group_null_stats(r, "meter_reading", "building_id")
    biggest = st["n"] if st is not None else 0
    f = add_calendar(r, minute=False)
    f = impute_median(f, "meter_reading", "building_id", stats=st)
    f = materialize(lag_rolling(f, ["building_id"], ["timestamp", "reading_id"], "meter_reading", (1, 24), 24,
                                max_group=biggest), "flagship-features")
    f = cap_outliers(f, ["meter_reading"], "iqr", 1.5, flag_suffix="_outlier")
    return f.groupBy("building_id", "hour").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("meter_reading_outlier").cast("long").alias("outliers"),
        F.sum("meter_reading").alias("sum_capped_reading"),
        F.sum(F.round(F.col("meter_reading_rolling_mean_24") * 2400).cast("long")).alias("rolling_sum_cents"),
        F.count("meter_reading_rolling_mean_24").alias("full_windows"))


EXCLUDE = ("anomaly", "timestamp", "building_id", "reading_id", "is_validation")


def supervised_frame(spark, sf_dir: str, fill: str = "mean"):
    """Script-variant features of the labelled panel, NULLs filled with the
    training part's column mean (``fill='mean'``) or 0 (``'zero'``), and the
    stratified 80/20 split. The label (``anomaly``) is the error event, which
    is no function of the features; building stats come from training rows
    only. Returns (frame with is_validation, feature names)."""
    from wattlane.operators.quality import fill_mean, fill_zero
    from wattlane.operators.split import stratified_split
    from wattlane.sources.tables import labelled

    r = labelled(spark, sf_dir).drop("event_type").withColumnRenamed("label", "anomaly")
    train = F.col("is_validation") == 0
    f = preprocess_script(stratified_split(r, "anomaly", "reading_id", 0.2, 42), stats_rows=train)
    feats = X.numeric_columns(f, EXCLUDE)
    f = fill_mean(f, feats, stats_from=f.where(train)) if fill == "mean" else fill_zero(f, feats)
    # Written once: the model fit makes many passes over it.
    return materialize(f, "supervised"), feats


DETECTOR_FEATURES = ("meter_reading", "hour_sin", "hour_cos", "day_sin", "day_cos", "is_weekend",
                     "meter_reading_lag_1", "meter_reading_lag_24", "meter_reading_rolling_mean_24",
                     "meter_reading_rolling_std_24")


def planted(spark, sf_dir: str) -> DataFrame:
    """Labelled readings with planted truth: where two or more error events
    of a building follow each other, the readings they cover are multiplied
    by four, and ``label`` marks the rows so covered."""
    from wattlane.operators.load import overlay_intervals, run_events
    from wattlane.operators.ordering import with_positions
    from wattlane.sources.tables import labelled

    pos = with_positions(labelled(spark, sf_dir), ["building_id"], ["timestamp", "reading_id"], "pos")
    runs = run_events(pos, "building_id", "pos", F.col("label") == 1, "meter_reading")
    ev = runs.where("length > 1").withColumns({"op": F.lit("multiply"), "factor": F.lit(4.0)})
    return overlay_intervals(pos, ev).withColumn("label", F.col("flag")).drop("pos", "flag")


def detector_frame(spark, sf_dir: str, rows: DataFrame | None = None):
    """Panel for judging detectors: lag / rolling features of the readings,
    chronological 80/20 split, standardised with the training part's
    statistics (population std). The label is the error event, of which no
    feature is derived, unless labelled ``rows`` are given. Returns
    (train_normal, test, feature names)."""
    from wattlane.operators.quality import Scaler, fill_zero
    from wattlane.operators.windows import chronological_split
    from wattlane.sources.tables import labelled

    cols = list(DETECTOR_FEATURES)
    feats = fill_zero(additional_features(labelled(spark, sf_dir) if rows is None else rows), cols)
    sp = materialize(chronological_split(feats, ["timestamp", "building_id", "reading_id"], 0.2, "is_test"), "detector-split")
    train = sp.where("is_test = 0")
    z = Scaler.fit(train, cols).transform(sp)
    return z.where("is_test = 0 AND label = 0"), z.where("is_test = 1"), cols
