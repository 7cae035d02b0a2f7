"""Profiles, group statistics, histograms, box stats, correlations,
quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlane.functions import calendar as C
from wattlane.operators import explore as X
from wattlane.operators.ordering import one_row, quantiles
from wattlane.operators.quality import building_stats
from wattlane.plans.catalog import SC, SH, R, register
from wattlane.plans.q_relational import HOURLY, _season_sql
from wattlane.sources import tables as T


@register("A1_row_column_count", R + "SELECT count(*) AS n_rows, 5 AS n_columns FROM readings")
def a1(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    return r.select(F.count(F.lit(1)).alias("n_rows"), F.lit(len(r.columns)).alias("n_columns"))


@register("A2_distinct_keys", R + "SELECT count(DISTINCT building_id) AS buildings FROM readings")
def a2(spark, sf_dir):
    return T.readings(spark, sf_dir).select(F.count_distinct("building_id").alias("buildings"))


@register("A3_dataset_summary", R + """
SELECT count(*) AS total_records, 5 AS features, count(DISTINCT building_id) AS buildings,
       CAST(sum(anomaly) AS BIGINT) AS anomalies, avg(anomaly) * 100 AS anomaly_rate,
       CAST(min("timestamp") AS DATE) AS first_day, CAST(max("timestamp") AS DATE) AS last_day,
       CAST(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 86400000000) AS BIGINT) AS span_days,
       CAST(count(*) * 5 - count(reading_id) - count(building_id) - count("timestamp") - count(meter_reading)
            - count(anomaly) AS BIGINT) AS missing_values
FROM readings""")
def a3(spark, sf_dir):
    return X.dataset_summary(T.readings(spark, sf_dir))


@register("A4_obs_per_building", R + """
SELECT CAST(floor(count(*) / nullif(count(DISTINCT building_id), 0)) AS BIGINT) AS obs_per_building FROM readings""")
def a4(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    return r.select(F.floor(F.try_divide(F.count(F.lit(1)), F.count_distinct("building_id")))
                    .cast("long").alias("obs_per_building"))


_HCOLS = ["building_id", "timestamp", "meter_reading"]


@register("A5_null_counts", HOURLY + """
SELECT 0 AS ordinal, 'building_id' AS column_name, count(*) - count(building_id) AS null_count FROM readings_hourly
UNION ALL SELECT 1, 'timestamp', count(*) - count("timestamp") FROM readings_hourly
UNION ALL SELECT 2, 'meter_reading', count(*) - count(meter_reading) FROM readings_hourly""")
def a5(spark, sf_dir):
    return X.null_counts(T.readings_hourly(spark, sf_dir, stage=False))


@register("A6_column_profile", HOURLY + """
, n AS (SELECT count(*) AS n FROM readings_hourly),
p AS (SELECT 0 AS ordinal, 'building_id' AS column_name, 'bigint' AS data_type,
             count(DISTINCT building_id) AS distinct_values, count(*) - count(building_id) AS null_values FROM readings_hourly
      UNION ALL SELECT 1, 'timestamp', 'timestamp_ntz', count(DISTINCT "timestamp"), count(*) - count("timestamp") FROM readings_hourly
      UNION ALL SELECT 2, 'meter_reading', 'double', count(DISTINCT meter_reading), count(*) - count(meter_reading) FROM readings_hourly)
SELECT p.*, printf('%.1f', round_even((n - null_values) * 100.0 / n, 1)) || '%' AS completeness FROM p, n""")
def a6(spark, sf_dir):
    return X.column_profile(T.readings_hourly(spark, sf_dir))


@register("A7_value_counts_share", R + """
SELECT anomaly, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM readings) AS share_pct
FROM readings GROUP BY 1""")
def a7(spark, sf_dir):
    return X.value_counts(T.readings(spark, sf_dir), "anomaly")


@register("A8_building_stats", R + """
SELECT building_id, avg(meter_reading) AS building_mean, stddev_samp(meter_reading) AS building_std,
       min(meter_reading) AS building_min, max(meter_reading) AS building_max,
       median(meter_reading) AS building_median FROM readings GROUP BY 1""")
def a8(spark, sf_dir):
    return building_stats(T.readings(spark, sf_dir))


@register("A9_rounded_agg_dict", R + """
SELECT building_id, round_even(avg(meter_reading), 2) AS reading_mean, round_even(stddev_samp(meter_reading), 2) AS reading_std,
       round_even(min(meter_reading), 2) AS reading_min, round_even(max(meter_reading), 2) AS reading_max,
       CAST(sum(anomaly) AS BIGINT) AS anomaly_sum FROM readings GROUP BY 1""")
def a9(spark, sf_dir):
    g = T.readings(spark, sf_dir).groupBy("building_id").agg(
        F.avg("meter_reading").alias("m"), F.stddev_samp("meter_reading").alias("s"),
        F.min("meter_reading").alias("lo"), F.max("meter_reading").alias("hi"),
        F.sum("anomaly").cast("long").alias("anomaly_sum"))
    return g.select("building_id", *[F.bround(c, 2).alias(n) for c, n in
                                     (("m", "reading_mean"), ("s", "reading_std"), ("lo", "reading_min"),
                                      ("hi", "reading_max"))], "anomaly_sum")


@register("A10_mean_by_month", SH + 'SELECT CAST(month("timestamp") AS INTEGER) AS month, avg(value) AS mean FROM shipments GROUP BY 1')
def a10(spark, sf_dir):
    return X.group_stats(T.shipments(spark, sf_dir).withColumn("month", F.month("timestamp")), "month", "value")


@register("A11_mean_by_hour", R + 'SELECT CAST(hour("timestamp") AS INTEGER) AS hour, avg(meter_reading) AS mean FROM readings GROUP BY 1')
def a11(spark, sf_dir):
    return X.group_stats(T.readings(spark, sf_dir).withColumn("hour", F.hour("timestamp")), "hour", "meter_reading")


@register("A12_mean_by_weekday", R + 'SELECT CAST(isodow("timestamp") - 1 AS INTEGER) AS dayofweek, avg(meter_reading) AS mean FROM readings GROUP BY 1')
def a12(spark, sf_dir):
    return X.group_stats(T.readings(spark, sf_dir).withColumn("dayofweek", F.weekday("timestamp")),
                         "dayofweek", "meter_reading")


_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


@register("A13_mean_by_day_name", R + f"""
, d AS (SELECT CAST(i AS INTEGER) AS dow FROM range(7) t(i)),
m AS (SELECT CAST(isodow("timestamp") - 1 AS INTEGER) AS dow, avg(meter_reading) AS mean FROM readings GROUP BY 1)
SELECT d.dow, ['{"', '".join(_DAYS)}'][d.dow + 1] AS day_name,
       left(['{"', '".join(_DAYS)}'][d.dow + 1], 3) AS day_abbr, m.mean FROM d LEFT JOIN m USING (dow)""")
def a13(spark, sf_dir):
    return X.weekday_means(T.readings(spark, sf_dir), "meter_reading")


@register("A14_anomaly_rate_by_hour", R + 'SELECT CAST(hour("timestamp") AS INTEGER) AS hour, avg(anomaly) AS anomaly_rate FROM readings GROUP BY 1')
def a14(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    return r.groupBy(F.hour("timestamp").alias("hour")).agg(F.avg("anomaly").alias("anomaly_rate"))


_SEASON = _season_sql('month("timestamp")', C.SEASONS_EN)


@register("A15_seasonal_stats", SH + f"""
SELECT {_SEASON} AS season, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS median
FROM shipments GROUP BY 1""")
def a15(spark, sf_dir):
    s = T.shipments(spark, sf_dir).withColumn("season", C.season(F.month("timestamp")))
    m = X.group_stats(s, "season", "value", ("mean", "std"))
    return m.join(quantiles(s, "value", [0.5], ["season"], ["median"]), "season", "left")


@register("A16_seasonal_anomaly_rate", f"""
SELECT {_season_sql('month(l_shipdate)', C.SEASONS_EN)} AS season,
       CAST(sum(CAST(l_returnflag = 'R' AS INTEGER)) AS BIGINT) AS anomalies, count(*) AS n,
       avg(CAST(l_returnflag = 'R' AS INTEGER)) * 100 AS anomaly_rate_pct
FROM lineitem GROUP BY 1""")
def a16(spark, sf_dir):
    """Returned lines (flag 'R') as the anomaly label over the seasons."""
    li = T.table(spark, sf_dir, "lineitem")
    flag = (F.col("l_returnflag") == "R").cast("int")
    return (li.groupBy(C.season(F.month("l_shipdate")).alias("season"))
            .agg(F.sum(flag).cast("long").alias("anomalies"), F.count(F.lit(1)).alias("n"),
                 (F.avg(flag) * 100).alias("anomaly_rate_pct")))


@register("A17_daily_anomaly_count", R + """
SELECT CAST("timestamp" AS DATE) AS date, count(*) AS anomalies FROM readings WHERE anomaly = 1 GROUP BY 1""")
def a17(spark, sf_dir):
    return X.daily_counts(T.readings(spark, sf_dir))


@register("A18_global_stats", R + """
SELECT avg(meter_reading) AS mean, stddev_samp(meter_reading) AS std, median(meter_reading) AS median FROM readings""")
def a18(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    med = one_row(quantiles(r, "meter_reading", [0.5], [], ["median"]))
    return r.select(F.avg("meter_reading").alias("mean"), F.stddev_samp("meter_reading").alias("std"),
                    med["median"].alias("median"))


@register("A19_balance_flag", R + """
SELECT avg(anomaly) AS anomaly_mean, avg(anomaly) BETWEEN 0.01 AND 0.15 AS balanced FROM readings""")
def a19(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    return r.select(F.avg("anomaly").alias("anomaly_mean"), F.avg("anomaly").between(0.01, 0.15).alias("balanced"))


@register("A20_span_whole_days", """
SELECT 'events' AS source, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS span_days FROM events
UNION ALL
SELECT 'lineitem', CAST(floor((epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate))) / 86400000000) AS BIGINT) FROM lineitem""")
def a20(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events").select(F.lit("events").alias("source"),
                                                 X.span_days(F.min("ts"), F.max("ts")).alias("span_days"))
    li = T.table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("source"),
                                                   X.span_days(F.min("l_shipdate"), F.max("l_shipdate")).alias("span_days"))
    return ev.unionByName(li)


def _hist_sql(src: str, col: str, bins: int = 50) -> str:
    return f"""
, b AS (SELECT min({col}) AS mn, max({col}) AS mx FROM {src}),
c AS (SELECT CASE WHEN mx = mn THEN 0 ELSE least(CAST(floor(({col} - mn) / ((mx - mn) / {float(bins)})) AS INTEGER), {bins - 1}) END AS bin,
             count(*) AS count FROM {src}, b WHERE {col} IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(i AS INTEGER) AS bin FROM range({bins}) t(i))
SELECT g.bin, mn + g.bin * ((mx - mn) / {float(bins)}) AS bin_lo, mn + (g.bin + 1) * ((mx - mn) / {float(bins)}) AS bin_hi,
       CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM g LEFT JOIN c USING (bin), b"""


@register("A21_histogram_50", R + _hist_sql("readings", "meter_reading"))
def a21(spark, sf_dir):
    return X.histogram(T.readings(spark, sf_dir), "meter_reading", 50)


@register("A22_score_histogram", R + """
, z AS (SELECT abs((meter_reading - (SELECT avg(meter_reading) FROM readings))
                   / (SELECT stddev_samp(meter_reading) FROM readings)) AS score FROM readings)""" + _hist_sql("z", "score"))
def a22(spark, sf_dir):
    """Histogram of a z-score detector's scores."""
    from wattlane.functions.scalar import abs_zscore
    r = T.readings(spark, sf_dir)
    st = one_row(r.select(F.avg("meter_reading").alias("m"), F.stddev_samp("meter_reading").alias("s")))
    return X.histogram(r.select(abs_zscore("meter_reading", st["m"], st["s"]).alias("score")), "score", 50)


@register("A23_box_stats_by_label", R + """
, q AS (SELECT anomaly, quantile_cont(meter_reading, 0.25) AS q1, quantile_cont(meter_reading, 0.5) AS median,
               quantile_cont(meter_reading, 0.75) AS q3 FROM readings WHERE meter_reading IS NOT NULL GROUP BY 1)
SELECT r.anomaly, q.q1, q.median, q.q3,
       min(CASE WHEN meter_reading >= q1 - 1.5 * (q3 - q1) THEN meter_reading END) AS whisker_lo,
       max(CASE WHEN meter_reading <= q3 + 1.5 * (q3 - q1) THEN meter_reading END) AS whisker_hi,
       count(*) FILTER (WHERE meter_reading < q1 - 1.5 * (q3 - q1) OR meter_reading > q3 + 1.5 * (q3 - q1)) AS outliers,
       count(*) AS n
FROM readings r JOIN q USING (anomaly) WHERE meter_reading IS NOT NULL GROUP BY 1, 2, 3, 4""")
def a23(spark, sf_dir):
    return X.box_stats(T.readings(spark, sf_dir), "meter_reading", ["anomaly"])


_CORR_COLS = ["meter_reading", "hour", "dayofweek", "is_weekend", "building_id", "year"]


def _corr_frame(spark, sf_dir):
    h = T.readings_hourly(spark, sf_dir)
    return h.withColumns({"hour": F.hour("timestamp"), "dayofweek": F.weekday("timestamp"),
                          "is_weekend": C.is_weekend("timestamp"), "year": F.year("timestamp")})


def _corr_sql(lower_only: bool) -> str:
    exprs = {"meter_reading": "meter_reading", "hour": 'hour("timestamp")', "dayofweek": 'isodow("timestamp") - 1',
             "is_weekend": 'CAST(isodow("timestamp") - 1 >= 5 AS INTEGER)', "building_id": "building_id",
             "year": 'year("timestamp")'}
    cols = _CORR_COLS
    parts = []
    for i in range(len(cols)):
        for j in range(len(cols)):
            if lower_only and not i > j:
                continue
            x, y = f"CAST({cols[i]} AS DOUBLE)", f"CAST({cols[j]} AS DOUBLE)"
            parts.append(f"SELECT {i} AS i, {j} AS j, '{cols[i]}' AS col_i, '{cols[j]}' AS col_j, "
                         f"CASE WHEN isnan(corr({x}, {y})) THEN NULL ELSE corr({x}, {y}) END AS corr FROM f")
    sel = ", ".join(f"{e} AS {c}" for c, e in exprs.items())
    return HOURLY + f", f AS (SELECT {sel} FROM readings_hourly)\n" + "\nUNION ALL ".join(parts)


@register("A24_correlation_matrix", _corr_sql(False))
def a24(spark, sf_dir):
    """Pairwise-complete Pearson matrix over a frame with NULLs and a
    constant column (year): constant pairs are NULL, not an error."""
    return X.correlation_matrix(_corr_frame(spark, sf_dir), _CORR_COLS)


@register("A25_correlation_lower_triangle", _corr_sql(True))
def a25(spark, sf_dir):
    return X.correlation_matrix(_corr_frame(spark, sf_dir), _CORR_COLS, lower_only=True)


@register("A26_exact_quantiles", R + """
SELECT quantile_cont(meter_reading, 0.05) AS q05, quantile_cont(meter_reading, 0.25) AS q25,
       quantile_cont(meter_reading, 0.75) AS q75, quantile_cont(meter_reading, 0.95) AS q95 FROM readings""")
def a26(spark, sf_dir):
    return quantiles(T.readings(spark, sf_dir), "meter_reading", [0.05, 0.25, 0.75, 0.95])


@register("A26_exact_quantiles_by_building", R + """
SELECT building_id, quantile_cont(meter_reading, 0.05) AS q05, quantile_cont(meter_reading, 0.25) AS q25,
       quantile_cont(meter_reading, 0.75) AS q75, quantile_cont(meter_reading, 0.95) AS q95 FROM readings GROUP BY 1""")
def a26b(spark, sf_dir):
    return quantiles(T.readings(spark, sf_dir), "meter_reading", [0.05, 0.25, 0.75, 0.95], ["building_id"])


@register("A27_score_threshold_p95", SC + """
SELECT quantile_cont(score, 0.95) AS threshold,
       count(*) FILTER (WHERE score > (SELECT quantile_cont(score, 0.95) FROM scored)) AS above FROM scored""")
def a27(spark, sf_dir):
    s = T.scored(spark, sf_dir)
    thr = one_row(quantiles(s, "score", [0.95], [], ["p95"]))["p95"]
    flagged = s.select(thr.alias("t"), (F.col("score") > thr).alias("a"))
    return flagged.select(F.max("t").alias("threshold"), F.count_if("a").alias("above"))
