"""P*, F*, J*, W*, L*, U1, D*: projections, scalar functions, joins,
windows, sorts/samples, unions and data-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlane.functions import calendar as C
from wattlane.functions import scalar as S
from wattlane.operators import load as LD
from wattlane.operators import quality as QY
from wattlane.operators import windows as WN
from wattlane.operators.explore import bounded_sample, numeric_columns, preview, weekday_means
from wattlane.operators.ordering import median, one_row, quantiles
from wattlane.operators.split import group_fraction_sample, stratified_split
from wattlane.plans.catalog import LB, SC, SH, TWO_PI, R, cal_sql, register
from wattlane.plans.pipelines import additional_features, time_features
from wattlane.sources import tables as T

PI2 = repr(TWO_PI)


def _cal(spark, sf_dir):
    return C.add_calendar(T.readings(spark, sf_dir), minute=True)


CAL = R + f", cal AS (SELECT *, {cal_sql(minute=True)} FROM readings)\n"


# ---------------------------------------------------------------- P: projections
@register("P1_column_subset", R + 'SELECT building_id, "timestamp", meter_reading, anomaly FROM readings')
def p1(spark, sf_dir):
    return T.readings(spark, sf_dir).select("building_id", "timestamp", "meter_reading", "anomaly")


_NUM = ["reading_id", "building_id", "meter_reading", "anomaly", "year", "month", "day", "hour",
        "minute", "dayofweek", "is_weekend", "month_sin", "month_cos", "hour_sin", "hour_cos",
        "day_sin", "day_cos"]


@register("P2_numeric_columns", CAL + f"SELECT {', '.join(_NUM)} FROM cal")
def p2(spark, sf_dir):
    df = _cal(spark, sf_dir)
    return df.select(*numeric_columns(df))


@register("P3_exclude_columns", CAL + 'SELECT * EXCLUDE (anomaly, "timestamp", building_id) FROM cal')
def p3(spark, sf_dir):
    return _cal(spark, sf_dir).drop("anomaly", "timestamp", "building_id")


@register("P4_new_cyclic_columns", CAL + "SELECT reading_id, month_sin, month_cos, hour_sin, hour_cos, "
                                          "day_sin, day_cos FROM cal")
def p4(spark, sf_dir):
    base = T.readings(spark, sf_dir)
    df = C.add_calendar(base, minute=True)
    new = [c for c in df.columns if c not in base.columns]
    cyc = [c for c in new if "sin" in c or "cos" in c]
    return df.select("reading_id", *cyc)


@register("P5_anomalous_rows", R + "SELECT * FROM readings WHERE anomaly = 1")
def p5(spark, sf_dir):
    return T.readings(spark, sf_dir).where(F.col("anomaly") == 1)


@register("P6_normal_rows", R + "SELECT * FROM readings WHERE anomaly = 0")
def p6(spark, sf_dir):
    return T.readings(spark, sf_dir).where("anomaly = 0")


@register("P7_outside_range", R + "SELECT * FROM readings WHERE meter_reading < 1.0 OR meter_reading > 300.0")
def p7(spark, sf_dir):
    x = F.col("meter_reading")
    return T.readings(spark, sf_dir).where((x < 1.0) | (x > 300.0))


@register("P8_masked_update", R + "SELECT reading_id, CASE WHEN meter_reading > 300.0 THEN 300.0 "
                                  "ELSE meter_reading END AS meter_reading FROM readings")
def p8(spark, sf_dir):
    x = F.col("meter_reading")
    return T.readings(spark, sf_dir).select(
        "reading_id", F.when(x > 300.0, F.lit(300.0)).otherwise(x).alias("meter_reading"))


@register("P9_month_in_list", SH + """
SELECT CAST(year("timestamp") AS INTEGER) AS year, count(*) AS winter_rows FROM shipments
WHERE month("timestamp") IN (12, 1, 2) GROUP BY 1""")
def p9(spark, sf_dir):
    s = T.shipments(spark, sf_dir)
    return (s.where(F.month("timestamp").isin(12, 1, 2)).groupBy(F.year("timestamp").alias("year"))
            .agg(F.count(F.lit(1)).alias("winter_rows")))


@register("P10_prefixed_aggregates", R + """
SELECT building_id, avg(meter_reading) AS building_mean, max(meter_reading) AS building_max
FROM readings GROUP BY 1""")
def p10(spark, sf_dir):
    return (T.readings(spark, sf_dir).groupBy("building_id")
            .agg(*[fn("meter_reading").alias(f"building_{n}") for n, fn in (("mean", F.avg), ("max", F.max))]))


@register("P11_bool_int_casts", R + """
SELECT reading_id, CAST(isodow("timestamp") - 1 >= 5 AS INTEGER) AS is_weekend,
       CAST(anomaly AS BOOLEAN) AS anomaly_flag FROM readings""")
def p11(spark, sf_dir):
    return T.readings(spark, sf_dir).select(
        "reading_id", (F.weekday("timestamp") >= 5).cast("int").alias("is_weekend"),
        F.col("anomaly").cast("boolean").alias("anomaly_flag"))


@register("P12_round_half_even", R + "SELECT reading_id, round_even(meter_reading / 3.0, 2) AS third FROM readings")
def p12(spark, sf_dir):
    return T.readings(spark, sf_dir).select("reading_id", F.bround(F.col("meter_reading") / 3.0, 2).alias("third"))


@register("P13_predicted_positive_rows", SC + """
SELECT reading_id, "timestamp", score FROM scored
WHERE score > (SELECT quantile_cont(score, 0.95) FROM scored)""")
def p13(spark, sf_dir):
    s = T.scored(spark, sf_dir)
    thr = one_row(quantiles(s, "score", [0.95], [], ["p95"]))["p95"]
    return s.where(F.col("score") > thr).select("reading_id", "timestamp", "score")


# ---------------------------------------------------------------- F: scalar functions
@register("F1_calendar_parts", R + """
SELECT reading_id, CAST(year("timestamp") AS INTEGER) AS year, CAST(month("timestamp") AS INTEGER) AS month,
       CAST(day("timestamp") AS INTEGER) AS day, CAST(hour("timestamp") AS INTEGER) AS hour,
       CAST(minute("timestamp") AS INTEGER) AS minute FROM readings""")
def f1(spark, sf_dir):
    t = F.col("timestamp")
    return T.readings(spark, sf_dir).select("reading_id", F.year(t).alias("year"), F.month(t).alias("month"),
                                            F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"),
                                            F.minute(t).alias("minute"))


_SHIP_KEY = "l_orderkey, l_linenumber"


@register("F2_weekday_monday0", SH + f'SELECT {_SHIP_KEY}, CAST(isodow("timestamp") - 1 AS INTEGER) AS dow FROM shipments')
def f2(spark, sf_dir):
    return T.shipments(spark, sf_dir).select("l_orderkey", "l_linenumber", C.day_of_week("timestamp").alias("dow"))


@register("F3_day_of_year", SH + f'SELECT {_SHIP_KEY}, CAST(dayofyear("timestamp") AS INTEGER) AS doy FROM shipments')
def f3(spark, sf_dir):
    return T.shipments(spark, sf_dir).select("l_orderkey", "l_linenumber", F.dayofyear("timestamp").alias("doy"))


@register("F4_weekend_flag", SH + f'SELECT {_SHIP_KEY}, CAST(isodow("timestamp") - 1 >= 5 AS INTEGER) AS is_weekend FROM shipments')
def f4(spark, sf_dir):
    return T.shipments(spark, sf_dir).select("l_orderkey", "l_linenumber", C.is_weekend("timestamp").alias("is_weekend"))


@register("F5_day_name", SH + f'SELECT {_SHIP_KEY}, dayname("timestamp") AS day_name FROM shipments')
def f5(spark, sf_dir):
    return T.shipments(spark, sf_dir).select("l_orderkey", "l_linenumber", C.day_name("timestamp").alias("day_name"))


def _season_sql(m: str, names: dict) -> str:
    return "CASE " + " ".join(f"WHEN {m} IN ({', '.join(map(str, ms))}) THEN '{n}'" for n, ms in names.items()) + " END"


@register("F6_season_labels", SH + f"""
SELECT {_SHIP_KEY}, {_season_sql('month("timestamp")', C.SEASONS_EN)} AS season,
       {_season_sql('month("timestamp")', C.SEASONS_FR)} AS saison FROM shipments""")
def f6(spark, sf_dir):
    m = F.month("timestamp")
    return T.shipments(spark, sf_dir).select("l_orderkey", "l_linenumber", C.season(m, C.SEASONS_EN).alias("season"),
                                             C.season(m, C.SEASONS_FR).alias("saison"))


@register("F7_cyclic_month", SH + f"""
SELECT {_SHIP_KEY}, sin({PI2} * month("timestamp") / 12.0) AS month_sin,
       cos({PI2} * month("timestamp") / 12.0) AS month_cos FROM shipments""")
def f7(spark, sf_dir):
    s, c = C.cyclic(F.month("timestamp"), 12)
    return T.shipments(spark, sf_dir).select("l_orderkey", "l_linenumber", s.alias("month_sin"), c.alias("month_cos"))


@register("F8_cyclic_hour", R + f"""
SELECT reading_id, sin({PI2} * hour("timestamp") / 24.0) AS hour_sin,
       cos({PI2} * hour("timestamp") / 24.0) AS hour_cos FROM readings""")
def f8(spark, sf_dir):
    s, c = C.cyclic(F.hour("timestamp"), 24)
    return T.readings(spark, sf_dir).select("reading_id", s.alias("hour_sin"), c.alias("hour_cos"))


@register("F9_cyclic_weekday", R + f"""
SELECT reading_id, sin({PI2} * (isodow("timestamp") - 1) / 7.0) AS day_sin,
       cos({PI2} * (isodow("timestamp") - 1) / 7.0) AS day_cos FROM readings""")
def f9(spark, sf_dir):
    s, c = C.cyclic(F.weekday("timestamp"), 7)
    return T.readings(spark, sf_dir).select("reading_id", s.alias("day_sin"), c.alias("day_cos"))


@register("F10_cyclic_minute", R + f"""
SELECT reading_id, sin({PI2} * minute("timestamp") / 60.0) AS minute_sin,
       cos({PI2} * minute("timestamp") / 60.0) AS minute_cos FROM readings""")
def f10(spark, sf_dir):
    s, c = C.cyclic(F.minute("timestamp"), 60)
    return T.readings(spark, sf_dir).select("reading_id", s.alias("minute_sin"), c.alias("minute_cos"))


_RATIO_SQL = """CASE WHEN m.building_mean = 0 AND r.meter_reading <> 0
     THEN CASE WHEN r.meter_reading > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END
     ELSE coalesce(r.meter_reading / nullif(m.building_mean, 0), 1.0) END"""


@register("F11_ratio_to_building_mean", R + f"""
, m AS (SELECT building_id, avg(meter_reading) AS building_mean FROM readings GROUP BY 1)
SELECT r.reading_id, {_RATIO_SQL} AS consumption_ratio
FROM readings r LEFT JOIN m USING (building_id)""")
def f11(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    m = r.groupBy("building_id").agg(F.avg("meter_reading").alias("building_mean"))
    return (r.join(m, "building_id", "left")
            .select("reading_id", QY.ratio_to_mean(F.col("meter_reading"), F.col("building_mean"))
                    .alias("consumption_ratio")))


HOURLY = f"WITH {T.SQL_READINGS_HOURLY}\n"


@register("F12_null_to_zero", HOURLY + 'SELECT building_id, "timestamp", coalesce(meter_reading, 0.0) AS meter_reading FROM readings_hourly')
def f12(spark, sf_dir):
    return QY.fill_zero(T.readings_hourly(spark, sf_dir, stage=False), ["meter_reading"])


@register("F13_null_to_mean", HOURLY + """
SELECT building_id, "timestamp", coalesce(meter_reading, avg(meter_reading) OVER ()) AS meter_reading FROM readings_hourly""")
def f13(spark, sf_dir):
    return QY.fill_mean(T.readings_hourly(spark, sf_dir, stage=False), ["meter_reading"])


def _temp_sql(t: str, cool: float, heat: float) -> str:
    return (f"CASE WHEN {t} > 22 THEN ({t} - 22) * {cool} WHEN {t} < 18 THEN (18 - {t}) * {heat} "
            f"ELSE 0.0 END")


@register("F14_temperature_effect", f"""
SELECT l_orderkey, l_linenumber, l_quantity - 10.0 AS temperature,
       {_temp_sql('(l_quantity - 10.0)', *LD.PANEL_TEMP_SLOPES)} AS temp_effect_panel,
       {_temp_sql('(l_quantity - 10.0)', *LD.SERIES_TEMP_SLOPES)} AS temp_effect_series
FROM lineitem""")
def f14(spark, sf_dir):
    """Temperature proxy l_quantity - 10 (-9..40) exercises both slopes and the dead band."""
    li = T.table(spark, sf_dir, "lineitem")
    t = (F.col("l_quantity") - 10.0)
    return li.select("l_orderkey", "l_linenumber", t.alias("temperature"),
                     LD.temperature_effect(t, LD.PANEL_TEMP_SLOPES).alias("temp_effect_panel"),
                     LD.temperature_effect(t, LD.SERIES_TEMP_SLOPES).alias("temp_effect_series"))


def _case_map(expr: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = '{k}' THEN CAST({float(v)!r} AS DOUBLE)"
                              for k, v in mapping.items()) + " END"


@register("F15_weekend_effect_by_type", LB + """
, w AS (SELECT event_type, avg(meter_reading) FILTER (WHERE isodow("timestamp") >= 6)
               / nullif(avg(meter_reading) FILTER (WHERE isodow("timestamp") < 6), 0) - 1 AS effect FROM labelled GROUP BY 1)
SELECT reading_id, event_type,
       round(CASE WHEN isodow("timestamp") >= 6 THEN effect ELSE 0.0 END, 6) AS weekend_effect
FROM labelled LEFT JOIN w USING (event_type)""")
def f15(spark, sf_dir):
    """Weekend over weekday mean per event type, fitted from the readings."""
    r = LD.weekend_effect(T.labelled(spark, sf_dir), "event_type", "meter_reading")
    return r.select("reading_id", "event_type", F.round("weekend_effect", 6).alias("weekend_effect"))


@register("F16_clip_and_floor", R + """
SELECT reading_id, CASE WHEN meter_reading IS NULL THEN NULL ELSE least(greatest(meter_reading, 20.0), 95.0) END AS clipped,
       CASE WHEN meter_reading IS NULL THEN NULL ELSE greatest(meter_reading, 10.0) END AS floored
FROM readings""")
def f16(spark, sf_dir):
    return T.readings(spark, sf_dir).select("reading_id", S.clip("meter_reading", 20.0, 95.0).alias("clipped"),
                                            S.clip("meter_reading", 10.0).alias("floored"))


@register("F17_abs_zscore", R + """
SELECT reading_id, abs((meter_reading - (SELECT avg(meter_reading) FROM readings))
                       / nullif((SELECT stddev_samp(meter_reading) FROM readings), 0)) AS abs_z
FROM readings""")
def f17(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    st = one_row(r.select(F.avg("meter_reading").alias("m"), F.stddev_samp("meter_reading").alias("s")))
    return r.select("reading_id", S.abs_zscore("meter_reading", st["m"], st["s"]).alias("abs_z"))


@register("F18_detector_label_map", SC + """
SELECT reading_id, CASE WHEN -score < (SELECT quantile_cont(-score, 0.1) FROM scored) THEN 1 ELSE 0 END AS prediction
FROM scored""")
def f18(spark, sf_dir):
    """Decision = -score; anomaly (1) below the 10th percentile offset, else 0."""
    s = T.scored(spark, sf_dir).withColumn("decision", -F.col("score"))
    off = one_row(quantiles(s, "decision", [0.1], [], ["off"]))["off"]
    return s.select("reading_id", S.detector_label("decision", off).alias("prediction"))


@register("F19_calendar_date", R + 'SELECT reading_id, CAST("timestamp" AS DATE) AS date FROM readings')
def f19(spark, sf_dir):
    return T.readings(spark, sf_dir).select("reading_id", F.to_date("timestamp").alias("date"))


@register("F20_title_case", """
SELECT DISTINCT event_type,
       array_to_string(list_transform(string_split(event_type || '_event_rate', '_'),
                       lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title
FROM events""")
def f20(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events").select("event_type").distinct()
    return ev.select("event_type", S.title_case(F.concat("event_type", F.lit("_event_rate"))).alias("title"))


@register("F21_number_text", R + """
SELECT building_id, printf('%.3f', round_even(avg(meter_reading), 3)) AS mean_txt,
       format('{:,}', CAST(round(sum(meter_reading) * 1000) AS BIGINT)) AS total_milli_txt,
       printf('%.1f', round_even(avg(anomaly) * 100, 1)) || '%' AS rate_txt
FROM readings GROUP BY 1""")
def f21(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    g = r.groupBy("building_id").agg(F.avg("meter_reading").alias("m"), F.sum("meter_reading").alias("s"),
                                     (F.avg("anomaly") * 100).alias("rate"))
    return g.select("building_id", S.fixed_text("m", 3).alias("mean_txt"),
                    S.thousands_text(F.round(F.col("s") * 1000).cast("long")).alias("total_milli_txt"),
                    S.percent_text("rate", 1).alias("rate_txt"))


_SEASONS = sorted(C.SEASONS_EN)


@register("F22_one_hot_season", SH + f"""
, s AS (SELECT {_SHIP_KEY}, {_season_sql('month("timestamp")', C.SEASONS_EN)} AS season FROM shipments)
SELECT {_SHIP_KEY}, {', '.join(f"CAST(coalesce(season = '{v}', false) AS INTEGER) AS season_{v}" for v in _SEASONS)}
FROM s""")
def f22(spark, sf_dir):
    s = T.shipments(spark, sf_dir).withColumn("season", C.season(F.month("timestamp")))
    return s.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in S.one_hot("season", _SEASONS, "season").items()])


@register("F23_expected_load_panel", R + """
, r AS (SELECT *, hour("timestamp") AS h FROM readings),
b AS (SELECT building_id, avg(meter_reading) AS bm FROM r GROUP BY 1),
e AS (SELECT building_id, h, avg(meter_reading) AS expected FROM r GROUP BY 1, 2)
SELECT reading_id, round(expected, 6) AS expected_load, round(meter_reading - expected, 6) AS residual,
       round(expected / nullif(bm, 0), 6) AS hourly_factor
FROM r JOIN e USING (building_id, h) JOIN b USING (building_id)""")
def f23(spark, sf_dir):
    """Baseline per building and hour, fitted from the readings, with the
    residual against it and the hour's share of the building's mean."""
    r = T.readings(spark, sf_dir).withColumn("h", F.hour("timestamp"))
    e = LD.fitted_baseline(r, ["building_id", "h"], "meter_reading")
    means = r.groupBy("building_id").agg(F.avg("meter_reading").alias("bm"))
    return e.join(means, "building_id").select(
        "reading_id", F.round("expected_load", 6).alias("expected_load"), F.round("residual", 6).alias("residual"),
        F.round(F.try_divide("expected_load", "bm"), 6).alias("hourly_factor"))


@register("F24_expected_load_series", SH + f"""
, s AS (SELECT l_orderkey, l_linenumber, value, {_season_sql('month("timestamp")', C.SEASONS_FR)} AS season,
               isodow("timestamp") - 1 AS dow FROM shipments),
e AS (SELECT season, dow, avg(value) AS expected FROM s GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, season, round(expected, 4) AS expected_load, round(value - expected, 4) AS residual
FROM s JOIN e USING (season, dow)""")
def f24(spark, sf_dir):
    """Baseline of the single series per season and weekday."""
    s = T.shipments(spark, sf_dir).withColumns({"season": C.season(F.month("timestamp"), C.SEASONS_FR), "dow": F.weekday("timestamp")})
    e = LD.fitted_baseline(s, ["season", "dow"], "value")
    return e.select("l_orderkey", "l_linenumber", "season", F.round("expected_load", 4).alias("expected_load"),
                    F.round("residual", 4).alias("residual"))


@register("F25_hourly_spine", HOURLY + "SELECT * FROM readings_hourly")
def f25(spark, sf_dir):
    return T.readings_hourly(spark, sf_dir, stage=False)


@register("F26_label_text", R + "SELECT reading_id, CASE WHEN anomaly = 0 THEN 'Normal' ELSE 'Anomalie' END AS label_txt FROM readings")
def f26(spark, sf_dir):
    return T.readings(spark, sf_dir).select("reading_id", S.label_text("anomaly").alias("label_txt"))


@register("F27_name_prefix3", SH + f'SELECT {_SHIP_KEY}, left(dayname("timestamp"), 3) AS day_abbr FROM shipments')
def f27(spark, sf_dir):
    return T.shipments(spark, sf_dir).select("l_orderkey", "l_linenumber",
                                             F.left(C.day_name("timestamp"), F.lit(3)).alias("day_abbr"))


@register("F28_sinusoidal_baselines", SH + f"""
, d AS (SELECT {_SHIP_KEY}, value, sin({PI2} / 365.0 * dayofyear("timestamp")) AS s, cos({PI2} / 365.0 * dayofyear("timestamp")) AS c
        FROM shipments),
m AS (SELECT avg(value) AS my, avg(s) AS ms, avg(c) AS mc, var_pop(s) AS ss, var_pop(c) AS cc, covar_pop(s, c) AS sc,
             covar_pop(s, value) AS sy, covar_pop(c, value) AS cy FROM d)
SELECT {_SHIP_KEY}, round(my + (sy * cc - cy * sc) / (ss * cc - sc * sc) * (s - ms)
                          + (cy * ss - sy * sc) / (ss * cc - sc * sc) * (c - mc), 4) AS baseline
FROM d, m""")
def f28(spark, sf_dir):
    """Yearly sinusoidal baseline of the shipped value, by least squares."""
    out = LD.sinusoidal_baseline(T.shipments(spark, sf_dir), F.dayofyear("timestamp"), 365.0, "value")
    return out.select("l_orderkey", "l_linenumber", F.round("baseline", 4).alias("baseline"))


@register("F29_rowwise_mse", """
SELECT vec_id, list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - r[i]) * (e[i] - r[i]))) / len(e) AS mse
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_reverse(CAST(embedding AS DOUBLE[])) AS r FROM embeddings)""")
def f29(spark, sf_dir):
    """Mean squared difference between each vector and its reversal."""
    v = T.vectors(spark, sf_dir)
    return v.select("vec_id", S.mean_squared_diff("embedding", F.reverse("embedding")).alias("mse"))


# ---------------------------------------------------------------- J: joins
@register("J1_building_stats_join", R + """
, s AS (SELECT building_id, avg(meter_reading) AS building_mean, stddev_samp(meter_reading) AS building_std,
               min(meter_reading) AS building_min, max(meter_reading) AS building_max,
               median(meter_reading) AS building_median FROM readings GROUP BY 1)
SELECT r.reading_id, s.* EXCLUDE (building_id) FROM readings r LEFT JOIN s USING (building_id)""")
def j1(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    st = QY.building_stats(r)
    return r.join(st, "building_id", "left").drop("building_id", "timestamp", "meter_reading", "anomaly")


@register("J2_group_median_to_rows", R + """
SELECT reading_id, median(meter_reading) OVER (PARTITION BY building_id) AS building_median FROM readings""")
def j2(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    return r.join(median(r, "meter_reading", ["building_id"], "building_median"), "building_id", "left") \
        .select("reading_id", "building_median")


@register("J3_season_lookup", SH + f"""
, s AS (SELECT {_SHIP_KEY}, {_season_sql('month("timestamp")', C.SEASONS_EN)} AS season FROM shipments)
SELECT {_SHIP_KEY}, season, {_case_map('season', LD.BASE_TEMPERATURE)} AS base_temperature,
       {_case_map('season', LD.SEASONAL_EFFECT)} AS seasonal_effect FROM s""")
def j3(spark, sf_dir):
    s = T.shipments(spark, sf_dir).withColumn("season", C.season(F.month("timestamp")))
    return s.select("l_orderkey", "l_linenumber", "season",
                    LD.lookup(LD.BASE_TEMPERATURE, F.col("season")).alias("base_temperature"),
                    LD.lookup(LD.SEASONAL_EFFECT, F.col("season")).alias("seasonal_effect"))


@register("J4_hour_profile_lookup", R + f"""
SELECT reading_id, CAST([{', '.join(map(str, LD.SERIES_PROFILE))}] AS DOUBLE[])[hour("timestamp") + 1] AS series_factor
FROM readings""")
def j4(spark, sf_dir):
    """Hour of day to its profile factor: a literal array lookup."""
    return T.readings(spark, sf_dir).select("reading_id", LD.profile_at(LD.SERIES_PROFILE, F.hour("timestamp")).alias("series_factor"))


@register("J5_one_hot_bind", SH + f"""
, s AS (SELECT {_SHIP_KEY}, value, {_season_sql('month("timestamp")', C.SEASONS_EN)} AS season FROM shipments)
SELECT {_SHIP_KEY}, value, season,
       {', '.join(f"CAST(coalesce(season = '{v}', false) AS INTEGER) AS season_{v}" for v in _SEASONS)}
FROM s""")
def j5(spark, sf_dir):
    s = T.shipments(spark, sf_dir).withColumn("season", C.season(F.month("timestamp")))
    return s.select("l_orderkey", "l_linenumber", "value", "season").withColumns(S.one_hot("season", _SEASONS, "season"))


_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


@register("J6_weekday_reindex", R + f"""
, d AS (SELECT CAST(i AS INTEGER) AS dow FROM range(7) t(i)),
m AS (SELECT CAST(isodow("timestamp") - 1 AS INTEGER) AS dow, avg(meter_reading) AS mean
      FROM readings WHERE anomaly = 1 GROUP BY 1)
SELECT d.dow, ['{"', '".join(_DAYS)}'][d.dow + 1] AS day_name,
       left(['{"', '".join(_DAYS)}'][d.dow + 1], 3) AS day_abbr, m.mean
FROM d LEFT JOIN m USING (dow)""")
def j6(spark, sf_dir):
    """Weekday means of anomalous rows on the 7-day spine (a day without
    rows keeps a NULL mean)."""
    r = T.readings(spark, sf_dir).where(F.col("anomaly") == 1)
    return weekday_means(r, "meter_reading")


def _j7_sql(closed_extra: int = 0, spans: bool = False) -> str:
    events = "ev"
    more = ""
    if spans:
        events = "ev2"
        more = """
ev2 AS (SELECT building_id, 2 * seq AS seq, start_pos, length, op, factor FROM ev
        UNION ALL SELECT building_id, 1, min(start_pos), max(start_pos + length) - min(start_pos), 'multiply', 1.5 FROM ev GROUP BY 1),"""
    return LB + f"""
, pos AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY "timestamp", reading_id) - 1 AS pos FROM labelled),
mk AS (SELECT building_id, pos, pos - row_number() OVER (PARTITION BY building_id ORDER BY pos) AS g FROM pos WHERE label = 1),
rn AS (SELECT building_id, min(pos) AS start_pos, count(*) AS length FROM mk GROUP BY building_id, g),
ev AS (SELECT r.*, row_number() OVER (PARTITION BY r.building_id ORDER BY start_pos) - 1 AS seq,
              CASE WHEN length = 1 THEN 'multiply' ELSE 'set' END AS op,
              CASE WHEN length = 1 THEN 2.0 ELSE m.mean END AS factor
       FROM rn r JOIN (SELECT building_id, avg(meter_reading) AS mean FROM labelled GROUP BY 1) m USING (building_id)),{more}
cov AS (SELECT building_id, seq, op, factor, unnest(range(start_pos, start_pos + length + {closed_extra})) AS pos FROM {events}),
last_set AS (SELECT building_id, pos, max(seq) FILTER (WHERE op = 'set') AS ls,
                    arg_max(factor, seq) FILTER (WHERE op = 'set') AS set_value FROM cov GROUP BY 1, 2),
agg AS (SELECT c.building_id, c.pos, l.set_value,
               product(CASE WHEN c.op = 'multiply' AND (l.ls IS NULL OR c.seq > l.ls) THEN c.factor ELSE 1.0 END) AS mult
        FROM cov c JOIN last_set l USING (building_id, pos) GROUP BY 1, 2, 3)
SELECT p.reading_id, p.building_id, p.pos,
       round_even(coalesce(a.set_value, p.meter_reading) * coalesce(a.mult, 1.0), 4) AS meter_reading,
       CASE WHEN a.pos IS NULL THEN 0 ELSE 1 END AS flag
FROM pos p LEFT JOIN agg a USING (building_id, pos)"""


def _overlay(spark, sf_dir, closed, spans=False):
    from wattlane.operators.ordering import with_positions
    pos = with_positions(T.labelled(spark, sf_dir), ["building_id"], ["timestamp", "reading_id"], "pos")
    ev = LD.run_events(pos, "building_id", "pos", F.col("label") == 1, "meter_reading")
    ev = LD.with_spans(ev, "building_id") if spans else ev
    out = LD.overlay_intervals(pos, ev, "building_id", "pos", "meter_reading", "flag", closed=closed)
    return out.select("reading_id", "building_id", "pos", F.bround("meter_reading", 4).alias("meter_reading"), "flag")


@register("J7_interval_overlay", _j7_sql(0))
def j7(spark, sf_dir):
    """Interval events taken from the data (runs of error events of a
    building: one row doubles, longer runs set the mean) laid over its
    readings in sequence; flag = covered by any interval."""
    return _overlay(spark, sf_dir, "left")


@register("J7_interval_overlay_closed_both", _j7_sql(1))
def j7b(spark, sf_dir):
    """The same events with end-inclusive intervals."""
    return _overlay(spark, sf_dir, "both")


@register("J7_overlapping_overlay", _j7_sql(0, True))
def j7o(spark, sf_dir):
    """The same events and, between a building's first and second, one that
    scales its whole span: they overlap, and their order decides."""
    return _overlay(spark, sf_dir, "left", True)


@register("J8_aligned_predictions", SC + """
SELECT reading_id AS key, label, CAST(score > (SELECT quantile_cont(score, 0.95) FROM scored) AS INTEGER) AS prediction,
       score FROM scored""")
def j8(spark, sf_dir):
    s = T.scored(spark, sf_dir)
    thr = one_row(quantiles(s, "score", [0.95], [], ["p95"]))["p95"]
    return s.select(F.col("reading_id").alias("key"), "label",
                    (F.col("score") > thr).cast("int").alias("prediction"), "score")


# ---------------------------------------------------------------- W: windows
_W_SQL = R + """
, w AS (SELECT reading_id,
  lag(meter_reading, 1) OVER (PARTITION BY building_id ORDER BY "timestamp", reading_id) AS meter_reading_lag_1,
  lag(meter_reading, 24) OVER (PARTITION BY building_id ORDER BY "timestamp", reading_id) AS meter_reading_lag_24,
  CASE WHEN count(meter_reading) OVER (PARTITION BY building_id ORDER BY "timestamp", reading_id
                                       ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24
       THEN avg(meter_reading) OVER (PARTITION BY building_id ORDER BY "timestamp", reading_id
                                     ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END AS meter_reading_rolling_mean_24,
  CASE WHEN count(meter_reading) OVER (PARTITION BY building_id ORDER BY "timestamp", reading_id
                                       ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24
       THEN stddev_samp(meter_reading) OVER (PARTITION BY building_id ORDER BY "timestamp", reading_id
                                             ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END AS meter_reading_rolling_std_24
  FROM readings)
"""


def _feat(spark, sf_dir):
    return additional_features(T.readings(spark, sf_dir))


@register("W1_lag_1", _W_SQL + "SELECT reading_id, meter_reading_lag_1 FROM w")
def w1(spark, sf_dir):
    return _feat(spark, sf_dir).select("reading_id", "meter_reading_lag_1")


@register("W2_lag_24", _W_SQL + "SELECT reading_id, meter_reading_lag_24 FROM w")
def w2(spark, sf_dir):
    return _feat(spark, sf_dir).select("reading_id", "meter_reading_lag_24")


@register("W3_rolling_mean_24", _W_SQL + "SELECT reading_id, meter_reading_rolling_mean_24 FROM w")
def w3(spark, sf_dir):
    return _feat(spark, sf_dir).select("reading_id", "meter_reading_rolling_mean_24")


@register("W4_rolling_std_24", _W_SQL + "SELECT reading_id, meter_reading_rolling_std_24 FROM w")
def w4(spark, sf_dir):
    return _feat(spark, sf_dir).select("reading_id", "meter_reading_rolling_std_24")


_W5_SQL = SH + """
, o AS (SELECT *, minute("timestamp") AS mi FROM shipments),
w AS (SELECT l_orderkey, l_linenumber,
  sin(%s * mi / 60.0) AS minute_sin, cos(%s * mi / 60.0) AS minute_cos,
  lag(value, 1) OVER (ORDER BY "timestamp", l_orderkey, l_linenumber, l_partkey, building_id, value) AS energy_lag_1,
  lag(value, 24) OVER (ORDER BY "timestamp", l_orderkey, l_linenumber, l_partkey, building_id, value) AS energy_lag_24,
  CASE WHEN count(value) OVER (ORDER BY "timestamp", l_orderkey, l_linenumber, l_partkey, building_id, value ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24
       THEN avg(value) OVER (ORDER BY "timestamp", l_orderkey, l_linenumber, l_partkey, building_id, value ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END
       AS energy_rolling_mean_24,
  CASE WHEN count(value) OVER (ORDER BY "timestamp", l_orderkey, l_linenumber, l_partkey, building_id, value ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24
       THEN stddev_samp(value) OVER (ORDER BY "timestamp", l_orderkey, l_linenumber, l_partkey, building_id, value ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END
       AS energy_rolling_std_24, value
  FROM o)
""" % (PI2, PI2)


SHIP_ORDER = ["timestamp", "l_orderkey", "l_linenumber", "l_partkey", "building_id", "value"]


def _single_series(spark, sf_dir):
    return time_features(T.shipments(spark, sf_dir), "value", SHIP_ORDER)


@register("W5_single_series_features", _W5_SQL + """
SELECT l_orderkey, l_linenumber, minute_sin, minute_cos, energy_lag_1, energy_lag_24,
       energy_rolling_mean_24, energy_rolling_std_24 FROM w""")
def w5(spark, sf_dir):
    """One unkeyed series (all of lineitem by ship date): positions and
    blocks keep it off a single partition."""
    return _single_series(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "minute_sin", "minute_cos", "energy_lag_1", "energy_lag_24",
        "energy_rolling_mean_24", "energy_rolling_std_24")


@register("W6_ratio_to_rolling_mean", _W5_SQL + """
SELECT l_orderkey, l_linenumber, value / nullif(energy_rolling_mean_24, 0) AS energy_ratio_mean FROM w""")
def w6(spark, sf_dir):
    return _single_series(spark, sf_dir).select("l_orderkey", "l_linenumber", "energy_ratio_mean")


@register("W7_surrogate_row_id", R + """
SELECT reading_id, row_number() OVER (ORDER BY "timestamp", building_id, reading_id) - 1 AS row_id FROM readings""")
def w7(spark, sf_dir):
    return WN.row_ids(T.readings(spark, sf_dir), ["timestamp", "building_id", "reading_id"]).select("reading_id", "row_id")


@register("W8_chronological_split", R + """
SELECT reading_id, CAST(row_number() OVER (ORDER BY "timestamp", building_id, reading_id) - 1
                        >= floor((SELECT count(*) FROM readings) * 0.8) AS INTEGER) AS is_test FROM readings""")
def w8(spark, sf_dir):
    return WN.chronological_split(T.readings(spark, sf_dir), ["timestamp", "building_id", "reading_id"], 0.2) \
        .select("reading_id", "is_test")


# ---------------------------------------------------------------- L: sorts, limits, samples
@register("L1_sort_time_building", R + 'SELECT * FROM readings ORDER BY "timestamp", building_id, reading_id')
def l1(spark, sf_dir):
    return T.readings(spark, sf_dir).orderBy("timestamp", "building_id", "reading_id")


@register("L2_sort_building_time", R + 'SELECT * FROM readings ORDER BY building_id, "timestamp", reading_id')
def l2(spark, sf_dir):
    return T.readings(spark, sf_dir).orderBy("building_id", "timestamp", "reading_id")


@register("L5_preview_first_n", R + 'SELECT * FROM readings ORDER BY building_id, "timestamp", reading_id LIMIT 10')
def l5(spark, sf_dir):
    return preview(T.readings(spark, sf_dir), 10, ["building_id", "timestamp", "reading_id"])


@register("L6_first10_null_counts", HOURLY + """
, f AS (SELECT *, CAST(hour("timestamp") AS INTEGER) AS hour FROM readings_hourly),
n AS (SELECT 0 AS ordinal, 'building_id' AS column_name, count(*) - count(building_id) AS null_count FROM f
      UNION ALL SELECT 1, 'timestamp', count(*) - count("timestamp") FROM f
      UNION ALL SELECT 2, 'meter_reading', count(*) - count(meter_reading) FROM f
      UNION ALL SELECT 3, 'hour', count(*) - count(hour) FROM f)
SELECT * FROM n WHERE ordinal < 10""")
def l6(spark, sf_dir):
    from wattlane.operators.explore import null_counts
    f = T.readings_hourly(spark, sf_dir, stage=False).withColumn("hour", F.hour("timestamp"))
    return null_counts(f).where(F.col("ordinal") < 10)


@register("L7_bounded_sample", R + """
SELECT * FROM readings ORDER BY md5(CAST(reading_id AS VARCHAR) || '42'), reading_id LIMIT 1000""")
def l7(spark, sf_dir):
    return bounded_sample(T.readings(spark, sf_dir), 1000, "reading_id", 42)


@register("L8_stratified_split", R + """
, h AS (SELECT reading_id, anomaly,
               row_number() OVER (PARTITION BY anomaly ORDER BY md5(CAST(reading_id AS VARCHAR) || '42'), reading_id) - 1 AS rk,
               count(*) OVER (PARTITION BY anomaly) AS n FROM readings)
SELECT reading_id, anomaly, CAST(rk < round(0.2 * n) AS INTEGER) AS is_validation FROM h""")
def l8(spark, sf_dir):
    return stratified_split(T.readings(spark, sf_dir), "anomaly", "reading_id", 0.2, 42) \
        .select("reading_id", "anomaly", "is_validation")


@register("L10_group_fraction_sample", R + """
, h AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY md5(CAST(reading_id AS VARCHAR) || '42'), reading_id) - 1 AS rk,
               floor(count(*) OVER (PARTITION BY building_id) * 0.05) AS take FROM readings)
SELECT reading_id, building_id FROM h WHERE rk < take""")
def l10(spark, sf_dir):
    return group_fraction_sample(T.readings(spark, sf_dir), "building_id", "reading_id", 0.05, 42) \
        .select("reading_id", "building_id")


# ---------------------------------------------------------------- U: union
@register("U1_union_all_panels", R + """
, s AS (SELECT 'events' AS source, building_id, "timestamp", meter_reading AS value FROM readings
        UNION ALL
        SELECT 'lineitem', l_suppkey, l_shipdate, l_extendedprice FROM lineitem)
SELECT source, building_id, count(*) AS n_rows, sum(value) AS total FROM s GROUP BY 1, 2""")
def u1(spark, sf_dir):
    a = T.readings(spark, sf_dir).select(F.lit("events").alias("source"), "building_id", "timestamp",
                                         F.col("meter_reading").alias("value"))
    b = T.shipments(spark, sf_dir).select(F.lit("lineitem").alias("source"), "building_id", "timestamp", "value")
    return (a.unionByName(b).groupBy("source", "building_id")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total")))


# ---------------------------------------------------------------- D: data quality
@register("D1_median_imputation", HOURLY + """
, g AS (SELECT building_id, "timestamp",
               coalesce(meter_reading, median(meter_reading) OVER (PARTITION BY building_id)) AS meter_reading
        FROM readings_hourly)
SELECT building_id, "timestamp", coalesce(meter_reading, (SELECT median(meter_reading) FROM g)) AS meter_reading FROM g""")
def d1(spark, sf_dir):
    return QY.impute_median(T.readings_hourly(spark, sf_dir), "meter_reading", "building_id")


_IQR = R + """
, q AS (SELECT quantile_cont(meter_reading, 0.05) AS q05, quantile_cont(meter_reading, 0.25) AS q25,
               quantile_cont(meter_reading, 0.75) AS q75, quantile_cont(meter_reading, 0.95) AS q95,
               avg(meter_reading) AS mu, stddev_samp(meter_reading) AS sd FROM readings)
"""


@register("D2_iqr_outlier_flag", _IQR + """
SELECT reading_id, CAST(coalesce(meter_reading < q25 - 1.5 * (q75 - q25) OR meter_reading > q75 + 1.5 * (q75 - q25), false)
                        AS INTEGER) AS is_outlier FROM readings, q""")
def d2(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    out = QY.cap_outliers(r, ["meter_reading"], "iqr", 1.5, flag_suffix="_flag")
    return out.select("reading_id", F.col("meter_reading_flag").alias("is_outlier"))


@register("D3_zscore_outlier_flag", _IQR + """
SELECT reading_id, CAST(coalesce(abs((meter_reading - mu) / nullif(sd, 0)) > 3.0, false) AS INTEGER) AS is_outlier
FROM readings, q""")
def d3(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    out = QY.cap_outliers(r, ["meter_reading"], "zscore", 3.0, flag_suffix="_flag")
    return out.select("reading_id", F.col("meter_reading_flag").alias("is_outlier"))


@register("D4_cap_outliers", _IQR + """
SELECT reading_id,
       CASE WHEN coalesce(meter_reading < q25 - 1.5 * (q75 - q25) OR meter_reading > q75 + 1.5 * (q75 - q25), false)
            THEN CASE WHEN meter_reading > q95 THEN q95 ELSE q05 END ELSE meter_reading END AS meter_reading
FROM readings, q""")
def d4(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    return QY.cap_outliers(r, ["meter_reading"], "iqr", 1.5).select("reading_id", "meter_reading")


def _d5_sql():
    cols = ["l_extendedprice", "l_quantity", "l_discount"]
    qs = ", ".join(f"quantile_cont({c}, 0.05) AS {c}_q05, quantile_cont({c}, 0.25) AS {c}_q25, "
                   f"quantile_cont({c}, 0.75) AS {c}_q75, quantile_cont({c}, 0.95) AS {c}_q95" for c in cols)
    sel = ", ".join(
        f"CASE WHEN coalesce({c} < {c}_q25 - 1.5 * ({c}_q75 - {c}_q25) OR {c} > {c}_q75 + 1.5 * ({c}_q75 - {c}_q25), false) "
        f"THEN CASE WHEN {c} > {c}_q95 THEN {c}_q95 ELSE {c}_q05 END ELSE {c} END AS {c}" for c in cols)
    return f"WITH q AS (SELECT {qs} FROM lineitem)\nSELECT l_orderkey, l_linenumber, {sel} FROM lineitem, q"


@register("D5_multi_column_caps", _d5_sql())
def d5(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem")
    cols = ["l_extendedprice", "l_quantity", "l_discount"]
    return QY.cap_outliers(li, cols, "iqr", 1.5).select("l_orderkey", "l_linenumber", *cols)


@register("D6_standardize_population", R + """
, s AS (SELECT avg(meter_reading) AS m1, stddev_pop(meter_reading) AS s1,
               avg(hour("timestamp")) AS m2, stddev_pop(hour("timestamp")) AS s2 FROM readings)
SELECT reading_id, (meter_reading - m1) / CASE WHEN s1 = 0 THEN 1.0 ELSE s1 END AS meter_reading_z,
       (hour("timestamp") - m2) / CASE WHEN s2 = 0 THEN 1.0 ELSE s2 END AS hour_z,
       CAST((7.0 - 7.0) / 1.0 AS DOUBLE) AS const_z
FROM readings, s""")
def d6(spark, sf_dir):
    """Population-std scaling; the constant column maps to 0."""
    r = T.readings(spark, sf_dir).withColumns({"hour": F.hour("timestamp"), "const": F.lit(7.0)})
    out = QY.standardize(r, ["meter_reading", "hour", "const"], suffix="_z")
    return out.select("reading_id", "meter_reading_z", "hour_z", "const_z")


@register("D7_fit_train_apply_test", R + """
, o AS (SELECT *, row_number() OVER (ORDER BY "timestamp", building_id, reading_id) - 1 AS pos FROM readings),
c AS (SELECT floor(count(*) * 0.8) AS cut FROM readings),
s AS (SELECT avg(meter_reading) AS m, stddev_pop(meter_reading) AS sd FROM o, c WHERE pos < cut)
SELECT reading_id, (meter_reading - m) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END AS meter_reading_z
FROM o, c, s WHERE pos >= cut""")
def d7(spark, sf_dir):
    """Scaler fitted on the chronological train part, applied to the test part."""
    sp = WN.chronological_split(T.readings(spark, sf_dir), ["timestamp", "building_id", "reading_id"], 0.2)
    train, test = sp.where("is_test = 0"), sp.where("is_test = 1")
    return QY.standardize(test, ["meter_reading"], fit_on=train, suffix="_z").select("reading_id", "meter_reading_z")
