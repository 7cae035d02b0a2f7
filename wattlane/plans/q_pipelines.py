"""C*: composite pipelines registered as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlane.plans.catalog import R, register
from wattlane.plans.pipelines import flagship

FLAGSHIP_SQL = R + """
, g AS (SELECT *, CAST(hour("timestamp") AS INTEGER) AS hour,
               coalesce(meter_reading, median(meter_reading) OVER (PARTITION BY building_id)) AS m1 FROM readings),
f AS (SELECT * EXCLUDE (meter_reading, m1), coalesce(m1, (SELECT median(m1) FROM g)) AS meter_reading FROM g),
w AS (SELECT *, CASE WHEN count(meter_reading) OVER (PARTITION BY building_id ORDER BY "timestamp", reading_id
                                                     ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24
                     THEN avg(meter_reading) OVER (PARTITION BY building_id ORDER BY "timestamp", reading_id
                                                   ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END AS rm FROM f),
q AS (SELECT quantile_cont(meter_reading, 0.05) AS q05, quantile_cont(meter_reading, 0.25) AS q25,
             quantile_cont(meter_reading, 0.75) AS q75, quantile_cont(meter_reading, 0.95) AS q95 FROM f),
o AS (SELECT w.*, CAST(coalesce(meter_reading < q25 - 1.5 * (q75 - q25) OR meter_reading > q75 + 1.5 * (q75 - q25), false)
                       AS INTEGER) AS flag, q05, q95 FROM w, q)
SELECT building_id, hour, count(*) AS n_rows, CAST(sum(flag) AS BIGINT) AS outliers,
       sum(CASE WHEN flag = 1 THEN CASE WHEN meter_reading > q95 THEN q95 ELSE q05 END ELSE meter_reading END)
         AS sum_capped_reading,
       CAST(sum(CAST(round(rm * 2400) AS BIGINT)) AS BIGINT) AS rolling_sum_cents, count(rm) AS full_windows
FROM o GROUP BY 1, 2"""


@register("C0_flagship_outliers_by_building_hour", FLAGSHIP_SQL)
def c0(spark, sf_dir):
    """The minimum end-to-end slice (also ``entry``)."""
    return flagship(spark, sf_dir)


# --------------------------------------------------------------------------
from wattlane.functions import calendar as C  # noqa: E402
from wattlane.operators import explore as X  # noqa: E402
from wattlane.plans.catalog import SH, TWO_PI, cal_sql  # noqa: E402
from wattlane.plans.pipelines import (additional_features, preprocess_dashboard,  # noqa: E402
                                      preprocess_script)
from wattlane.plans.q_relational import HOURLY, _W5_SQL, _season_sql  # noqa: E402
from wattlane.sources import tables as T  # noqa: E402

PI2 = repr(TWO_PI)

_C2_SQL = R + f"""
, cal AS (SELECT *, {cal_sql(minute=True, day_cycle=False)} FROM readings),
g AS (SELECT * REPLACE (coalesce(meter_reading, median(meter_reading) OVER (PARTITION BY building_id)) AS meter_reading) FROM cal),
f AS (SELECT * REPLACE (coalesce(meter_reading, (SELECT median(meter_reading) FROM g)) AS meter_reading) FROM g),
s AS (SELECT building_id, avg(meter_reading) AS building_mean, stddev_samp(meter_reading) AS building_std,
             min(meter_reading) AS building_min, max(meter_reading) AS building_max,
             median(meter_reading) AS building_median FROM f GROUP BY 1),
c2 AS (SELECT f.*, s.* EXCLUDE (building_id),
       CASE WHEN s.building_mean = 0 AND f.meter_reading <> 0
            THEN CASE WHEN f.meter_reading > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END
            ELSE coalesce(f.meter_reading / nullif(s.building_mean, 0), 1.0) END AS consumption_ratio
       FROM f LEFT JOIN s USING (building_id))
"""


@register("C1_load_and_explore", HOURLY + """
SELECT 'readings' AS table_name, 5 AS n_columns, (SELECT count(*) FROM events) AS n_rows, CAST(0 AS BIGINT) AS null_cells
UNION ALL
SELECT 'readings_hourly', 3, count(*), CAST(count(*) * 3 - count(building_id) - count("timestamp") - count(meter_reading) AS BIGINT)
FROM readings_hourly""")
def c1(spark, sf_dir):
    """Required sources loaded; shape and null cells of the panel and of
    its hourly (gap-filled) form."""
    out = None
    for name, df in (("readings", T.readings(spark, sf_dir)), ("readings_hourly", T.readings_hourly(spark, sf_dir, stage=False))):
        nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
        row = df.select(F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("n_columns"),
                        F.count(F.lit(1)).alias("n_rows"), nulls.cast("long").alias("null_cells"))
        out = row if out is None else out.unionByName(row)
    return out


@register("C2_preprocess_script", _C2_SQL + "SELECT * FROM c2")
def c2(spark, sf_dir):
    """Calendar incl. minute, month/hour cycles, median imputation,
    per-building stats joined back, consumption ratio."""
    return preprocess_script(T.readings(spark, sf_dir))


@register("C3_preprocess_dashboard", HOURLY + f"""
, cal AS (SELECT *, {cal_sql(minute=False, day_cycle=True)} FROM readings_hourly),
g AS (SELECT * REPLACE (coalesce(meter_reading, median(meter_reading) OVER (PARTITION BY building_id)) AS meter_reading) FROM cal)
SELECT * REPLACE (coalesce(meter_reading, (SELECT median(meter_reading) FROM g)) AS meter_reading) FROM g""")
def c3(spark, sf_dir):
    """Dashboard variant on the gap-filled hourly panel (91 % NULL readings)."""
    return preprocess_dashboard(T.readings_hourly(spark, sf_dir))


_C4_FEATURES = ["energy_consumption", "quantity", "discount", "hour", "day_of_week", "is_weekend", "hour_sin", "hour_cos",
                "day_sin", "day_cos"] + [f"season_{v}" for v in sorted(C.SEASONS_FR)]


def _c4_sql() -> str:
    season = _season_sql("month(l_shipdate)", C.SEASONS_FR)
    onehot = ", ".join(f"CAST(coalesce(season = '{v}', false) AS INTEGER) AS season_{v}" for v in sorted(C.SEASONS_FR))
    stats = ", ".join(f"avg({f}) AS m_{i}, stddev_pop({f}) AS s_{i}" for i, f in enumerate(_C4_FEATURES))
    scaled = ", ".join(f"round(({f} - m_{i}) / CASE WHEN s_{i} = 0 THEN 1.0 ELSE s_{i} END, 6) + 0.0 AS {f}"
                       for i, f in enumerate(_C4_FEATURES))
    return f"""
WITH b AS (SELECT *, l_shipdate AS "timestamp", {season} AS season FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS energy_consumption,
             CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount,
             CAST(hour("timestamp") AS INTEGER) AS hour, CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
             CAST(isodow("timestamp") - 1 >= 5 AS INTEGER) AS is_weekend,
             sin({PI2} * hour("timestamp") / 24.0) AS hour_sin, cos({PI2} * hour("timestamp") / 24.0) AS hour_cos,
             sin({PI2} * (isodow("timestamp") - 1) / 7.0) AS day_sin, cos({PI2} * (isodow("timestamp") - 1) / 7.0) AS day_cos,
             {onehot} FROM b),
st AS (SELECT {stats} FROM x)
SELECT l_orderkey, l_linenumber, {scaled} FROM x, st"""


@register("C4_preprocess_matrix_scaled", _c4_sql())
def c4(spark, sf_dir):
    """Single-series matrix: shipped value as consumption with its measured
    companions, calendar, cycles, season one-hot; all scaled by population
    std and rounded to 6 places. Returns key columns plus the features."""
    from wattlane.functions.scalar import one_hot
    from wattlane.operators.quality import standardize
    s = T.table(spark, sf_dir, "lineitem")
    t = F.col("l_shipdate")
    hs, hc = C.cyclic(F.hour(t), 24)
    ds, dc = C.cyclic(F.weekday(t), 7)
    s = s.withColumns({"energy_consumption": F.col("l_extendedprice").cast("double"), "quantity": F.col("l_quantity").cast("double"),
                       "discount": F.col("l_discount").cast("double"), "hour": F.hour(t), "day_of_week": F.weekday(t),
                       "is_weekend": C.is_weekend(t), "hour_sin": hs, "hour_cos": hc, "day_sin": ds, "day_cos": dc,
                       "season": C.season(F.month(t), C.SEASONS_FR)})
    s = s.withColumns(one_hot("season", sorted(C.SEASONS_FR), "season"))
    z = standardize(s, _C4_FEATURES)
    return z.select("l_orderkey", "l_linenumber", *[(F.round(f, 6) + F.lit(0.0)).alias(f) for f in _C4_FEATURES])


_C5_SQL = R + f"""
, w AS (SELECT *, CAST(hour("timestamp") AS INTEGER) AS hour, CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
               CAST(month("timestamp") AS INTEGER) AS month, CAST(isodow("timestamp") - 1 >= 5 AS INTEGER) AS is_weekend,
               sin({PI2} * hour("timestamp") / 24.0) AS hour_sin, cos({PI2} * hour("timestamp") / 24.0) AS hour_cos,
               sin({PI2} * (isodow("timestamp") - 1) / 7.0) AS day_sin, cos({PI2} * (isodow("timestamp") - 1) / 7.0) AS day_cos,
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


@register("C5_additional_features", _C5_SQL + "SELECT * FROM w")
def c5(spark, sf_dir):
    return additional_features(T.readings(spark, sf_dir))


@register("C6_time_features", _W5_SQL + """
SELECT l_orderkey, l_linenumber, minute_sin, minute_cos, energy_lag_1, energy_lag_24, energy_rolling_mean_24,
       energy_rolling_std_24, value / nullif(energy_rolling_mean_24, 0) AS energy_ratio_mean FROM w""")
def c6(spark, sf_dir):
    from wattlane.plans.q_relational import _single_series
    return _single_series(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "minute_sin", "minute_cos", "energy_lag_1", "energy_lag_24",
        "energy_rolling_mean_24", "energy_rolling_std_24", "energy_ratio_mean")


@register("C7_eda_hourly_anomaly_rate", _C2_SQL + "SELECT hour, avg(anomaly) AS anomaly_rate, avg(meter_reading) AS mean FROM c2 GROUP BY 1")
def c7(spark, sf_dir):
    """EDA on the preprocessed table: anomaly rate and mean per hour."""
    f = preprocess_script(T.readings(spark, sf_dir))
    return f.groupBy("hour").agg(F.avg("anomaly").alias("anomaly_rate"), F.avg("meter_reading").alias("mean"))


@register("C7_eda_box_by_label", _C2_SQL + """
, q AS (SELECT anomaly, quantile_cont(meter_reading, 0.25) AS q1, quantile_cont(meter_reading, 0.5) AS median,
               quantile_cont(meter_reading, 0.75) AS q3 FROM c2 WHERE meter_reading IS NOT NULL GROUP BY 1)
SELECT r.anomaly, q.q1, q.median, q.q3,
       min(CASE WHEN meter_reading >= q1 - 1.5 * (q3 - q1) THEN meter_reading END) AS whisker_lo,
       max(CASE WHEN meter_reading <= q3 + 1.5 * (q3 - q1) THEN meter_reading END) AS whisker_hi,
       count(*) FILTER (WHERE meter_reading < q1 - 1.5 * (q3 - q1) OR meter_reading > q3 + 1.5 * (q3 - q1)) AS outliers,
       count(*) AS n
FROM c2 r JOIN q USING (anomaly) WHERE meter_reading IS NOT NULL GROUP BY 1, 2, 3, 4""")
def c7b(spark, sf_dir):
    return X.box_stats(preprocess_script(T.readings(spark, sf_dir)), "meter_reading", ["anomaly"])


@register("C10_data_section_summary", R + """
SELECT count(*) AS total_records, 5 AS features, count(DISTINCT building_id) AS buildings,
       CAST(sum(anomaly) AS BIGINT) AS anomalies, avg(anomaly) * 100 AS anomaly_rate,
       CAST(floor(count(*) / nullif(count(DISTINCT building_id), 0)) AS BIGINT) AS obs_per_building,
       strftime(CAST(min("timestamp") AS DATE), '%Y-%m-%d') || ' to ' || strftime(CAST(max("timestamp") AS DATE), '%Y-%m-%d') AS time_span
FROM readings""")
def c10(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    return r.select(
        F.count(F.lit(1)).alias("total_records"), F.lit(len(r.columns)).alias("features"),
        F.count_distinct("building_id").alias("buildings"), F.sum("anomaly").cast("long").alias("anomalies"),
        (F.avg("anomaly") * 100).alias("anomaly_rate"),
        F.floor(F.try_divide(F.count(F.lit(1)), F.count_distinct("building_id"))).cast("long").alias("obs_per_building"),
        F.concat(F.date_format(F.min("timestamp"), "yyyy-MM-dd"), F.lit(" to "),
                 F.date_format(F.max("timestamp"), "yyyy-MM-dd")).alias("time_span"))


@register("C11_preprocessing_section_nulls", HOURLY + f"""
, cal AS (SELECT *, {cal_sql(minute=False, day_cycle=True)} FROM readings_hourly)
SELECT 0 AS ordinal, 'building_id' AS column_name, count(*) - count(building_id) AS null_count FROM cal
UNION ALL SELECT 1, 'timestamp', count(*) - count("timestamp") FROM cal
UNION ALL SELECT 2, 'meter_reading', count(*) - count(meter_reading) FROM cal
UNION ALL SELECT 3, 'year', count(*) - count(year) FROM cal
UNION ALL SELECT 4, 'month', count(*) - count(month) FROM cal
UNION ALL SELECT 5, 'day', count(*) - count(day) FROM cal
UNION ALL SELECT 6, 'hour', count(*) - count(hour) FROM cal
UNION ALL SELECT 7, 'dayofweek', count(*) - count(dayofweek) FROM cal
UNION ALL SELECT 8, 'is_weekend', count(*) - count(is_weekend) FROM cal
UNION ALL SELECT 9, 'month_sin', count(*) - count(month_sin) FROM cal""")
def c11(spark, sf_dir):
    """Nulls of the first ten columns of the hourly panel with calendar
    features, before imputation (schema order, not sorted)."""
    f = C.add_calendar(T.readings_hourly(spark, sf_dir, stage=False), minute=False, day_cycle=True)
    return X.null_counts(f).where(F.col("ordinal") < 10)


@register("C12_eda_section_summary", R + """
SELECT avg(meter_reading) AS mean, stddev_samp(meter_reading) AS std, median(meter_reading) AS median,
       avg(anomaly) BETWEEN 0.01 AND 0.15 AS balanced,
       CAST(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 86400000000) AS BIGINT) AS span_days
FROM readings""")
def c12(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    from wattlane.operators.ordering import quantiles
    med = quantiles(r, "meter_reading", [0.5], [], ["median"]).first()["median"]
    return r.select(F.avg("meter_reading").alias("mean"), F.stddev_samp("meter_reading").alias("std"),
                    F.lit(med).cast("double").alias("median"), F.avg("anomaly").between(0.01, 0.15).alias("balanced"),
                    X.span_days(F.min("timestamp"), F.max("timestamp")).alias("span_days"))


@register("C16_consumption_overview_normals", R + """
, d AS (SELECT CAST(i AS INTEGER) AS dow FROM range(7) t(i)),
m AS (SELECT CAST(isodow("timestamp") - 1 AS INTEGER) AS dow, avg(meter_reading) AS mean FROM readings WHERE anomaly = 0 GROUP BY 1)
SELECT d.dow, ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][d.dow + 1] AS day_name,
       left(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][d.dow + 1], 3) AS day_abbr, m.mean
FROM d LEFT JOIN m USING (dow)""")
def c16(spark, sf_dir):
    """Consumption of normal rows by day name, Monday first."""
    return X.weekday_means(T.readings(spark, sf_dir).where("anomaly = 0"), "meter_reading")


@register("C18_seasonal_analysis", f"""
WITH s AS (SELECT {_season_sql('month(l_shipdate)', C.SEASONS_EN)} AS season, l_extendedprice AS value,
                  CAST(l_returnflag = 'R' AS INTEGER) AS anomaly FROM lineitem)
SELECT season, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS median,
       CAST(sum(anomaly) AS BIGINT) AS anomalies, count(*) AS n, avg(anomaly) * 100 AS anomaly_rate_pct
FROM s GROUP BY 1""")
def c18(spark, sf_dir):
    """Seasonal mean / std / median with returned lines as anomalies."""
    from wattlane.operators.ordering import quantiles
    li = T.table(spark, sf_dir, "lineitem").select(
        C.season(F.month("l_shipdate")).alias("season"), F.col("l_extendedprice").alias("value"),
        (F.col("l_returnflag") == "R").cast("int").alias("anomaly"))
    g = li.groupBy("season").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                 F.sum("anomaly").cast("long").alias("anomalies"), F.count(F.lit(1)).alias("n"),
                                 (F.avg("anomaly") * 100).alias("anomaly_rate_pct"))
    return g.join(quantiles(li, "value", [0.5], ["season"], ["median"]), "season", "left")


@register("C19_anomaly_timeline", _C2_SQL + """
SELECT CAST("timestamp" AS DATE) AS date, count(*) AS anomalies FROM c2 WHERE anomaly = 1 GROUP BY 1""")
def c19(spark, sf_dir):
    return X.daily_counts(preprocess_script(T.readings(spark, sf_dir)))


# numeric columns of the preprocessed table, in its column order
C2_NUMERIC = ["building_id", "reading_id", "meter_reading", "anomaly", "year", "month", "day", "hour", "minute", "dayofweek", "is_weekend",
              "month_sin", "month_cos", "hour_sin", "hour_cos", "building_mean", "building_std", "building_min", "building_max",
              "building_median", "consumption_ratio"]


def _corr_sql_over(prefix_sql: str, src: str, cols: list[str], lower_only: bool = True) -> str:
    """All pairs in one aggregate over a materialised source. A column
    whose values vary by no more than rounding has no correlation."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols)) if i > j or not lower_only]

    def c(i, j):
        x, y = f"CAST({cols[i]} AS DOUBLE)", f"CAST({cols[j]} AS DOUBLE)"
        return f"round(corr({x}, {y}), 6) AS c_{i}_{j}, min({x}) = max({x}) OR min({y}) = max({y}) AS k_{i}_{j}"
    picks = "\nUNION ALL ".join(f"SELECT {i} AS i, {j} AS j, '{cols[i]}' AS col_i, '{cols[j]}' AS col_j, "
                                f"CASE WHEN k_{i}_{j} OR isnan(c_{i}_{j}) THEN NULL ELSE c_{i}_{j} + 0.0 END AS corr FROM agg" for i, j in pairs)
    return prefix_sql + f"""
, src AS MATERIALIZED (SELECT * FROM {src}),
agg AS MATERIALIZED (SELECT {", ".join(c(i, j) for i, j in pairs)} FROM src)
{picks}"""


def _rounded_corr(df, cols, lower_only):
    m = X.correlation_matrix(df, cols, lower_only=lower_only)
    return m.withColumn("corr", F.round("corr", 6) + F.lit(0.0))


@register("C17_correlation_heatmap", _corr_sql_over(_C2_SQL, "c2", C2_NUMERIC))
def c17(spark, sf_dir):
    """Masked (strict lower triangle) correlation of all numeric columns of
    the preprocessed table; constant columns give NULL."""
    f = preprocess_script(T.readings(spark, sf_dir))
    return _rounded_corr(f, C2_NUMERIC, True)


@register("C7_eda_correlation", _corr_sql_over(_C2_SQL, "c2", C2_NUMERIC, False))
def c7c(spark, sf_dir):
    """Full correlation matrix of the preprocessed numeric columns."""
    return _rounded_corr(preprocess_script(T.readings(spark, sf_dir)), C2_NUMERIC, False)


@register("C8_train_detection_models")
def c8(spark, sf_dir):
    """Random forest on the stratified split (mean fill) and an isolation
    forest on the standardised training rows; validation metrics."""
    from wattlane.operators.detect import forest as RF
    from wattlane.operators.detect.isolation import fit_isolation_forest
    from wattlane.operators.evaluate import evaluate
    from wattlane.operators.quality import standardize
    from wattlane.plans.pipelines import supervised_frame
    f, feats = supervised_frame(spark, sf_dir, "mean")
    train, val = f.where("is_validation = 0"), f.where("is_validation = 1")
    rf = RF.fit_random_forest(train, feats, "anomaly")
    m_rf = evaluate(RF.predict_forest(rf, val), "random_forest", "anomaly")
    z_train, z_val = standardize(train, feats, fit_on=train), standardize(val, feats, fit_on=train)
    iso = fit_isolation_forest(z_train, feats, "reading_id", 100, 256, 0.1)
    m_iso = evaluate(iso.transform(z_val), "isolation_forest", "anomaly")
    return m_rf.unionByName(m_iso)


@register("C9_pca_view")
def c9(spark, sf_dir):
    """PCA(2) of every numeric column, label and key included (as the
    script does), with the explained-variance ratios attached."""
    from wattlane.operators.detect.pca import pca_view
    f = preprocess_script(T.readings(spark, sf_dir))
    cols = X.numeric_columns(f)
    rows, var = pca_view(f, cols, 2, keep=["reading_id", "anomaly"])
    ratios = {r.component: r.explained_ratio for r in var.collect()}
    return rows.withColumns({"pc1_ratio": F.lit(ratios["pc1"]), "pc2_ratio": F.lit(ratios["pc2"])})


def _modelling(spark, sf_dir, max_depth=None):
    """(metrics of forest and isolation forest, fitted forest, features,
    scored validation rows of both, by model). Without a depth the forest has
    no limit; its trees then stay in Spark tables, not with the driver."""
    from wattlane.operators.detect import forest as RF
    from wattlane.operators.detect.deepforest import fit_deep_forest
    from wattlane.operators.detect.isolation import fit_isolation_forest
    from wattlane.operators.evaluate import evaluate
    from wattlane.operators.quality import Scaler
    from wattlane.plans.pipelines import supervised_frame
    from wattlane.session import materialize
    f, feats = supervised_frame(spark, sf_dir, "zero")
    train, val = f.where("is_validation = 0"), f.where("is_validation = 1")
    keep = ["reading_id", "anomaly", "meter_reading", "score", "prediction"]
    if max_depth is None:
        rf = fit_deep_forest(train, feats, "reading_id", "anomaly")
        forest = rf.transform(val)
    else:
        rf = RF.fit_random_forest(train, feats, "anomaly", max_depth=max_depth)
        forest = RF.predict_forest(rf, val)
    z = Scaler.fit(train, feats)
    iso = fit_isolation_forest(z.transform(train), feats, "reading_id", 100, 256, 0.1)
    scored = {"random_forest": materialize(forest.select(keep), "forest-scores"),
              "isolation_forest": materialize(iso.transform(z.transform(val)).select(keep), "iso-scores")}
    m = None
    for name, s in scored.items():
        e = evaluate(s, name, "anomaly")
        m = e if m is None else m.unionByName(e)
    return m, rf, feats, scored


@register("C13_modelling_section")
def c13(spark, sf_dir):
    """Dashboard modelling: NULL -> 0 features, forest without a depth
    limit (as the reference's), isolation forest; metrics with the
    confusion counts, and which of the two is more accurate."""
    m, _, _, _ = _modelling(spark, sf_dir)
    best = m.select(F.max_by("model", F.struct("accuracy", "model")).alias("b")).first()["b"]
    return m.withColumn("is_best", F.col("model") == F.lit(best))


@register("C13_top10_importances")
def c13i(spark, sf_dir):
    """The ten features the forest uses most."""
    _, rf, _, _ = _modelling(spark, sf_dir)
    return rf.importance().orderBy(F.desc("importance"), "feature").limit(10)


@register("C14_results_section")
def c14(spark, sf_dir):
    """Held-out rows as an unlabelled test table: detected rates (forest of
    depth 10)."""
    from wattlane.operators.evaluate import detected_rate
    _, _, _, scored = _modelling(spark, sf_dir, 10)
    out = None
    for name, s in scored.items():
        row = s.select(F.lit(name).alias("model"), detected_rate().alias("detected_pct"), F.count(F.lit(1)).alias("n_rows"))
        out = row if out is None else out.unionByName(row)
    return out


@register("C14_probability_sample")
def c14p(spark, sf_dir):
    """Reading, P(anomaly) and prediction of a fixed sample of 5,000 test
    rows (a chart sample; all rows where there are fewer)."""
    _, _, _, scored = _modelling(spark, sf_dir, 10)
    s = scored["random_forest"].select("reading_id", "meter_reading", F.col("score").alias("p_anomaly"), "prediction")
    return X.bounded_sample(s, 5000, "reading_id")


def _suite(spark, sf_dir):
    from wattlane.operators.detect.scorer import train_all
    from wattlane.plans.pipelines import detector_frame
    train_n, test, feats = detector_frame(spark, sf_dir)
    return train_all(train_n, test, feats, "reading_id", "label")


@register("C15_detector_suite_summary")
def c15(spark, sf_dir):
    """Chronological split, all four detectors trained on normals, text summary."""
    from wattlane.operators.evaluate import results_summary
    return results_summary(_suite(spark, sf_dir)[0])


def _by_model(scored, fn):
    out = None
    for name, s in scored.items():
        r = fn(s).withColumn("model", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


@register("C20_model_comparison_roc")
def c20(spark, sf_dir):
    """ROC points of every detector, stacked by model."""
    from wattlane.operators.evaluate import roc_curve
    return _by_model(_suite(spark, sf_dir)[1], roc_curve)


@register("C20_metrics_long")
def c20m(spark, sf_dir):
    """(model, metric, score) of every detector, NULL scores dropped."""
    from wattlane.operators.evaluate import metrics_long
    return metrics_long(_suite(spark, sf_dir)[0])


@register("C21_detection_dashboard")
def c21(spark, sf_dir):
    """Score histogram (50 bins) per detector."""
    return _by_model(_suite(spark, sf_dir)[1], lambda s: X.histogram(s, "score", 50))


@register("C21_prediction_overlay")
def c21o(spark, sf_dir):
    """Predicted-positive rows of every detector with its F1."""
    from wattlane.plans.q_models import overlay
    return overlay(*_suite(spark, sf_dir))


# --------------------------------------------------- further section aggregates
from wattlane.plans.q_explore import _hist_sql  # noqa: E402

_SEASONS_SQL = f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, {_season_sql('month(l_shipdate)', C.SEASONS_EN)} AS season,
                  CAST(l_extendedprice AS DOUBLE) AS value, CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem)
"""


def _box_sql(src: str, by: str, value: str) -> str:
    return f"""
, q AS (SELECT {by}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
               quantile_cont({value}, 0.75) AS q3 FROM {src} WHERE {value} IS NOT NULL GROUP BY 1)
SELECT r.{by}, q.q1, q.median, q.q3,
       min(CASE WHEN {value} >= q1 - 1.5 * (q3 - q1) THEN {value} END) AS whisker_lo,
       max(CASE WHEN {value} <= q3 + 1.5 * (q3 - q1) THEN {value} END) AS whisker_hi,
       count(*) FILTER (WHERE {value} < q1 - 1.5 * (q3 - q1) OR {value} > q3 + 1.5 * (q3 - q1)) AS outliers,
       count(*) AS n
FROM {src} r JOIN q USING ({by}) WHERE {value} IS NOT NULL GROUP BY 1, 2, 3, 4"""


@register("C1_label_shares", R + """
SELECT anomaly, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM readings) AS share_pct FROM readings GROUP BY 1""")
def c1s(spark, sf_dir):
    """Rows and share of each label."""
    return X.value_counts(T.readings(spark, sf_dir), "anomaly")


@register("C1_preview", R + 'SELECT * FROM readings ORDER BY "timestamp", reading_id LIMIT 5')
def c1p(spark, sf_dir):
    """The first five readings (a preview)."""
    return X.preview(T.readings(spark, sf_dir), 5, ["timestamp", "reading_id"])


@register("C7_eda_monthly_mean", _C2_SQL + "SELECT month, avg(meter_reading) AS mean FROM c2 GROUP BY 1")
def c7m(spark, sf_dir):
    return X.group_stats(preprocess_script(T.readings(spark, sf_dir)), "month", "meter_reading")


@register("C7_eda_histogram", _C2_SQL.replace("\ng AS", "\ng0 AS").replace("FROM g)", "FROM g0)").replace("FROM g)", "FROM g0)").replace("FROM g\n", "FROM g0\n").replace("AS meter_reading) FROM g)", "AS meter_reading) FROM g0)") + _hist_sql("c2", "meter_reading"))
def c7h(spark, sf_dir):
    return X.histogram(preprocess_script(T.readings(spark, sf_dir)), "meter_reading", 50)


@register("C10_column_profile", R + """
, n AS (SELECT count(*) AS n FROM readings),
p AS (SELECT 0 AS ordinal, 'reading_id' AS column_name, 'bigint' AS data_type, count(DISTINCT reading_id) AS distinct_values,
             count(*) - count(reading_id) AS null_values FROM readings
      UNION ALL SELECT 1, 'building_id', 'bigint', count(DISTINCT building_id), count(*) - count(building_id) FROM readings
      UNION ALL SELECT 2, 'timestamp', 'timestamp_ntz', count(DISTINCT "timestamp"), count(*) - count("timestamp") FROM readings
      UNION ALL SELECT 3, 'meter_reading', 'double', count(DISTINCT meter_reading), count(*) - count(meter_reading) FROM readings
      UNION ALL SELECT 4, 'anomaly', 'int', count(DISTINCT anomaly), count(*) - count(anomaly) FROM readings)
SELECT p.*, printf('%.1f', round_even((n - null_values) * 100.0 / n, 1)) || '%' AS completeness FROM p, n""")
def c10c(spark, sf_dir):
    """Type, distinct values, nulls and completeness of every column."""
    return X.column_profile(T.readings(spark, sf_dir))


@register("C10_preview", R + 'SELECT * FROM readings ORDER BY building_id, "timestamp", reading_id LIMIT 10')
def c10p(spark, sf_dir):
    """The first ten readings by building (a preview)."""
    return X.preview(T.readings(spark, sf_dir), 10, ["building_id", "timestamp", "reading_id"])


_NEW = ["year", "month", "day", "hour", "dayofweek", "is_weekend", "month_sin", "month_cos", "hour_sin", "hour_cos", "day_sin", "day_cos"]


@register("C11_new_columns", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', (SELECT count(*) FROM events))" for i, c in enumerate(_NEW))
          + ") t(ordinal, column_name, n_values)")
def c11n(spark, sf_dir):
    """The columns that the dashboard's preprocessing adds, in order, with
    their values counted."""
    r = T.readings(spark, sf_dir)
    f = preprocess_dashboard(r)
    new = [c for c in f.columns if c not in r.columns]
    counts = f.select(*[F.count(c).alias(c) for c in new])
    pairs = ", ".join(f"{i}, '{c}', `{c}`" for i, c in enumerate(new))
    return counts.selectExpr(f"stack({len(new)}, {pairs}) AS (ordinal, column_name, n_values)")


@register("C11_hour_cycle_counts", R + f"""
SELECT round(sin({PI2} * hour("timestamp") / 24.0), 6) + 0.0 AS hour_sin, round(cos({PI2} * hour("timestamp") / 24.0), 6) + 0.0 AS hour_cos,
       count(*) AS n FROM readings GROUP BY 1, 2""")
def c11h(spark, sf_dir):
    """Rows per point of the hour cycle (the 24 bars of its histogram)."""
    f = preprocess_dashboard(T.readings(spark, sf_dir))
    return f.groupBy((F.round("hour_sin", 6) + F.lit(0.0)).alias("hour_sin"), (F.round("hour_cos", 6) + F.lit(0.0)).alias("hour_cos")).agg(F.count("*").alias("n"))


@register("C11_month_cycle_counts", SH + f"""
SELECT round(sin({PI2} * month("timestamp") / 12.0), 6) + 0.0 AS month_sin, round(cos({PI2} * month("timestamp") / 12.0), 6) + 0.0 AS month_cos,
       count(*) AS n FROM shipments GROUP BY 1, 2""")
def c11m(spark, sf_dir):
    """Rows per point of the month cycle."""
    f = C.add_calendar(T.shipments(spark, sf_dir), minute=False)
    return f.groupBy((F.round("month_sin", 6) + F.lit(0.0)).alias("month_sin"), (F.round("month_cos", 6) + F.lit(0.0)).alias("month_cos")).agg(F.count("*").alias("n"))


@register("C12_eda_hourly_mean", R + 'SELECT CAST(hour("timestamp") AS INTEGER) AS hour, avg(meter_reading) AS mean FROM readings GROUP BY 1')
def c12h(spark, sf_dir):
    return X.group_stats(T.readings(spark, sf_dir).withColumn("hour", F.hour("timestamp")), "hour", "meter_reading")


@register("C12_eda_weekday_mean", R + 'SELECT CAST(isodow("timestamp") - 1 AS INTEGER) AS dayofweek, avg(meter_reading) AS mean FROM readings GROUP BY 1')
def c12w(spark, sf_dir):
    return X.group_stats(T.readings(spark, sf_dir).withColumn("dayofweek", F.weekday("timestamp")), "dayofweek", "meter_reading")


@register("C12_eda_histogram", R + _hist_sql("readings", "meter_reading"))
def c12g(spark, sf_dir):
    return X.histogram(T.readings(spark, sf_dir), "meter_reading", 50)


@register("C12_eda_box_by_label", R + _box_sql("readings", "anomaly", "meter_reading"))
def c12b(spark, sf_dir):
    return X.box_stats(T.readings(spark, sf_dir), "meter_reading", ["anomaly"])


@register("C12_eda_sample", R + """
SELECT reading_id, "timestamp", meter_reading, anomaly FROM readings
ORDER BY md5(CAST(reading_id AS VARCHAR) || '42'), reading_id LIMIT 10000""")
def c12s(spark, sf_dir):
    """The fixed 10,000-row chart sample."""
    r = T.readings(spark, sf_dir).select("reading_id", "timestamp", "meter_reading", "anomaly")
    return X.bounded_sample(r, 10_000, "reading_id")


@register("C16_hourly_pattern_normals", R + """
SELECT CAST(hour("timestamp") AS INTEGER) AS hour, avg(meter_reading) AS mean, stddev_samp(meter_reading) AS std, count(*) AS n
FROM readings WHERE anomaly = 0 GROUP BY 1""")
def c16h(spark, sf_dir):
    r = T.readings(spark, sf_dir).where("anomaly = 0")
    return r.groupBy(F.hour("timestamp").alias("hour")).agg(F.avg("meter_reading").alias("mean"), F.stddev_samp("meter_reading").alias("std"),
                                                            F.count("*").alias("n"))


@register("C16_global_statistics", R + """
SELECT avg(meter_reading) AS mean, stddev_samp(meter_reading) AS std, min(meter_reading) AS min, max(meter_reading) AS max,
       CAST(sum(anomaly) AS BIGINT) AS anomalies, avg(anomaly) * 100 AS anomaly_rate FROM readings""")
def c16g(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    return r.select(F.avg("meter_reading").alias("mean"), F.stddev_samp("meter_reading").alias("std"), F.min("meter_reading").alias("min"),
                    F.max("meter_reading").alias("max"), F.sum("anomaly").cast("long").alias("anomalies"), (F.avg("anomaly") * 100).alias("anomaly_rate"))


@register("C16_histogram_normals", R + ", nm AS (SELECT * FROM readings WHERE anomaly = 0)" + _hist_sql("nm", "meter_reading"))
def c16n(spark, sf_dir):
    return X.histogram(T.readings(spark, sf_dir).where("anomaly = 0"), "meter_reading", 50)


def _seasons(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", C.season(F.month("l_shipdate")).alias("season"),
        F.col("l_extendedprice").cast("double").alias("value"), F.col("l_quantity").cast("double").alias("quantity"))


@register("C18_box_by_season", _SEASONS_SQL + _box_sql("s", "season", "value"))
def c18b(spark, sf_dir):
    return X.box_stats(_seasons(spark, sf_dir), "value", ["season"])


@register("C18_driver_value_pairs", _SEASONS_SQL + """
SELECT season, quantity, avg(value) AS mean_value, count(*) AS n FROM s GROUP BY 1, 2""")
def c18p(spark, sf_dir):
    """Pairs of the driving measure (quantity) and the value, per season:
    the points of the scatter, one per distinct measure."""
    return _seasons(spark, sf_dir).groupBy("season", "quantity").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))
