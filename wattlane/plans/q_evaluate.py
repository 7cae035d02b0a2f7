"""Evaluation and model comparison.

The detectors here are plain rules over the driver's tables (a 95th
percentile score threshold and an absolute z-score), so every metric has
an exact DuckDB twin; the learned detectors reuse the same evaluators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlane.functions.scalar import abs_zscore
from wattlane.operators import evaluate as EV
from wattlane.operators.ordering import one_row, quantiles
from wattlane.operators.split import balanced_weights
from wattlane.plans.catalog import Q, SC, R, register
from wattlane.plans.q_relational import HOURLY
from wattlane.sources import tables as T


def detector_threshold(spark, sf_dir):
    s = T.scored(spark, sf_dir)
    thr = one_row(quantiles(s, "score", [0.95], [], ["p95"]))["p95"]
    return s.withColumn("prediction", (F.col("score") > thr).cast("int"))


def detector_zscore(spark, sf_dir):
    s = T.scored(spark, sf_dir)
    st = one_row(s.select(F.avg("score").alias("m"), F.stddev_samp("score").alias("s")))
    z = abs_zscore("score", st["m"], st["s"])
    return s.withColumns({"score": z, "prediction": (z > 2.0).cast("int")})


def _metrics(spark, sf_dir):
    thr = detector_threshold(spark, sf_dir)
    a = EV.evaluate(thr, "threshold_p95")
    b = EV.evaluate(detector_zscore(spark, sf_dir), "abs_zscore")
    c = EV.evaluate(thr.where(F.col("label") == 0), "threshold_p95_normals")
    return a.unionByName(b).unionByName(c)


_DET_SQL = SC + """
, thr AS (SELECT *, CAST(score > (SELECT quantile_cont(score, 0.95) FROM scored) AS INTEGER) AS prediction FROM scored),
zs AS (SELECT reading_id, label, abs((score - (SELECT avg(score) FROM scored)) / (SELECT stddev_samp(score) FROM scored)) AS score
       FROM scored),
zsp AS (SELECT *, CAST(score > 2.0 AS INTEGER) AS prediction FROM zs),
nrm AS (SELECT * FROM thr WHERE label = 0)
"""


def _metric_sql(name: str, src: str) -> str:
    return f"""
, {name}_sc AS (SELECT score AS t, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
                FROM {src} WHERE score IS NOT NULL GROUP BY 1),
{name}_cum AS (SELECT *, sum(neg) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_le FROM {name}_sc),
{name}_auc AS (SELECT sum(pos * (neg_le - neg / 2.0)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc FROM {name}_cum),
{name}_cm AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
                     count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                     count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
                     count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM {src}),
{name}_m AS (SELECT '{name}' AS model, coalesce((tn + tp) / nullif(CAST(tn + fp + fn + tp AS DOUBLE), 0), 0.0) AS accuracy,
                    coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
                    coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
                    tn, fp, fn, tp FROM {name}_cm),
{name}_row AS (SELECT model, accuracy, precision, recall,
                      coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1_score,
                      auc, tn, fp, fn, tp FROM {name}_m, {name}_auc)"""


def _metrics_sql():
    sql = _DET_SQL
    for name, src in (("threshold_p95", "thr"), ("abs_zscore", "zsp"), ("threshold_p95_normals", "nrm")):
        sql += _metric_sql(name, src)
    sql += """
, metrics AS (SELECT * FROM threshold_p95_row UNION ALL SELECT * FROM abs_zscore_row
              UNION ALL SELECT * FROM threshold_p95_normals_row)
"""
    return sql


METRICS = _metrics_sql()


@register("A28_accuracy", Q + "SELECT avg(CAST(prediction = label AS INTEGER)) AS accuracy FROM quality")
def a28(spark, sf_dir):
    q = T.quality(spark, sf_dir)
    return q.select(EV.accuracy(q).alias("accuracy"))


@register("A29_confusion_matrix", Q + """
, g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(label, prediction))
SELECT g.label, g.prediction, count(q.key) AS count
FROM g LEFT JOIN quality q ON q.label = g.label AND q.prediction = g.prediction GROUP BY 1, 2""")
def a29(spark, sf_dir):
    return EV.confusion_matrix(T.quality(spark, sf_dir))


@register("A30_classification_report", Q + """
, c AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
               count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp
        FROM quality),
m AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS p1, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS r1,
             coalesce(tn / nullif(CAST(tn + fn AS DOUBLE), 0), 0.0) AS p0, coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0.0) AS r0,
             tn + fp AS s0, fn + tp AS s1, tn + fp + fn + tp AS n FROM c),
f AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0.0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0.0) AS f0,
             coalesce((tn + tp) / nullif(CAST(n AS DOUBLE), 0), 0.0) AS acc FROM m)
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM f
UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
UNION ALL SELECT 'weighted avg', coalesce((p0 * s0 + p1 * s1) / nullif(n, 0), 0.0), coalesce((r0 * s0 + r1 * s1) / nullif(n, 0), 0.0),
                 coalesce((f0 * s0 + f1 * s1) / nullif(n, 0), 0.0), n FROM f""")
def a30(spark, sf_dir):
    return EV.classification_report(T.quality(spark, sf_dir))


@register("A31_roc_auc", SC + _metric_sql("s", "(SELECT *, 0 AS prediction FROM scored)") + "\nSELECT auc FROM s_auc")
def a31(spark, sf_dir):
    return EV.roc_auc_table(T.scored(spark, sf_dir))


@register("A32_roc_curve", SC + """
, sc AS (SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
         FROM scored WHERE score IS NOT NULL GROUP BY 1),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM sc),
cum AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
               sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM sc)
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / nullif(CAST(P AS DOUBLE), 0) AS tpr,
       fp / nullif(CAST(N AS DOUBLE), 0) AS fpr FROM cum, tot""")
def a32(spark, sf_dir):
    return EV.roc_curve(T.scored(spark, sf_dir))


@register("A33_balanced_class_weights", R + """
, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE anomaly = 0) AS n0, count(*) FILTER (WHERE anomaly = 1) AS n1 FROM readings),
k AS (SELECT *, CAST((n0 > 0)::INTEGER + (n1 > 0)::INTEGER AS DOUBLE) AS k FROM c)
SELECT reading_id, anomaly, CASE WHEN anomaly = 1 THEN n / (k * n1) ELSE n / (k * n0) END AS weight FROM readings, k""")
def a33(spark, sf_dir):
    return balanced_weights(T.readings(spark, sf_dir), "anomaly").select("reading_id", "anomaly", "weight")


@register("A34_detected_rate", METRICS + "SELECT avg(prediction) * 100.0 AS detected_pct FROM thr")
def a34(spark, sf_dir):
    return detector_threshold(spark, sf_dir).select(EV.detected_rate().alias("detected_pct"))


@register("A35_column_means", HOURLY + """
SELECT avg(meter_reading) AS meter_reading, avg(hour("timestamp")) AS hour FROM readings_hourly""")
def a35(spark, sf_dir):
    h = T.readings_hourly(spark, sf_dir, stage=False).withColumn("hour", F.hour("timestamp"))
    return h.select(F.avg("meter_reading").alias("meter_reading"), F.avg("hour").alias("hour"))


@register("L9_best_model_pick", METRICS + """
SELECT arg_max(model, struct_pack(a := accuracy, m := model)) AS best_model, max(accuracy) AS best_accuracy
FROM metrics WHERE model IN ('threshold_p95', 'abs_zscore')""")
def l9(spark, sf_dir):
    m = _metrics(spark, sf_dir).where(F.col("model").isin("threshold_p95", "abs_zscore"))
    # ties on accuracy go to the larger model name, the same rule in both engines
    return m.select(F.max_by("model", F.struct("accuracy", "model")).alias("best_model"),
                    F.max("accuracy").alias("best_accuracy"))


@register("M11_evaluate_detector", METRICS + "SELECT * FROM metrics")
def m11(spark, sf_dir):
    """One metrics row per detector: accuracy, class-1 precision / recall /
    F1, ROC AUC (NULL for a single-class input), confusion cells."""
    return _metrics(spark, sf_dir)


@register("M13_results_summary_text", METRICS + """
SELECT array_to_string(list_transform(string_split(model, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS model_name,
       printf('%.3f', round_even(precision, 3)) AS precision_txt, printf('%.3f', round_even(recall, 3)) AS recall_txt,
       printf('%.3f', round_even(f1_score, 3)) AS f1_txt,
       CASE WHEN auc IS NULL THEN 'N/A' ELSE printf('%.3f', round_even(auc, 3)) END AS auc_txt
FROM metrics""")
def m13(spark, sf_dir):
    return EV.results_summary(_metrics(spark, sf_dir))


@register("M14_metrics_long", METRICS + """
, l AS (SELECT model, 'precision' AS metric, precision AS score FROM metrics
        UNION ALL SELECT model, 'recall', recall FROM metrics
        UNION ALL SELECT model, 'f1_score', f1_score FROM metrics
        UNION ALL SELECT model, 'auc', auc FROM metrics)
SELECT model, metric, score,
       array_to_string(list_transform(string_split(metric, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS metric_name,
       array_to_string(list_transform(string_split(model, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS model_name
FROM l WHERE score IS NOT NULL""")
def m14(spark, sf_dir):
    return EV.metrics_long(_metrics(spark, sf_dir))
