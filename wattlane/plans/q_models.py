"""Learned detectors.

Model outputs depend on random draws, so most queries here have no SQL
twin; tests/test_models.py states what must hold for each. Nothing is kept
between queries: each fits what it needs in its own session.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlane.operators.detect import forest as RF
from wattlane.operators.detect.autoencoder import fit_autoencoder
from wattlane.operators.detect.ball import fit_enclosing_ball
from wattlane.operators.detect.deepforest import DeepForest, fit_deep_forest
from wattlane.operators.detect.isolation import fit_isolation_forest
from wattlane.operators.detect.oneclass import fit_one_class
from wattlane.operators.detect.pca import fit_reconstruction, pca_view
from wattlane.operators.detect.scorer import DETECTORS, MORE, fit_all, load_all, predict, save_all, score, train_all
from wattlane.operators.evaluate import detected_rate, evaluate
from wattlane.operators.explore import numeric_columns
from wattlane.operators.quality import Scaler
from wattlane.plans.catalog import register
from wattlane.plans.pipelines import detector_frame, planted, supervised_frame
from wattlane.session import materialize, scratch_path
from wattlane.sources import tables as T


def _forest(spark, sf_dir, frame=None):
    f, feats = frame or supervised_frame(spark, sf_dir, "mean")
    train, val = f.where("is_validation = 0"), f.where("is_validation = 1")
    return RF.fit_random_forest(train, feats, "anomaly"), feats, val


@register("M1_random_forest_validation")
def m1(spark, sf_dir):
    """Random forest (100 trees, depth 10, sqrt, balanced, seed 42) on the
    stratified split; validation rows with prediction and P(anomaly)."""
    model, _, val = _forest(spark, sf_dir)
    return RF.predict_forest(model, val).select("reading_id", "anomaly", "prediction", "score")


@register("M1_random_forest_metrics")
def m1m(spark, sf_dir):
    return evaluate(materialize(m1(spark, sf_dir), "forest-scores"), "random_forest", "anomaly")


def _deep_forest(spark, sf_dir, frame=None):
    f, feats = frame or supervised_frame(spark, sf_dir, "mean")
    return fit_deep_forest(f.where("is_validation = 0"), feats, "reading_id", "anomaly"), f.where("is_validation = 1")


@register("M1_unlimited_forest_validation")
def m1u(spark, sf_dir):
    """Random forest without a depth limit (100 trees, sqrt, balanced) on
    the stratified split; validation rows with prediction and P(anomaly)."""
    model, val = _deep_forest(spark, sf_dir)
    return model.transform(val).select("reading_id", "anomaly", "prediction", "score")


@register("M2_feature_importance")
def m2(spark, sf_dir):
    model, feats, _ = _forest(spark, sf_dir)
    return RF.feature_importance(spark, model, feats)


@register("L3_top10_features")
def l3(spark, sf_dir):
    return m2(spark, sf_dir).orderBy(F.desc("importance"), "feature").limit(10)


@register("L4_feature_ranking")
def l4(spark, sf_dir):
    return m2(spark, sf_dir).orderBy(F.desc("importance"), "feature")


@register("P14_positive_class_probability")
def p14(spark, sf_dir):
    return m1(spark, sf_dir).select("reading_id", F.col("score").alias("p_anomaly"))


def _iso_fit(spark, sf_dir):
    train_n, test, feats = detector_frame(spark, sf_dir)
    return fit_isolation_forest(train_n, feats, "reading_id", 100, 256, 0.1), test


@register("M3_isolation_forest_fit")
def m3(spark, sf_dir):
    """Node table of the fitted forest (100 trees, 256 samples, height 8)."""
    return spark.createDataFrame(_iso_fit(spark, sf_dir)[0].nodes)


@register("M4_isolation_forest_score")
def m4(spark, sf_dir):
    """Test rows scored; anomaly when the score exceeds the training
    90th percentile (contamination 0.1)."""
    model, test = _iso_fit(spark, sf_dir)
    return score(model, test, "reading_id", "label")


@register("M5_isolation_forest_unlabelled")
def m5(spark, sf_dir):
    """Unsupervised: fit on all standardised readings, detected rate %."""
    r = T.readings(spark, sf_dir).withColumns({"hour": F.hour("timestamp"), "dow": F.weekday("timestamp")})
    cols = ["meter_reading", "hour", "dow"]
    z = materialize(Scaler.fit(r, cols).transform(r).select("reading_id", *cols), "scaled")
    model = fit_isolation_forest(z, cols, "reading_id", 100, 256, 0.1)
    return model.transform(z).select(detected_rate().alias("detected_pct"), F.count(F.lit(1)).alias("n_rows"))


@register("M7_one_class_rff")
def m7(spark, sf_dir):
    """One-class boundary on random Fourier features (nu = 0.1)."""
    train_n, test, feats = detector_frame(spark, sf_dir)
    return score(fit_one_class(train_n, feats, nu=0.1), test, "reading_id", "label")


@register("M7_enclosing_ball")
def m7b(spark, sf_dir):
    """One-class boundary of the RBF kernel itself: the smallest enclosing
    ball from a core set (nu = 0.1)."""
    train_n, test, feats = detector_frame(spark, sf_dir)
    return score(fit_enclosing_ball(train_n, feats, nu=0.1), test, "reading_id", "label")


@register("M8_autoencoder")
def m8a(spark, sf_dir):
    """Reconstruction error of a 64-32-64 autoencoder trained on the normal
    rows; anomaly above the 95th percentile of the scored rows (strict)."""
    train_n, test, feats = detector_frame(spark, sf_dir)
    return score(fit_autoencoder(train_n, feats), test, "reading_id", "label")


@register("M8_pca_reconstruction")
def m8(spark, sf_dir):
    """MSE of a 3-component linear reconstruction; anomaly above the 95th
    percentile of the scored rows (strict)."""
    train_n, test, feats = detector_frame(spark, sf_dir)
    return score(fit_reconstruction(train_n, feats, k=3), test, "reading_id", "label")


@register("M9_generic_scorer")
def m9(spark, sf_dir):
    """Every detector scored by name, with its own rule."""
    train_n, test, feats = detector_frame(spark, sf_dir)
    models = fit_all(train_n, feats, "reading_id")
    out = None
    for name in DETECTORS:
        s = predict(models, name, test, "reading_id").withColumn("model", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def _pca_rows(spark, sf_dir):
    from wattlane.functions.calendar import add_calendar
    r = add_calendar(T.readings(spark, sf_dir), minute=True)
    cols = [c for c in numeric_columns(r) if c != "reading_id"]
    return pca_view(r, cols, 2, keep=["reading_id", "anomaly"])


@register("M10_pca_view")
def m10(spark, sf_dir):
    """Two principal components of all standardised numeric columns
    (constant ones standardise to 0)."""
    return _pca_rows(spark, sf_dir)[0]


@register("M10_pca_explained_variance")
def m10v(spark, sf_dir):
    return _pca_rows(spark, sf_dir)[1]


def _all(spark, sf_dir):
    train_n, test, feats = detector_frame(spark, sf_dir)
    return train_all(train_n, test, feats, "reading_id", "label")


@register("M12_train_evaluate_all")
def m12(spark, sf_dir):
    """All four detectors trained on the normal rows of the same
    chronological split, evaluated on the test part against error events."""
    return _all(spark, sf_dir)[0]


@register("M12_planted_intervals")
def m12p(spark, sf_dir):
    """All four detectors on readings with planted intervals as truth:
    figures that say how well each finds them."""
    train_n, test, feats = detector_frame(spark, sf_dir, planted(spark, sf_dir))
    return train_all(train_n, test, feats, "reading_id", "label")[0]


def overlay(metrics, scored):
    """Predicted-positive rows of each detector with its F1."""
    out = None
    for name, s in scored.items():
        rows = s.where("prediction = 1").withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.join(metrics.select("model", "f1_score"), "model", "left")


@register("M15_prediction_overlay")
def m15(spark, sf_dir):
    """Predicted-positive test rows of each detector with its F1."""
    return overlay(*_all(spark, sf_dir))


_ROUND_TRIP_SQL = """
SELECT model, CAST(0 AS BIGINT) AS mismatches, (SELECT count(*) FROM events) AS n_rows
FROM (VALUES ('isolation_forest'), ('lof'), ('one_class_rff'), ('pca_reconstruction'), ('enclosing_ball'), ('autoencoder'),
             ('random_forest'), ('deep_forest')) t(model)"""


@register("S8_S9_model_persistence", _ROUND_TRIP_SQL)
def s8(spark, sf_dir):
    """All models saved, loaded and compared on every reading: rows whose
    score or prediction differs between the fitted and the loaded model."""
    from wattlane.sources.files import load_models, save_model
    train_n, _, feats = detector_frame(spark, sf_dir)
    every = materialize(_every_row(spark, sf_dir), "readings")
    names = [*DETECTORS, *MORE]
    models = fit_all(train_n, feats, "reading_id", names)
    loaded = load_all(spark, save_all(spark, models, scratch_path(spark, "models")))
    frame, feats = supervised_frame(spark, sf_dir, "mean")                # staged: both forests read the same rows
    forest, _, _ = _forest(spark, sf_dir, (frame, feats))
    path = save_model(forest, scratch_path(spark, "forest"))
    back = load_models(spark, {"rf": path, "absent": scratch_path(spark, "absent")})["rf"]
    pairs = {n: (predict(models, n, every, "reading_id"), predict(loaded, n, every, "reading_id")) for n in names}
    deep, _ = _deep_forest(spark, sf_dir, (frame, feats))
    at = deep.save(spark, scratch_path(spark, "deep-forest"))
    pairs["deep_forest"] = (deep.transform(frame), DeepForest.load(spark, at).transform(frame))
    pairs["random_forest"] = (RF.predict_forest(forest, frame), RF.predict_forest(back, frame))
    out = None
    for name, (a, b) in pairs.items():
        b = b.select("reading_id", F.col("score").alias("_s"), F.col("prediction").alias("_p"))
        differs = ~(F.col("score").eqNullSafe(F.col("_s")) & F.col("prediction").eqNullSafe(F.col("_p")))
        row = a.join(b, "reading_id").select(F.lit(name).alias("model"), F.count_if(differs).alias("mismatches"), F.count(F.lit(1)).alias("n_rows"))
        out = row if out is None else out.unionByName(row)
    return out


def _every_row(spark, sf_dir):
    """All labelled readings with the detectors' features, unscaled."""
    from wattlane.operators.quality import fill_zero
    from wattlane.plans.pipelines import DETECTOR_FEATURES, additional_features
    return fill_zero(additional_features(T.labelled(spark, sf_dir)), list(DETECTOR_FEATURES))


_DIM = 64


def _vec_frame(spark, sf_dir):
    v = T.vectors(spark, sf_dir)
    return v.select("vec_id", "label", *[F.col("embedding")[i].alias(f"e{i}") for i in range(_DIM)])


def _dist_sql(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(range(1, {_DIM + 1}), lambda i: ({a}.e[i] - {b}.e[i]) * ({a}.e[i] - {b}.e[i]))))"


_LOF_SQL = f"""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
tr AS (SELECT * FROM v WHERE label <> 9),
d_tr AS (SELECT a.vec_id AS q, b.vec_id AS r, {_dist_sql('a', 'b')} AS dist FROM tr a, tr b WHERE a.vec_id <> b.vec_id),
nn_tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, r) AS rk FROM d_tr) WHERE rk <= 20),
kd AS (SELECT q AS id, dist AS kdist FROM nn_tr WHERE rk = 20),
lrd AS (SELECT n.q AS id, 1.0 / (avg(greatest(n.dist, kd.kdist)) + 1e-10) AS lrd FROM nn_tr n JOIN kd ON n.r = kd.id GROUP BY 1),
lof_tr AS (SELECT n.q, avg(l2.lrd) / any_value(l1.lrd) AS lof
           FROM nn_tr n JOIN lrd l2 ON n.r = l2.id JOIN lrd l1 ON n.q = l1.id GROUP BY 1),
thr AS (SELECT quantile_cont(lof, 0.9) AS t FROM lof_tr),
d_te AS (SELECT a.vec_id AS q, b.vec_id AS r, {_dist_sql('a', 'b')} AS dist FROM v a, tr b),
nn_te AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, r) AS rk FROM d_te) WHERE rk <= 20),
s AS (SELECT n.q AS vec_id, avg(l.lrd) / (1.0 / (avg(greatest(n.dist, kd.kdist)) + 1e-10)) AS lof
      FROM nn_te n JOIN kd ON n.r = kd.id JOIN lrd l ON n.r = l.id GROUP BY 1)
SELECT vec_id, round(lof - t, 6) AS score, CAST(lof > t AS INTEGER) AS prediction FROM s, thr"""


@register("M6_local_outlier_factor", _LOF_SQL)
def m6(spark, sf_dir):
    """LOF novelty detection (k = 20, contamination 0.1): trained on the
    embeddings of clusters 0-8, every embedding scored as new data; exact
    neighbours (ties by key). The SQL twin is the brute-force definition."""
    from wattlane.operators.detect.lof import fit_lof
    v = _vec_frame(spark, sf_dir)
    feats = [f"e{i}" for i in range(_DIM)]
    model = fit_lof(v.where(F.col("label") != 9), feats, "vec_id", k=20, contamination=0.1)
    out = model.transform(v)
    return out.select("vec_id", F.round("score", 6).alias("score"), "prediction")


@register("S9_load_models_skip_absent", """
SELECT reading_id, 'scaler' AS loaded, round((meter_reading - (SELECT avg(CASE WHEN isnan(value) THEN NULL ELSE value END) FROM events))
       / (SELECT stddev_pop(CASE WHEN isnan(value) THEN NULL ELSE value END) FROM events), 6) + 0.0 AS z
FROM (SELECT event_id AS reading_id, CASE WHEN isnan(value) THEN NULL ELSE value END AS meter_reading FROM events)""")
def s9(spark, sf_dir):
    """The fitted scaler saved and loaded from a folder in which every other
    model is absent (skipped), applied to the readings."""
    r = T.readings(spark, sf_dir)
    path = save_all(spark, {"scaler": Scaler.fit(r, ["meter_reading"])}, scratch_path(spark, "models"))
    loaded = load_all(spark, path)
    z = loaded["scaler"].transform(r)
    return z.select("reading_id", F.lit(",".join(sorted(loaded))).alias("loaded"), (F.round("meter_reading", 6) + F.lit(0.0)).alias("z"))
