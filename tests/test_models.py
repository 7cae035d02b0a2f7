"""What must hold for the queries without a SQL twin, and for the detectors."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import ROOT, SF_SMALL
from wattlane.operators.detect import isolation, scorer
from wattlane.operators.detect.knn import KnnIndex
from wattlane.operators.detect.lof import LOFModel, fit_lof

DETECTORS = {"isolation_forest", "lof", "one_class_rff", "pca_reconstruction"}
N_TEST, N_ALL = 200, 1000  # sf0.001: 1,000 readings, 20 % in the test part


def unit(rows, col="score"):
    return all(0 <= r[col] <= 1 for r in rows)


def stacked(rows):
    return {r["model"] for r in rows} == DETECTORS and len(rows) == 4 * N_TEST and all(r["prediction"] in (0, 1) for r in rows)


def ranking(rows):
    v = [r["importance"] for r in rows]
    return v == sorted(v, reverse=True) and all(x >= 0 for x in v)


def metrics(rows, names):
    return ({r["model"] for r in rows} == names and all(r["tn"] + r["fp"] + r["fn"] + r["tp"] > 0 for r in rows)
            and all(abs(r["accuracy"] - (r["tn"] + r["tp"]) / (r["tn"] + r["fp"] + r["fn"] + r["tp"])) < 1e-12 for r in rows) and unit(rows, "auc"))


def roc(rows):
    by = {}
    for r in rows:
        by.setdefault(r["model"], []).append(r)
    for points in by.values():
        points.sort(key=lambda r: -r["threshold"])
        t = [(r["tpr"], r["fpr"]) for r in points]
        if t != sorted(t) or t[-1] != (1.0, 1.0):
            return False
    return set(by) == DETECTORS


def contamination(rows):
    return 0.02 <= np.mean([r["prediction"] for r in rows]) <= 0.3


PROPERTIES = {
    "M1_random_forest_validation": lambda r: unit(r) and all(x["prediction"] == (x["score"] > 0.5) for x in r if abs(x["score"] - 0.5) > 1e-9),
    "M1_random_forest_metrics": lambda r: metrics(r, {"random_forest"}),
    "M2_feature_importance": lambda r: abs(sum(x["importance"] for x in r) - 1) < 1e-9,
    "L3_top10_features": lambda r: len(r) == 10 and ranking(r),
    "L4_feature_ranking": lambda r: ranking(r) and abs(sum(x["importance"] for x in r) - 1) < 1e-9,
    "P14_positive_class_probability": lambda r: unit(r, "p_anomaly") and len(r) > 100,
    "M1_unlimited_forest_validation": lambda r: unit(r) and len(r) > 100 and all(x["prediction"] == (x["score"] > 0.5) for x in r),
    "M3_isolation_forest_fit": lambda r: len({x["tree"] for x in r}) == 100 and all(x["depth"] <= 8 for x in r),
    "M4_isolation_forest_score": lambda r: len(r) == N_TEST and unit(r) and contamination(r),
    "M5_isolation_forest_unlabelled": lambda r: r[0]["n_rows"] == N_ALL and 5 <= r[0]["detected_pct"] <= 10.1,
    "M7_one_class_rff": lambda r: len(r) == N_TEST and contamination(r),
    "M7_enclosing_ball": lambda r: len(r) == N_TEST and contamination(r) and all(-1 <= x["score"] < 0 for x in r),
    "M8_autoencoder": lambda r: len(r) == N_TEST and sum(x["prediction"] for x in r) == 10 and all(x["score"] >= 0 for x in r),
    "M8_pca_reconstruction": lambda r: len(r) == N_TEST and sum(x["prediction"] for x in r) == 10 and all(x["score"] >= 0 for x in r),
    "M9_generic_scorer": stacked,
    "M10_pca_view": lambda r: len(r) == N_ALL and abs(np.mean([x["pc1"] for x in r])) < 1e-6,
    "M10_pca_explained_variance": lambda r: len(r) == 2 and 0 < sum(x["explained_ratio"] for x in r) <= 1,
    "M12_train_evaluate_all": lambda r: metrics(r, DETECTORS),
    # what is planted is found: a shuffled label gives an AUC of about 0.5
    "M12_planted_intervals": lambda r: metrics(r, DETECTORS) and all(x["auc"] > 0.7 for x in r) and all(x["tp"] + x["fn"] > 10 for x in r),
    "M15_prediction_overlay": lambda r: {x["model"] for x in r} <= DETECTORS and all(x["prediction"] == 1 and 0 <= x["f1_score"] <= 1 for x in r),
    "C8_train_detection_models": lambda r: metrics(r, {"random_forest", "isolation_forest"}),
    "C9_pca_view": lambda r: len(r) == N_ALL and 0 < r[0]["pc2_ratio"] <= r[0]["pc1_ratio"] <= 1,
    "C13_modelling_section": lambda r: metrics(r, {"random_forest", "isolation_forest"}) and sum(x["is_best"] for x in r) == 1,
    "C13_top10_importances": lambda r: len(r) == 10 and ranking(r),
    "C14_results_section": lambda r: {x["model"] for x in r} == {"random_forest", "isolation_forest"} and all(0 <= x["detected_pct"] <= 100 for x in r),
    "C14_probability_sample": lambda r: 100 < len(r) <= 1000 and unit(r, "p_anomaly"),
    "C15_detector_suite_summary": lambda r: len(r) == 4,
    "C20_model_comparison_roc": roc,
    "C20_metrics_long": lambda r: {(x["model"], x["metric"]) for x in r} == {(m, k) for m in DETECTORS for k in ("precision", "recall", "f1_score", "auc")},
    "C21_detection_dashboard": lambda r: len(r) == 200 and sum(x["count"] for x in r) == 4 * N_TEST,
    "C21_prediction_overlay": lambda r: {x["model"] for x in r} <= DETECTORS and all(x["prediction"] == 1 for x in r),
}


@pytest.mark.parametrize("name", sorted(PROPERTIES))
def test_property(spark, name):
    assert PROPERTIES[name](E.queries()[name](spark, SF_SMALL).collect())


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"f{j} double" for j in range(x.shape[1])))


def brute(x, q, k, own=None):
    d = np.sqrt(((x - q) ** 2).sum(1))
    if own is not None:
        d[own] = np.inf
    return np.lexsort((np.arange(len(x)), d))[:k].tolist()


@pytest.mark.parametrize("block", [4096, 100])
def test_knn_is_exact_and_prunes(spark, block):
    """20,000 clustered rows x 10: far fewer than all pairs are measured."""
    g = np.random.default_rng(0)
    n = 20_000 if block == 4096 else 1500
    x = g.normal(size=(60, 10))[g.integers(0, 60, n)] * 5 + g.normal(size=(n, 10)) * 0.3
    x[n // 2:n // 2 + 40] = x[0]  # ties
    feats = [f"f{j}" for j in range(10)]
    index = KnnIndex(frame(spark, x), "id", feats, block=block)
    got = {}
    for r in index.search(frame(spark, x), 20, exclude_self=True).orderBy("qk", "rank").collect():
        got.setdefault(r["qk"], []).append(r["rk"])
    assert len(got) == n and index.pairs < 0.1 * n * n
    for i in g.integers(0, n, 150):
        assert got[i] == brute(x, x[i], 20, i)


@pytest.mark.parametrize("n", [1, 2, 5, 15, 21])
def test_lof_with_few_rows(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 3))
    feats = ["f0", "f1", "f2"]
    model = fit_lof(frame(spark, x), feats, "id", k=20)
    got = model.transform(frame(spark, np.vstack([x, [[9.0, 9.0, 9.0]]]))).collect()
    assert len(got) == n + 1 and all(r["prediction"] in (0, 1) for r in got)
    if n > 2:
        assert max(got, key=lambda r: r["score"])["id"] == n


def test_suite_finds_what_is_planted_and_nothing_in_shuffled_labels(spark):
    """Each detector, by metrics, overlay and summary; a dropped detector or
    a shuffled label shows."""
    from wattlane.operators.evaluate import results_summary
    from wattlane.plans.q_models import overlay
    g = np.random.default_rng(9)
    feats = ["f0", "f1", "f2", "f3"]
    x = np.vstack([g.normal(size=(360, 4)), g.normal(size=(40, 4)) + 7])
    y = np.repeat([0, 1], [360, 40])
    labels = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(y, g.permutation(y)))], "id long, label int, shuffled int")
    train = frame(spark, g.normal(size=(500, 4)))
    test = frame(spark, x).join(labels, "id")
    m, scored = scorer.train_all(train, test, feats, "id")
    rows = {r["model"]: r for r in m.collect()}
    assert set(rows) == DETECTORS and all(r["auc"] > 0.99 and r["recall"] > 0.4 for r in rows.values())
    assert len(results_summary(m).collect()) == len(DETECTORS)
    over = overlay(m, scored).collect()
    assert {r["model"] for r in over} == DETECTORS
    for name in DETECTORS:
        mine = [r for r in over if r["model"] == name]
        assert np.mean([r["label"] for r in mine]) > 0.4 and all(r["f1_score"] == rows[name]["f1_score"] for r in mine)
    from wattlane.operators.evaluate import evaluate
    for name, s in scored.items():
        mixed = evaluate(s.drop("label").join(labels.select("id", F.col("shuffled").alias("label")), "id"), name).first()
        assert 0.35 < mixed["auc"] < 0.65


def test_models_round_trip_and_threshold(spark):
    from wattlane.session import scratch_path
    g = np.random.default_rng(1)
    feats = ["f0", "f1", "f2", "f3"]
    train, test = frame(spark, g.normal(size=(300, 4))), frame(spark, np.vstack([g.normal(size=(50, 4)), np.full((1, 4), 8.0)]))
    models = scorer.fit_all(train, feats, "id")
    assert set(models) == DETECTORS
    back = scorer.load_all(spark, scorer.save_all(spark, models, scratch_path(spark, "m")))
    assert set(back) == DETECTORS and isinstance(back["lof"], LOFModel)
    for name in DETECTORS:
        a, b = (sorted(map(tuple, scorer.predict(m, name, test, "id").collect())) for m in (models, back))
        assert a == b
        top = max(a, key=lambda r: r[1])
        assert top[0] == 50  # the far point
        cut = scorer.predict(models, name, test, "id", threshold=top[1] - 1e-9).collect()
        assert [r["id"] for r in cut if r["prediction"]] == [50]
    with pytest.raises(KeyError):
        scorer.predict(models, "absent", test, "id")
    assert scorer.load_all(spark, scratch_path(spark, "nothing")) == {}


def test_each_row_is_scored_once(spark, monkeypatch):
    """Rows that pass through the forest's UDF, by an accumulator."""
    seen = spark.sparkContext.accumulator(0)
    real = isolation.IsolationForestModel.score_column

    def counted(self, session):
        inner = real(self, session)

        def column(*cols):
            def count(*c):
                seen.add(len(c[0]))
                return inner.func(*c)
            count.__annotations__ = {}
            return F.pandas_udf(count, "double", F.PandasUDFType.SCALAR)(*cols)
        return column
    monkeypatch.setattr(isolation.IsolationForestModel, "score_column", counted)
    x = np.random.default_rng(2).normal(size=(500, 3))
    df = frame(spark, x).withColumn("label", (F.col("f0") > 1).cast("int"))
    model = isolation.fit_isolation_forest(df, ["f0", "f1", "f2"], "id")
    assert seen.value == 500
    scored = scorer.score(model, df, "id")
    from wattlane.operators.evaluate import evaluate, roc_curve
    evaluate(scored, "m").collect()
    roc_curve(scored).collect()
    assert seen.value == 1000


def test_queries_survive_a_new_session():
    """No state of one session is kept for the next."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
import __spark_entry__ as E
from wattlane.session import get_spark
for _ in range(2):
    spark = get_spark("local[4]", 4)
    for q in ("M4_isolation_forest_score", "M12_train_evaluate_all"):
        assert E.queries()[q](spark, {SF_SMALL!r}).count() > 0
    spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=600, capture_output=True)
