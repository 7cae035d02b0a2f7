"""One interface over all detectors: fit on training rows, score by model
name with an optional threshold, save and load, and the train-and-evaluate
loop. Higher score = more anomalous. Scores are staged once per detector;
thresholds, metrics and curves read the staged scores.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlane.operators.detect.autoencoder import Autoencoder, fit_autoencoder
from wattlane.operators.detect.ball import EnclosingBall, fit_enclosing_ball
from wattlane.operators.detect.isolation import IsolationForestModel, fit_isolation_forest
from wattlane.operators.detect.lof import LOFModel, fit_lof
from wattlane.operators.detect.oneclass import OneClassRFF, fit_one_class
from wattlane.operators.detect.pca import PCAReconstruction, fit_reconstruction
from wattlane.operators.evaluate import evaluate
from wattlane.operators.quality import Scaler
from wattlane.session import materialize, path_exists

DETECTORS: dict[str, Callable] = {
    "isolation_forest": lambda train, features, key: fit_isolation_forest(train, features, key, n_trees=100, max_samples=256, contamination=0.1),
    "lof": lambda train, features, key: fit_lof(train, features, key, k=20, contamination=0.1),
    "one_class_rff": lambda train, features, key: fit_one_class(train, features, nu=0.1),
    "pca_reconstruction": lambda train, features, key: fit_reconstruction(train, features, k=3),
}

# Detectors by name beside the suite: the kernel's own ball and a non-linear
# reconstruction, which take more passes than the two they refine.
MORE: dict[str, Callable] = {
    "enclosing_ball": lambda train, features, key: fit_enclosing_ball(train, features, nu=0.1),
    "autoencoder": lambda train, features, key: fit_autoencoder(train, features),
}

KINDS = {"isolation_forest": IsolationForestModel, "lof": LOFModel, "one_class_rff": OneClassRFF,
         "pca_reconstruction": PCAReconstruction, "enclosing_ball": EnclosingBall, "autoencoder": Autoencoder, "scaler": Scaler}


def fit_all(train: DataFrame, features: Sequence[str], key: str, names: Sequence[str] | None = None) -> dict:
    """name -> fitted detector (the suite's, or those named)."""
    train = materialize(train.select(key, *features), "detector-train")
    return {n: (DETECTORS | MORE)[n](train, list(features), key) for n in names or DETECTORS}


def predict(models: dict, name: str, df: DataFrame, key: str, label: str | None = "label",
            threshold: float | None = None) -> DataFrame:
    """key, [label,] score, prediction of the named model (staged). Without
    a threshold the model's own rule decides; with one, score > threshold."""
    if name not in models:
        raise KeyError(f"no model named {name!r}; there are {sorted(models)}")
    out = models[name].transform(df)
    if threshold is not None:
        out = out.withColumn("prediction", (F.col("score") > F.lit(float(threshold))).cast("int"))
    cols = [key] + ([label] if label and label in df.columns else []) + ["score", "prediction"]
    return materialize(out.select(*cols), f"scored-{name}")


def score(model, df: DataFrame, key: str, label: str | None = "label") -> DataFrame:
    """``predict`` for one model at hand."""
    return predict({"model": model}, "model", df, key, label)


def train_all(train_normal: DataFrame, test: DataFrame, features: Sequence[str], key: str,
              label: str = "label", names: Sequence[str] | None = None):
    """Fit each detector on the normal training rows, score the test rows,
    evaluate. Returns (metrics DataFrame, {name: scored DataFrame})."""
    models = fit_all(train_normal, features, key, names)
    scored = {n: predict(models, n, test, key, label) for n in models}
    metrics = None
    for n, s in scored.items():
        m = evaluate(s, n, label)
        metrics = m if metrics is None else metrics.unionByName(m)
    return metrics, scored


def save_all(spark: SparkSession, models: dict, path: str) -> str:
    """Every model (and scaler) under ``path/<name>``."""
    for name, model in models.items():
        model.save(spark, f"{path}/{name}")
    return path


def load_all(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> dict:
    """The models that are there; absent ones are skipped."""
    return {n: KINDS[n].load(spark, f"{path}/{n}") for n in names or KINDS if path_exists(spark, f"{path}/{n}")}
