"""Isolation forest (Liu, Ting & Zhou, 2008) on Spark.

fit:
  * one pass with one hash per row keeps the rows under trees x 3 x 256 / n;
    only those draw a hash per tree and enter a tree's candidate set with
    the remaining probability (so each tree takes a row with probability
    about 3 x 256 / n, and no explode of the whole table happens); each
    tree keeps its 256 smallest hashes (a window over tree id: 100 groups
    of ~768 rows, whatever n is);
  * ``groupBy(tree).applyInPandas`` grows one tree per group (random
    non-constant feature, uniform split between min and max, height limit
    ceil(log2(256)) = 8) and returns the tree as node rows;
  * the node table is bounded (trees x 511 rows), so it is the one thing
    brought to the driver and broadcast for scoring.
score: an Arrow ``pandas_udf`` walks all trees for a batch of rows at
  once; anomaly score = 2 ** (-E[h(x)] / c(psi)). The decision threshold
  is the (1 - contamination) quantile of the training scores.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StructField, StructType)

from wattlane.operators.ordering import quantiles
from wattlane.session import materialize, ship_package
from wattlane.sources.files import load_meta, save_meta

EULER = 0.5772156649

NODE_SCHEMA = StructType([
    StructField("tree", IntegerType()), StructField("node", IntegerType()),
    StructField("feature", IntegerType()), StructField("threshold", DoubleType()),
    StructField("left", IntegerType()), StructField("right", IntegerType()),
    StructField("size", LongType()), StructField("depth", IntegerType())])


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(pdf: pd.DataFrame, features: Sequence[str], height: int, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    rng = np.random.default_rng([seed, tree])
    X = pdf[list(features)].to_numpy(dtype=float)
    rows = []

    def build(idx: np.ndarray, depth: int) -> int:
        node = len(rows)
        rows.append(None)
        sub = X[idx]
        if depth >= height or len(idx) <= 1:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        varying = np.flatnonzero(hi > lo)
        if len(varying) == 0:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        q = int(rng.choice(varying))
        p = float(rng.uniform(lo[q], hi[q]))
        go_left = sub[:, q] < p
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        rows[node] = (tree, node, q, p, left, right, len(idx), depth)
        return node

    build(np.arange(len(X)), 0)
    return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])


def _unit_hash(key: str, tree, seed: int):
    """Uniform in [0, 1) from (key, tree, seed)."""
    return F.pmod(F.xxhash64(F.col(key), tree, F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


class IsolationForestModel:
    def __init__(self, nodes: pd.DataFrame, features: Sequence[str], psi: int,
                 threshold: float | None = None, contamination: float = 0.1):
        self.nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        self.features = list(features)
        self.psi = int(psi)
        self.threshold = threshold
        self.contamination = contamination

    # -- scoring -------------------------------------------------------------
    def _arrays(self):
        trees = []
        for _, t in self.nodes.groupby("tree", sort=True):
            size = t["size"].to_numpy()
            leaf_len = t["depth"].to_numpy() + np.array([c_factor(s) for s in size])
            trees.append((t["feature"].to_numpy(), t["threshold"].to_numpy(), t["left"].to_numpy(),
                          t["right"].to_numpy(), leaf_len))
        return trees

    def score_column(self, spark: SparkSession):
        """A pandas_udf: feature columns -> anomaly score in (0, 1)."""
        ship_package(spark)
        bc = spark.sparkContext.broadcast(self._arrays())
        cn = c_factor(self.psi)

        @F.pandas_udf(DoubleType())
        def iso_score(*cols: pd.Series) -> pd.Series:
            X = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            total = np.zeros(len(X))
            for feat, thr, left, right, leaf_len in bc.value:
                idx = np.zeros(len(X), dtype=np.int64)
                while True:
                    f = feat[idx]
                    inner = f >= 0
                    if not inner.any():
                        break
                    rows = np.flatnonzero(inner)
                    go_left = X[rows, f[rows]] < thr[idx[rows]]
                    idx[rows] = np.where(go_left, left[idx[rows]], right[idx[rows]])
                total += leaf_len[idx]
            mean_h = total / len(bc.value)
            return pd.Series(np.power(2.0, -mean_h / cn) if cn > 0 else np.full(len(X), 0.5))

        return iso_score

    def transform(self, df: DataFrame, score: str = "score", prediction: str = "prediction") -> DataFrame:
        spark = df.sparkSession
        out = df.withColumn(score, self.score_column(spark)(*[F.col(c).cast("double") for c in self.features]))
        if self.threshold is not None:
            out = out.withColumn(prediction, (F.col(score) > F.lit(self.threshold)).cast("int"))
        return out

    # -- persistence -----------------------------------------------------------
    def save(self, spark: SparkSession, path: str) -> str:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
        return save_meta(spark, path, {"features": self.features, "psi": self.psi, "threshold": self.threshold,
                                       "contamination": self.contamination})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsolationForestModel":
        meta = load_meta(spark, path)
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        return cls(nodes, meta["features"], meta["psi"], meta["threshold"], meta["contamination"])


def fit_isolation_forest(df: DataFrame, features: Sequence[str], key: str, n_trees: int = 100,
                         max_samples: int = 256, contamination: float | None = 0.1,
                         seed: int = 42) -> IsolationForestModel:
    """Fit on ``df`` (no NULLs in ``features``; ``key`` unique)."""
    spark = df.sparkSession
    ship_package(spark)
    n = df.count()
    psi = min(max_samples, n)
    rate = min(1.0, 3.0 * psi / max(n, 1))
    height = max(1, math.ceil(math.log2(max(psi, 2))))
    # One hash per row first: only rows under trees x rate can enter any
    # tree, and only those draw their per-tree hashes (at rate / pre), so
    # each tree still takes each row with probability ``rate``.
    pre = min(1.0, n_trees * rate)
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                     lambda t: _unit_hash(key, t, seed) < F.lit(rate / pre))
    cand = (df.where(_unit_hash(key, F.lit(-1), seed) < F.lit(pre))
            .select(key, *[F.col(c).cast("double").alias(c) for c in features])
            .withColumn("tree", F.explode(trees))
            .withColumn("_u", _unit_hash(key, F.col("tree"), seed)))
    from pyspark.sql import Window
    w = Window.partitionBy("tree").orderBy("_u", key)
    sample = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi)
    nodes = (sample.groupBy("tree")
             .applyInPandas(lambda pdf: _grow(pdf, features, height, seed), NODE_SCHEMA)
             .toPandas())
    model = IsolationForestModel(nodes, features, psi, None, contamination or 0.0)
    if contamination:
        # every row goes through the trees once; the quantile reads scores
        scored = materialize(model.transform(df.select(*features)).select("score"), "iso-scores")
        model.threshold = float(quantiles(scored, "score", [1.0 - contamination], [], ["t"])
                                .first()["t"])
    return model
