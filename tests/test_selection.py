"""Selection equals sorting: quantiles, split borders; no exchange of rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlane.operators.ordering import quantiles
from wattlane.operators.selection import selected_quantiles, smallest
from wattlane.operators.split import group_fraction_sample, hash_order, stratified_split

PROBS = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
NAMES = [f"q{i}" for i in range(len(PROBS))]


def values(kind, n):
    g = np.random.default_rng(n)
    if kind == "ties":
        return g.integers(0, 3, n).astype(float)
    if kind == "one":
        return np.full(n, 2.5)
    if kind == "tails":
        return np.concatenate([g.normal(size=n - 2) * 10.0 ** g.integers(-300, 300, n - 2), [1e308, -1e308]])
    if kind == "hot":
        return np.concatenate([np.zeros(n // 3), g.normal(size=n - n // 3)])
    return g.normal(size=n)


def by_sorting(v):
    v = np.sort(v)
    out = []
    for p in PROBS:
        h = p * (len(v) - 1)
        a, b = v[int(np.floor(h))], v[int(np.ceil(h))]
        out.append(a + (h - np.floor(h)) * (b - a))
    return out


@pytest.mark.parametrize("kind", ["ties", "one", "tails", "hot", "plain"])
@pytest.mark.parametrize("n, accuracy, few", [(4000, 60, 30), (5, 60, 1)])
def test_quantiles_equal_sorting(spark, kind, n, accuracy, few):
    v = values(kind, n)
    df = spark.createDataFrame([(float(x),) for x in v], "_v double").repartition(5)
    row = selected_quantiles(df, [], PROBS, NAMES, accuracy, few).collect()
    assert len(row) == 1 and np.allclose(list(row[0]), by_sorting(v), rtol=1e-12, atol=0)


def test_keys_nulls_and_kinds(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, rng.randint(-5, 5), rng.randint(0, 1000)])) for _ in range(3000)]
    rows += [("lonely", 7, 3), ("nothing", 1, None)]
    df = spark.createDataFrame(rows, "k string, l int, v long").repartition(6)
    probs = [0.1, 0.5, 0.9]
    hot = {(r.k, r.l): (r.q10, r.q50, r.q90) for r in quantiles(df, "v", probs, ["k", "l"], limit=0).collect()}
    cold = {(r.k, r.l): (r.q10, r.q50, r.q90) for r in quantiles(df, "v", probs, ["k", "l"]).collect()}
    assert hot.keys() == cold.keys() and ("nothing", 1) not in hot and (None, None) in hot
    for k in hot:
        assert np.allclose(hot[k], cold[k], rtol=1e-12)


def test_empty_and_nan(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert quantiles(df, "v", [0.5], ["k"], limit=0).count() == 0
    nan = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 2.0)], "k string, v double")
    assert quantiles(nan, "v", [0.5], ["k"], limit=0).first().q50 == 2.0


def test_rows_are_not_exchanged(spark):
    """Every exchange below the result carries partial aggregates or the few
    values of a bracket."""
    df = spark.range(20_000).select((F.col("id") % 7).alias("k"), F.rand(1).alias("_v"))
    out = selected_quantiles(df, ["k"], [0.5], ["m"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" in plan
    split = stratified_split(df.withColumn("id", F.monotonically_increasing_id()), "k", "id")
    split.collect()
    plan = split._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "rangepartitioning" not in final and "SortMergeJoin" not in final and "BroadcastHashJoin" in final


def md5(key, seed=42):
    return hashlib.md5(f"{key}{seed}".encode()).hexdigest()


@pytest.mark.parametrize("few", [10_000, 3])
def test_smallest_equals_sorting(spark, few):
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", "x", "x", "y", None])) for i in range(4000)] + [(9999, "z")]
    take = {"x": 777, "y": 0, None: 10_000, "z": 1}
    df = spark.createDataFrame(rows, "id long, g string").repartition(5)
    t = spark.createDataFrame(list(take.items()), "g string, _take long")
    got = {r.id for r in smallest(df, "g", hash_order("id"), "id", t, "in", few).where("in").collect()}
    want = set()
    for g, n in take.items():
        want |= {i for _, i in sorted((md5(i), i) for i, h in rows if h == g)[:n]}
    assert got == want


def test_split_and_sample(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 0, 1, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, label int").repartition(4)
    out = stratified_split(df, "label", "id", 0.2)
    assert out.columns == ["id", "label", "is_validation"] and out.count() == 3000
    got = {r.id for r in out.where("is_validation = 1").collect()}
    sample = {r.id for r in group_fraction_sample(df, "label", "id", 0.13).collect()}
    for g in (0, 1, None):
        ids = [i for _, i in sorted((md5(i), i) for i, h in rows if h == g)]
        assert got & set(ids) == set(ids[:int(0.2 * len(ids) + 0.5)])
        assert sample & set(ids) == set(ids[:int(len(ids) * 0.13)])
    assert stratified_split(df.limit(0), "label", "id").count() == 0
