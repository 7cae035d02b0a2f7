import numpy as np
import pytest

from wattlane.llm import metric
from wattlane.llm.components import roots


def brute(ids, x, threshold=0.9):
    ok = np.isfinite(x).all(1) & (np.abs(x).sum(1) > 0)
    u = np.where(ok[:, None], x, 0)
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    link = s >= threshold
    o = np.argsort(ids)
    rank = np.argsort(o)
    i, j = np.nonzero(link)
    root = roots(len(ids), rank[i], rank[j])
    return {int(ids[k]): (int(link[k].sum()), int(ids[o[root[rank[k]]]])) for k in range(len(ids))}


def data():
    g = np.random.default_rng(1)
    c = g.normal(size=(25, 8))
    x = np.concatenate([c[g.integers(0, 25, 500)] + g.normal(size=(500, 8)) * g.choice([.01, .1, .3], 500)[:, None],
                        np.repeat(c[:1], 150, 0), 3 * c[:5]])
    return g.permutation(len(x)) * 3, x


@pytest.mark.parametrize("block", [8192, 60])
def test_equals_brute_force(spark, block):
    ids, x = data()
    df = spark.createDataFrame([(int(i), v.tolist(), "a") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, rep string")
    got = metric.range_join(df, block=block).collect()
    want = brute(ids, x)
    assert {r[0]: (r[1], r[2]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_pivot_cells_separate_and_agree(spark):
    """Tight far clusters: several pivots are chosen, most pairs pruned."""
    g = np.random.default_rng(3)
    c = np.eye(16)[g.integers(0, 16, 1500)]
    x = c + g.normal(size=(1500, 16)) * 0.03
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    p = metric.pick_pivots(metric.distinct_vectors(df), float(np.sqrt(0.2)))
    assert len(p) >= 16
    u = metric.unit_rows(x)
    home, present = metric.cells_of(u, p, float(np.sqrt(0.2)))
    assert (np.bincount(home, minlength=len(p)) * present.sum(0)).sum() < 0.3 * len(x) ** 2
    assert {r[0]: (r[1], r[2]) for r in metric.range_join(df).collect()} == brute(np.arange(1500), x)


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]),
            (7, [1.0, None]), (8, [1.0]), (None, [1.0, 0.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (10, []), (11, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r[0] or 0), r[1], r[2]) for r in metric.range_join(df).collect())
    assert got == sorted([(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (0, 0, None),
                          (9, 1, 9), (9, 1, 9), (10, 0, 10), (11, 0, 11)])
    assert metric.range_join(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8192, 40])
def test_every_length_links_within_itself(spark, block):
    g = np.random.default_rng(6)
    rows, want = [], {}
    for d, n in ((6, 120), (4, 90), (1, 20), (9, 1)):
        x = np.abs(g.normal(size=(n, d))) * g.choice([-1, 1], (n, 1))
        ids = np.arange(len(rows), len(rows) + n)
        rows += [(int(i), v.tolist()) for i, v in zip(ids, x)]
        want |= brute(ids, x)
    got = metric.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), block=block).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want
    assert all(sum(r[1] for r in got if lo <= r[0] < hi) > 0 for lo, hi in ((0, 120), (120, 210), (210, 230)))


def test_threshold_in_double(spark):
    """Vectors a hair above and below the threshold."""
    rows = [(0, [1.0, 0.0])] + [(i + 1, [0.9 + d, float(np.sqrt(1 - (0.9 + d) ** 2))]) for i, d in enumerate((1e-9, -1e-9))]
    got = {r[0]: r[1] for r in metric.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: 1, 1: 2, 2: 1}
