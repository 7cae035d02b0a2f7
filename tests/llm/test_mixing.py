import numpy as np
import pytest

from wattlane.llm import mixing


def targets(sizes):
    """Resharing by hand: sizes by source in order, null last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        share = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / share > 3 * sizes[s] + 1e-12} if share else set()
        if not over:
            return out | {s: left * w[s] / share for s in open_}
        out |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over


def rows(n=900):
    rng = np.random.default_rng(1)
    out = [(i, " ".join(["w"] * int(rng.lognormal(3, 1))), f"s{min(int(rng.exponential(1.5)), 6)}") for i in range(n)]
    return out + [(9000, "a b c", None), (9001, None, "s0"), (9002, "", "zz"), (None, "q " * 9, "s1"), (None, "q " * 9, "s1")]


@pytest.mark.parametrize("block", [4096, 16])
def test_targets_and_bounds(spark, block):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    d = mixing.decide(df, block=block)
    got = mixing.mixing_plan(df).collect()
    assert len(got) == len(data) and d.count() == len(data) - 1
    sizes, taken, biggest = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        biggest[r["source"]] = max(biggest.get(r["source"], 0), r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= biggest[s] for s in sizes)


def test_reruns_agree(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    a = sorted(map(str, mixing.mixing_plan(df.repartition(3)).collect()))
    assert a == sorted(map(str, mixing.mixing_plan(df.repartition(7)).collect()))


def test_pivotal_keeps_words_and_chances():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 50, 60).tolist()
    probs = rng.random(60).tolist()
    ups = np.zeros(60)
    for r in range(600):
        got, left = mixing.pivotal([f"{r}/{i}" for i in range(60)], sizes, probs, 0)
        p = [left[1] if left and left[0] == i else u for i, u in enumerate(got)]
        assert np.dot(p, sizes) == pytest.approx(np.dot(probs, sizes))
        ups += p
    assert np.abs(ups / 600 - probs).max() < 0.1


def test_mix_repeats_documents(docs, no_docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    plan = {}
    for r in mixing.mixing_plan(docs).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + (r["taken"] // r["size"] if r["size"] else 0)
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in plan.items() if v}
    assert mixing.mixing_plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
