import re

import numpy as np
import pytest

from wattlane.llm import jaccard
from wattlane.llm.components import components, roots


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids, up = sorted(sets), {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("part", [2048, 4])
def test_equals_brute_force(docs, corpus, monkeypatch, part):
    """part=4 cuts every leader with more than four nodes."""
    monkeypatch.setattr(jaccard, "PART", part)
    got = jaccard.jaccard_components(docs).collect()
    want = brute(corpus)
    assert {r[0]: (r[1], r[2]) for r in got if r[0] is not None} == want
    assert len(got) == len(corpus) + 1
    assert [r[2] for r in got if r[0] is None] == [None]
    assert len({v[1] for v in want.values()}) < len(want)


def test_large_near_copy_group(spark):
    """Copies with random edits: some link only through others."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(150):
        w = list(base)
        for k in rng.choice(80, rng.integers(0, 7), replace=False):
            w[k] = f"x{rng.integers(0, 50)}"
        rows.append((d, " ".join(w)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute(rows)


def test_boundary_is_exact(spark):
    """n equal shingles, the union sized so that 100 i = 75 u and just below."""
    a = " ".join(f"w{i}" for i in range(34))                      # 30 shingles
    rows = [(1, a), (2, a + " " + " ".join(f"y{i}" for i in range(10))), (3, a + " " + " ".join(f"z{i}" for i in range(11)))]
    got = {r[0]: r[2] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_overlaps_in_slices(monkeypatch):
    monkeypatch.setattr(jaccard, "ITEMS", 7)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:6]]
    assert jaccard.overlaps(sets, 6).tolist() == want


def test_rows_that_share_a_doc_id(spark):
    """The smallest set stands for the id; every row gets its own size."""
    a, b = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 30), ("v", 60)))
    rows = [(1, b), (1, a), (1, a), (2, a), (3, a + " x"), (4, b + " y")]
    got = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 26, 1), (1, 26, 1), (1, 56, 1), (2, 26, 1), (3, 27, 1), (4, 57, 4)]


def test_empty(no_docs):
    assert jaccard.jaccard_components(no_docs).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 3), (5, 5)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    ids = sorted({x for e in links for x in e if x is not None})
    at = {x: i for i, x in enumerate(ids)}
    e = [(at[a], at[b]) for a, b in links if a is not None]
    root = roots(len(ids), *map(np.array, zip(*e)))
    want = {x: ids[root[at[x]]] for x in ids}
    assert all(got.get(x, x) == want[x] for x in ids)
