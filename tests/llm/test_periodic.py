import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattlane.llm import periodic


def smallest_period(w):
    """By the border array."""
    b = [0] * len(w)
    for i in range(1, len(w)):
        k = b[i - 1]
        while k and w[i] != w[k]:
            k = b[k - 1]
        b[i] = k + (w[i] == w[k])
    return len(w) - b[-1]


def brute(w, least=24):
    """All runs: maximal stretches of every period, of which it is the
    smallest."""
    out, n = set(), len(w)
    for p in range(1, n // 3 + 1):
        i = p
        while i < n:
            if w[i] != w[i - p]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - p]:
                j += 1
            if j - i + p >= max(least, 3 * p) and smallest_period(w[i - p:j]) == p:
                out.add((i - p, j - i + p, p))
            i = j + 1
    return sorted(out)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def samples():
    rng = random.Random(5)
    yield [0] * 23
    yield [0] * 24
    yield [0] * 500
    yield fibonacci(900)
    yield [bin(i).count("1") & 1 for i in range(1024)]              # no cube at all
    yield ([0] * 40 + [1]) * 12 + [0] * 60
    yield ([0, 1] * 15 + [2]) * 9
    for period in range(1, 60):
        body = [rng.randrange(4) for _ in range(period)]
        w = [rng.randrange(3) for _ in range(rng.randrange(50))] + (body * 40)[:3 * period + rng.randrange(-2, 60)]
        yield w + [rng.randrange(3) for _ in range(rng.randrange(50))]
    for _ in range(60):
        yield [rng.randrange(2) for _ in range(rng.randrange(400))]
        w = []
        while len(w) < 600:
            w += [rng.randrange(2) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 30)
        yield w


def named(w):
    return [b"w%d" % x for x in w]


def test_texts_that_share_streams():
    all_ = list(samples())
    got = periodic.text_runs([named(w) for w in all_])
    assert got == [brute(w) for w in all_]
    assert sum(map(len, got)) > 150


@pytest.mark.parametrize("portion", [1, 7, 64, 333])
def test_appended_in_portions(portion):
    for w in list(samples())[::3]:
        c = periodic.SquareCatcher(len(w))
        for lo in range(0, len(w), portion):
            c.append(np.array(w[lo:lo + portion], np.int64))
        assert c.runs() == brute(w)


def test_runs_are_known_while_the_text_grows():
    w = [5] * 3 + [0, 1] * 20 + [7] * 30
    c = periodic.SquareCatcher(len(w))
    for i, x in enumerate(w):
        c.append(np.array([x]))
        assert c.runs() == brute(w[:i + 1])


def test_long_text_in_portions(monkeypatch):
    monkeypatch.setattr(periodic, "PORTION", 512)
    rng = random.Random(1)
    body = [rng.randrange(9) for _ in range(700)]
    w = [rng.randrange(50) for _ in range(900)] + body * 3 + [0] * 100 + body[:300] * 3
    assert periodic.text_runs([named(w)]) == [brute(w)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 14)), max_size=12), st.sampled_from([24, 40]))
def test_equals_brute_force(parts, least):
    w = [x for body, k in parts for x in body * k]
    c = periodic.SquareCatcher(len(w), least)
    c.append(np.array(w, np.int64))
    assert c.runs() == brute(w, least)


def expected(i, text):
    w = [x for x in (text or "").encode().split()]
    if i is not None and w:
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (i, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())


def test_query_rows(docs, corpus):
    rows = [(i, t) for i, t in corpus] + [(None, "no id " * 30)]
    out = periodic.digests(periodic.periodic_runs(docs, rewrite=periodic.stutter))
    assert sorted(map(tuple, out.collect()), key=str) == sorted((expected(*r) for r in rows), key=str)


def test_stuttering_ids_and_long_texts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abc") * rng.randint(1, 3) for _ in range(rng.randint(1, 200)))) for i in range(-150, 150)]
    rows.append((1 << 40, "x y " * 2000))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = periodic.digests(periodic.periodic_runs(df, rewrite=periodic.stutter)).collect()
    assert sorted(map(tuple, out)) == sorted(map(lambda r: expected(*r), rows), key=lambda r: r[0])
    assert sum(r.n_runs > 0 for r in out) > 10


def test_general_output_and_empty_table(docs, no_docs):
    rows = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert rows[307].runs[0].length == 500 and rows[307].collapsed_text == "a" and rows[307].exponent_milli == 500_000
    assert rows[300].runs == [] and rows[300].start is None and rows[300].collapsed_text == ""
    assert periodic.digests(periodic.periodic_runs(no_docs)).count() == 0
    with pytest.raises(ValueError):
        periodic.SquareCatcher(100, 10)
