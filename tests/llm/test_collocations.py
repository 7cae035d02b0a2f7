import random
import re
from collections import Counter

import numpy as np
import pytest

from wattlane.llm import collocations as C


def brute(rows, min_count=30, max_words=4, top=2000):
    f, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            totals[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    dropped = set()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 80 * cand[lang, p[i:i + k]]:
                    dropped.add((lang, p[i:i + k]))
    by = {}
    for (lang, p), a in cand.items():
        if (lang, p) in dropped:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        by.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, x in by.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["of", "the", "New", "york", "city", "hall", "É", "é", "a-b", "x y", "big"]
    out = []
    for i in range(160):
        t = []
        for _ in range(rng.randint(0, 120)):
            t.append(rng.choice([*words, "new york", "New York City", "in the  city\tof", "rare%d" % rng.randrange(500)]))
            if rng.random() < 0.15:
                t.append(rng.choice([".", ",", "\n", "; ", "!?", "\r\n", "\x0b", ":"]))
        out.append((rng.choice(["en", "fr", None, "und"]), " ".join(t)))
    out += [(None, None), ("de", ""), ("fr", "...,,,"), ("en", "ha " * 4000), ("en", "w" * 20000 + " big"), out[0], out[0], ("zz", "only words that are rare")]
    return out


def frame(spark, rows, parts):
    return spark.createDataFrame([(i, t, lang, 3, 2, "p") for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, n long, shard long, prefix string").repartition(parts)


@pytest.mark.parametrize("shard, parts", [(1_200_000, 1), (700, 6)])
def test_equals_brute_force(spark, rows, shard, parts):
    got = sorted(map(tuple, C.collocations(frame(spark, rows, parts), shard_words=shard).collect()))
    assert got == brute(rows) and len(got) > 60
    assert {r[0] for r in got} >= {"en", "fr", "und"} and any(len(r[2].split(" ")) == 4 for r in got)


def test_other_limits_and_many_buckets(spark, rows, monkeypatch):
    monkeypatch.setattr(C, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(C, "WORD_BUCKET_BYTES", 5000)
    df = frame(spark, rows, 3)
    got = sorted(map(tuple, C.collocations(df, min_count=5, max_words=3, top=40).collect()))
    assert got == brute(rows, 5, 3, 40)


def test_empty_tables(spark, rows, no_docs):
    assert C.collocations(no_docs).count() == 0
    assert C.collocations(frame(spark, [(None, None), ("en", "")], 2)).count() == 0
    assert C.collocations(frame(spark, [("en", "a b c d")], 1)).count() == 0


def phrases(ids, depth):
    out = Counter()
    for i in range(len(ids) - depth + 1):
        p = tuple(ids[i:i + depth])
        if 0 not in p:
            out[p] += 1
    return out


@pytest.mark.parametrize("symbols", [2, 5, 60, 3_000_000])
def test_extension_finds_every_phrase(symbols):
    """With all phrases given, the extension names all that are one longer,
    with their counts; intervals are those of the sorted rotations."""
    rng = np.random.default_rng(symbols)
    pool = np.append(0, rng.choice(np.arange(1, max(symbols, 3)), min(symbols, 60) - 1, replace=symbols < 60))
    ids = C._short(np.concatenate([[0], pool[rng.integers(0, len(pool), 700)], [0]]).astype(np.int32))
    n = len(ids)
    size = np.bincount(ids)
    kinds = np.flatnonzero(size)[1:] if size[0] else np.flatnonzero(size)
    start = (np.cumsum(size) - size)[kinds]
    known = {(int(k),): i for i, k in enumerate(kinds)}
    given = (start, start, size[kinds], np.arange(len(kinds)))
    for depth in range(1, 5):
        s, m, c, p, q = C.extend(ids, depth, *given)
        back = {v: k for k, v in known.items()}
        told = {back[int(a)] + back[int(b)][-1:]: int(x) for a, b, x in zip(p, q, c)}
        assert told == dict(phrases(ids.tolist(), depth + 1))
        rotations = sorted(tuple(np.roll(ids, -i)[:depth + 1].tolist()) for i in range(n))
        mirrored = sorted(tuple(np.roll(ids[::-1], -i)[:depth + 1].tolist()) for i in range(n))
        names = [back[int(a)] + back[int(b)][-1:] for a, b in zip(p, q)]
        assert [rotations.index(x) for x in names] == s.tolist()
        assert [mirrored.index(x[::-1]) for x in names] == m.tolist()
        order = s.argsort()
        known = {names[i]: k for k, i in enumerate(order)}
        given = (s[order], m[order], c[order], np.arange(len(order)))


def test_wide_numbers(spark):
    """Counts whose products pass 64 bits: scores and covers stay exact."""
    a = 6_000_000_000_000
    df = spark.createDataFrame([(a, [a + 1, 2 * a], [3 * a, a + 5])], "f long, heads array<long>, tails array<long>")
    c = df.selectExpr(f"{C._CUTS} AS c").first().c
    assert (c.score, c.k, c.l, c.r) == min((2000000 * a // (x + y), k + 1, x, y) for k, (x, y) in enumerate([(a + 1, 3 * a), (2 * a, a + 5)]))


def test_blob_round_trips():
    for kind in (np.int32, np.int64):
        x = np.array([0, 5, 0, 1 << 30, 7, -3], kind)
        assert C._unsqueeze(C._squeeze(x), kind).tolist() == x.tolist()
        assert C._unsqueeze(C._squeeze(x[:0]), kind).tolist() == []
    assert C._split(C._join(b"abc", b"", b"d")) == [b"abc", b"", b"d"] and C._split(C._join()) == []
