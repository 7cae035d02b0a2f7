import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest

from wattlane.llm import divergence as D

BLANKS = " \t\n\x0b\x0c\r"


def split(text):
    out, word = [], ""
    for c in text + " ":
        if c in BLANKS:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def figures(text):
    t = text or ""
    w = split(t)
    lines = [x for x in t.split("\n") if split(x)]
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again),
            len(w) < 50 or 100 * len(again) > 50 * len(w))


def of_class(c):
    k = unicodedata.category(c)
    if c in "#*%&@\\_" or k[0] == "S":
        return 6
    if c in BLANKS:
        return 7
    return {"Lu": 0, "Ll": 1}.get(k, {"L": 2, "M": 3, "N": 4, "P": 5, "Z": 7}.get(k[0], 8))


def bare(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word).strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def divergence(counts, ref):
    """Plain definition over dicts: JSD in bits minus what chance gives."""
    n = sum(counts.values())
    total, chance = 0.0, []
    for k in set(counts) | set(ref):
        p, q = counts.get(k, 0) / n, ref.get(k, 0.0)
        m = (p + q) / 2
        total += (p and p * math.log2(p / m)) / 2 + (q and q * math.log2(q / m)) / 2
        chance.append(min(1 / (8 * math.log(2) * n), q / 2))
    return total - sum(chance) - 3 * math.sqrt(2 * sum(x * x for x in chance))


def brute(rows):
    """(doc_id, figures, kept) by dictionaries."""
    told = [(i, t or "", lang, figures(t)) for i, t, lang in rows]
    words, classes = {}, {}
    for _, t, lang, f in told:
        if lang is not None and not f[-1]:
            words.setdefault(lang, Counter()).update(map(bare, split(t)))
            classes.setdefault(lang, Counter()).update(map(of_class, t))
    everything = sum(sum(c.values()) for c in words.values())
    refs = {}
    for lang, c in words.items():
        n = sum(c.values())
        if n * D.LANGUAGE_SHARE < everything:
            continue
        common = {w: k / n for w, k in c.items() if w and len(w.encode()) <= D.LONGEST and k * D.WORD_SHARE >= n}
        chars = sum(classes[lang].values())
        refs[lang] = ({k: x / chars for k, x in classes[lang].items()}, common | {None: 1 - sum(common.values())})
    out = []
    for i, t, lang, f in told:
        by = []
        for r in [refs[lang]] if lang in refs else refs.values() if lang is None else []:
            w = Counter(x if x in r[1] else None for x in map(bare, split(t)))
            by.append((divergence(w, r[1]) if f[0] >= D.MIN_WORDS else None, divergence(Counter(map(of_class, t)), r[0]) if len(t) >= D.MIN_CHARS else None))
        w, c = min(by, key=lambda x: (x[0] or 0) * 1000 + (x[1] or 0), default=(None, None))
        bad = f[-1] or (w is not None and w > D.WORD_LIMIT) or (c is not None and c > D.CLASS_LIMIT)
        out.append((i, *f, not bad, c, w))
    return out


def prose(rng, lang, n):
    """Words of a language: a few common ones, many rare ones, sentences."""
    common = {"en": ["the", "of", "and", "to", "in"], "xx": ["żur", "ée", "ob", "ka"]}[lang]
    out = []
    for i in range(n):
        w = rng.choice(common) if rng.random() < 0.6 else "".join(rng.choice("abcdeghiloß" if lang == "en" else "éżąbklo") for _ in range(rng.randint(3, 8)))
        out.append(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w)
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(i, prose(rng, "en" if i % 3 else "xx", rng.randint(60, 400)), "en" if i % 3 else "xx") for i in range(150)]
    junk = prose(rng, "en", 200)
    out += [(200, junk.upper(), "en"), (201, " ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in junk.split()), "en"),
            (202, " | ".join("".join(rng.choice("abcde") for _ in range(8)) for _ in range(150)), "en"), (203, prose(rng, "xx", 200), "en"),
            (204, "spam ham eggs " * 60, "en"), (205, prose(rng, "en", 30), "en"), (206, junk, None), (207, junk.upper(), None), (208, prose(rng, "xx", 90), None),
            (209, None, "en"), (210, "", "en"), (211, " \n\t", None), (212, None, None), (213, "line\nline\n line\n\nline", "en"),
            (214, junk, "rare"), (215, "x" * 30000 + " " + junk, "en"), (216, prose(rng, "en", 9000), "en"), (200, junk, "en"), (None, junk, "en"),
            (217, "a#b*c$d%e&f|g<h>i j k " * 10, "en"), (218, "漢字 ９ ǅ ʰ é " * 40, "xx"), (219, junk, "en"), (219, junk, "en")]
    return out


@pytest.fixture(scope="module")
def told(spark, rows):
    df = spark.createDataFrame([(*r, 1.5, "k", 7) for r in rows], "doc_id long, text string, lang string, n double, word string, class int").repartition(5)
    return D.quality(df).collect()


def test_equals_brute_force(told, rows):
    got = sorted((tuple(r) for r in told), key=str)
    want = sorted(brute(rows), key=str)
    assert [r[:8] for r in got] == [r[:8] for r in want]
    for g, w in zip(got, want):
        for a, b in zip(g[8:], w[8:]):
            assert a == b or a == pytest.approx(b, abs=1e-9)


def test_junk_goes_and_prose_stays(told):
    kept = {}
    for r in told:
        kept.setdefault(r.doc_id, []).append(r.kept)
    assert all(all(kept[i]) for i in range(150))
    assert not any(any(kept[i]) for i in (201, 202, 203, 204, 205, 207))
    assert kept[200] == [False, True] or kept[200] == [True, False]
    assert kept[206] == kept[208] == kept[214] == [True] and kept[None] == [True]


def test_divergence_is_a_divergence():
    rng = np.random.default_rng(0)
    p, q = rng.dirichlet(np.ones(6), 5), rng.dirichlet(np.ones(6))
    d = D.jensen_shannon(p, q)
    assert ((d > 0) & (d <= 1)).all()
    assert D.jensen_shannon(q[None], q)[0] == pytest.approx(0)
    assert D.jensen_shannon(np.array([[1.0, 0]]), np.array([0, 1.0]))[0] == pytest.approx(1)
    assert D.jensen_shannon(q[None], p[0])[0] == pytest.approx(d[0])


def test_chance_is_allowed_for():
    """Texts drawn from the reference itself pass at every length."""
    rng = np.random.default_rng(1)
    q = rng.dirichlet(np.ones(40))
    for n in (50, 200, 5000):
        p = rng.multinomial(n, q, 400) / n
        over = D.jensen_shannon(p, q) - D.allowance(q, np.full(400, n))
        assert over.max() < D.WORD_LIMIT
        assert D.jensen_shannon(p[:, ::-1], q).min() - D.allowance(q, np.array([n]))[0] > 0.1


def test_repeated_words_with_many_kinds():
    ids = np.array([5, 1, 2, 5, 1, 2, 9], np.int64)
    assert D.repeated_words(ids) == 6 and D.repeated_words(ids + (1 << 22)) == 6
    assert D.repeated_words(np.zeros(2, np.int64)) == 0 and D.repeated_words(np.zeros(3, np.int64)) == 0


def test_portions_add_up_and_empty_table(spark, rows, no_docs):
    assert D.quality(no_docs).count() == 0
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {lang: (r.words.tolist(), r.classes.tolist(), list(r.index)) for lang, r in D.references(t.coalesce(1)).items()}
    apart = {lang: (r.words.tolist(), r.classes.tolist(), list(r.index)) for lang, r in D.references(t.repartition(7)).items()}
    assert whole == apart and {"en", "xx"} <= set(whole)
