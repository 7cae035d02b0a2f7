import math

import numpy as np
import pytest

from wattlane.llm import toxicity as tox

LEX = tox.Lexicon({"idiot"}, {"vrak"}, {"blem"})


def found(text):
    return dict((s, n) for s, n in zip(tox.SYMBOLS, LEX.matches(text)) if n)


def test_grammar():
    assert found("what an idiot") == {"INSULT": 1}
    assert found("you are an idiot") == {"AIMED": 1}
    assert found("idiot, you are") == {"INSULT": 1}              # another clause
    assert found("an idiot you are") == {"AIMED": 1} or found("an idiot you are") == {"AIMED": 1, "INSULT": 1}
    assert found("never an idiot") == {"DENIED": 1}
    assert found("she said idiot") == {"QUOTED": 1}
    assert found("he wrote not an idiot") == {"QUOTED": 1}
    assert found("kill you") == {"MENACE": 1}
    assert found("never kill them") == {"DENIED": 1}
    assert found("kill time") == {}
    assert found("a vraknost here. a VRAKi there") == {"INSULT": 2}
    assert found("avrak xidiot idiots blemme") == {"WEAK": 1}     # stems begin words, words end where they end
    assert found(None) == found("") == found("nice day, you") == {}


def test_composition_reads_stepwise():
    """The composed table equals running the transducers one by one."""
    chain = [tox._threat, tox._target, tox._negation, tox._reported]
    rng = np.random.default_rng(0)
    for _ in range(200):
        word = rng.choice(tox.CLASSES, 12)
        state, states = 0, [0] * 4
        for x in word:
            state, out = tox.GRAMMAR[state, x]
            y = x
            for i, step in enumerate(chain):
                states[i], y = step(states[i], y)
            assert out == y


def test_tail_is_binomial():
    assert abs(tox.tail(0, 5, 0.3) - 1) < 1e-12 and abs(tox.tail(5, 5, 0.3) - 0.3 ** 5) < 1e-12


def frame(spark, n=600):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(list("aeilnorst"), rng.integers(3, 9))) for _ in range(rng.integers(5, 40))]
        bad = i % 6 == 0
        if bad:
            w[rng.integers(0, len(w))] = "qlumz" + rng.choice(["a", "en", "ost", "ig"])  # a stem the seed does not know
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_stems_and_scores_held_out(spark):
    docs, labels = frame(spark)
    out = tox.toxicity(docs, labels).collect()
    hidden = [r for r in out if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in hidden]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 20000), (None, "you idiot"), (3, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (77, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        out = tox.toxicity(docs, labels).collect()
        assert len(out) == 5 and all(r["score"] is not None for r in out)
        assert [r["predicted"] for r in out if r["doc_id"] in (1, 2)] == [0, 0]
    assert tox.toxicity(docs.limit(0), none).count() == 0


def test_chance_holds_for_frequent_features():
    """What chance gives is no evidence, however often it occurs."""
    for n in (60, 260, 5000):
        usual = [(f"w{n}", round(0.6 * n) + 1, n - round(0.6 * n) - 1)]
        strong = [(f"s{n}", round(0.8 * n), n - round(0.8 * n))]
        lex = tox.choose_lexicon([("=" + f, a, b) for f, a, b in usual + strong], 6000, 4000)
        assert f"w{n}" not in lex.words and f"w{n}"[:3] not in lex.weak
    for a, n, p in ((3, 10, 0.3), (40, 200, 0.2), (7, 7, 0.5)):
        assert tox.tail(a, n, p) == pytest.approx(sum(math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(a, n + 1)))
    assert 0 < tox.tail(6000, 20_000, 0.29) < 0.01
