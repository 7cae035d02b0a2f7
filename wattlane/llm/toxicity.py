"""Toxicity by a weighted finite-state pattern grammar (operator 8).

Five transducers over word classes are composed into one machine, each
reading what the one before wrote, clause by clause:

    insult    accepts the lexicon's stems and words, writes INSULT, or WEAK
              for those that clean rows hold now and then
    threat    THREAT followed within the clause by a TARGET -> MENACE
    target    an INSULT near a TARGET (either side) -> AIMED
    negation  an INSULT, AIMED or MENACE shortly after NOT -> DENIED
    reported  any of these after a verb of saying or a quote -> QUOTED

A clause scores the weights of the symbols its path writes; single words
score nothing by themselves. A document's score is the logistic of its
bias plus, for each symbol, weight * log(1 + matched clauses).

The lexicon is a fixed English seed plus stems (word beginnings of 4 to 8
letters) and words learned from labels on a bounded sample (``SAMPLE``
labelled rows, smallest hash of doc_id): those found in toxic rows more
often than chance allows at ``CHANCE``. The weights are a logistic
regression on the same sample. Learning reads text and toxic; labels, lang,
source and doc_id are no input of a score.

A null or empty text has no clause and scores the bias. Rows labelled twice
count as toxic if one label says so. Without toxic or without clean labels,
default weights hold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import portions
from wattlane.llm.langid import held_out

SAMPLE = 12_000
CHANCE = 1e-7
PURE, MIXED = 0.98, 0.5
STEMS = range(4, 9)
THRESHOLD = 0.3
CLAUSE = re.compile(r"[.,;:!?\n|()]+")
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”«»]")

# Seed insults and threats, and the cue words of the grammar (en, de, fr, es).
INSULTS = "bastard clown disgusting dumb filthy garbage idiot idiots loser losers moron morons pathetic scum stupid trash vermin worthless"
THREATS = "beat burn destroy hang hurt kill shoot stab strangle töten tuer matar"
TARGETS = "you your yours he she him her they them their these those all people du dich dir ihr euch sie tu te toi vous ils elles tú te ti usted ustedes ellos ellas"
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't didn't won't nicht kein keine nie pas jamais aucun nunca jamás ni"
REPORTS = "said says saying wrote writes called calls quoted quote according reported allegedly sagte sagt schrieb dit disait écrit dijo dice escribió \" “ ” « »"

SYMBOLS = ("INSULT", "AIMED", "MENACE", "DENIED", "QUOTED", "WEAK")
DEFAULT = {"bias": -4.0, "INSULT": 4.0, "AIMED": 5.0, "MENACE": 5.0, "DENIED": 2.0, "QUOTED": 2.0, "WEAK": 1.0}
NEAR = 3


class Transducer:
    """A deterministic transducer: ``step(state, symbol) -> (state, out)``,
    where out is the symbol handed on."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes."""
        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = other.step(state[1], out)
            return (a, b), out
        return Transducer((self.start, other.start), step)

    def table(self, alphabet) -> dict:
        """All reachable states numbered from 0: (state, symbol) -> (state, out)."""
        number, todo, out = {self.start: 0}, [self.start], {}
        while todo:
            s = todo.pop()
            for x in alphabet:
                t, y = self.step(s, x)
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
                out[number[s], x] = (number[t], y)
        return out


def _threat(seen, x):
    if x == "THREAT":
        return 1, "OTHER"
    return (0, "MENACE") if seen and x == "TARGET" else (seen, x)


def _target(left, x):
    """left > 0: words since a TARGET that still aim; < 0: since an INSULT."""
    if x == "TARGET":
        return NEAR, "AIMED" if left < 0 else "OTHER"
    if x == "INSULT":
        return -NEAR, "AIMED" if left > 0 else "INSULT"
    return (max(left - 1, 0) if left > 0 else min(left + 1, 0)), x


def _negation(left, x):
    if x == "NOT":
        return NEAR, "OTHER"
    return max(left - 1, 0), "DENIED" if left and x in ("INSULT", "AIMED", "MENACE") else x


def _reported(open_, x):
    if x == "SAYS":
        return 1, "OTHER"
    return open_, "QUOTED" if open_ and x in ("INSULT", "AIMED", "MENACE", "DENIED") else x


CLASSES = ("OTHER", "INSULT", "WEAK", "THREAT", "TARGET", "NOT", "SAYS")
GRAMMAR = (Transducer(0, _threat).then(Transducer(0, _target)).then(Transducer(0, _negation)).then(Transducer(0, _reported))
           .table(CLASSES))

CUES = ({w: "TARGET" for w in TARGETS.split()} | {w: "NOT" for w in NEGATIONS.split()} | {w: "SAYS" for w in REPORTS.split()}
        | {w: "THREAT" for w in THREATS.split()})


class Lexicon:
    """The insult transducer's acceptor: words, and stems that accept any
    word they begin. Letters run through one automaton for both."""

    def __init__(self, words, stems, weak):
        self.words, self.stems, self.weak = set(words), set(stems), set(weak)
        self.find = ahocorasick.Automaton()
        for w in sorted(self.words | self.stems | self.weak | set(THREATS.split())):
            self.find.add_word(w, w)
        self.find.make_automaton()

    def read(self, word: str) -> str:
        begins = [word[:n] for n in STEMS]
        if word in self.words or any(b in self.stems for b in begins):
            return "INSULT"
        return "WEAK" if any(b in self.weak for b in begins) else "OTHER"

    def clauses(self, text: str) -> Iterator[list[str]]:
        """Word classes of each clause that holds a lexicon or threat word."""
        low = text.lower()
        done = -1
        for end, w in self.find.iter(low):
            at = end - len(w) + 1
            if at <= done or (at and low[at - 1].isalnum()):
                continue
            a, b = at, end
            while a and not CLAUSE.match(low[a - 1]):
                a -= 1
            m = CLAUSE.search(low, b)
            done = m.start() if m else len(low)
            words = TOKEN.findall(low[a:done])
            classes = [CUES.get(x) or self.read(x) for x in words]
            if not {"INSULT", "THREAT", "WEAK"}.isdisjoint(classes):
                yield classes

    def matches(self, text: str | None) -> list[int]:
        """Clauses per symbol that the composed machine writes."""
        found = dict.fromkeys(SYMBOLS, 0)
        for classes in self.clauses(text or ""):
            state, wrote = 0, set()
            for x in classes:
                state, out = GRAMMAR[state, x]
                wrote.add(out)
            for s in wrote & found.keys():
                found[s] += 1
        return [found[s] for s in SYMBOLS]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, toxic, clean document counts, combined in the task."""
    def rows(counts: dict) -> pa.RecordBatch:
        keys = list(counts[1].keys() | counts[0].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()),
                                           pa.array([counts[0][k] for k in keys], pa.int64())], names=["feature", "toxic", "clean"])
    counts = {0: Counter(), 1: Counter()}
    for b in portions(batches):
        for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            words = {w for w in re.findall(r"[^\W\d_]+", (text or "").lower())}
            counts[y].update({"=" + w for w in words} | {w[:n] for w in words for n in STEMS if len(w) >= n})
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield rows(counts)
                counts = {0: Counter(), 1: Counter()}
    yield rows(counts)


def tail(a: int, n: int, p: float) -> float:
    """Chance of a or more toxic among n documents at rate p (binomial), in
    logarithms: n may be any number."""
    k = np.arange(a, n + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    return float(np.exp(logs[n] - logs[k] - logs[n - k] + k * math.log(p) + (n - k) * math.log1p(-p)).sum())


def choose_lexicon(rows, toxic: int, clean: int, chance: float = CHANCE) -> Lexicon:
    """Words and stems that occur in toxic rows beyond chance and hardly in
    clean ones; the shortest stem stands for all it begins."""
    rate = min(max(toxic / max(toxic + clean, 1), 0.02), 0.9)
    pure, mixed = set(), set()
    for feature, a, b in rows:
        n = a + b
        if a >= 4 and a > n * rate and tail(a, n, rate) < chance:
            (pure if a >= PURE * n else mixed).add(feature)

    def shortest(features: set, but: set) -> set:
        out: set = set()
        for f in sorted(features, key=lambda f: (len(f), f)):
            if not any(f[:n] in out or f[:n] in but for n in STEMS if n <= len(f)):
                out.add(f)
        return out

    stems = shortest({f for f in pure if f[0] != "="}, set())
    words = {f[1:] for f in pure if f[0] == "="}
    words = {w for w in words if not any(w[:n] in stems for n in STEMS)} | set(INSULTS.split())
    return Lexicon(words, stems, shortest({f for f in mixed if f[0] != "="}, stems))


def fit_weights(matches: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Ridge logistic regression (Newton) of y on log(1 + matches)."""
    if not len(y) or y.min() == y.max():
        return dict(DEFAULT)
    x = np.hstack([np.ones((len(y), 1)), np.log1p(matches)])
    prior = np.array([DEFAULT["bias"], *(DEFAULT[s] for s in SYMBOLS)])
    ridge = np.diag([1e-3] + [0.1] * len(SYMBOLS))
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge @ (w - prior)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return {"bias": float(w[0])} | dict(zip(SYMBOLS, map(float, w[1:])))


def score(matches: np.ndarray, w: dict[str, float]) -> np.ndarray:
    z = w["bias"] + np.log1p(matches) @ np.array([w[s] for s in SYMBOLS])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _match_rows(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*lexicon)
        for b in batches:
            found = pa.array([lex.matches(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("key"), found], names=["key", "matches"])
    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[tuple[set, set, set], dict[str, float]]:
    """(words, stems, weak stems) and the weights, from labelled rows that are not held
    out (docs: doc_id, text; labels: doc_id, toxic)."""
    rows = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
            .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter("toxic IN (0, 1)")
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most ``sample`` rows of two numbers: bounded
    picked = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select(F.col("toxic").alias("key"), "text", "toxic")
    n = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    counted = (picked.select("text", "toxic").mapInArrow(_word_counts, "feature string, toxic long, clean long")
               .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
               .filter((F.col("toxic") >= 4) & (F.col("toxic") > MIXED * (F.col("toxic") + F.col("clean")))))
    lex = choose_lexicon([tuple(r) for r in counted.collect()], n.get(1, 0), n.get(0, 0))
    parts = (lex.words, lex.stems, lex.weak)
    found = picked.select("key", "text").mapInArrow(_match_rows(parts), "key int, matches array<int>").collect()
    m = np.array([r["matches"] for r in found], float).reshape(-1, len(SYMBOLS))
    return parts, fit_weights(m, np.array([r["key"] for r in found], float))


def score_documents(docs: DataFrame, lexicon: tuple[set, set, set], weights: dict[str, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*lexicon)
        for b in portions(batches):
            m = np.array([lex.matches(t) for t in b.column("text").to_pylist()], float).reshape(-1, len(SYMBOLS))
            s = score(m, weights)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s),
                                              pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
    src = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.3)."""
    return score_documents(docs, *learn(docs, labels))
