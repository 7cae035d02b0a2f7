"""Quality rules and distribution divergence (operator 11).

A first pass over all texts counts, per language, the words and the character
classes of the documents that pass the base rules. From the sums come the
language references: a histogram over ``CLASSES`` and one over the language's
common words (those that make up ``1 / WORD_SHARE`` of its words or more) plus
the rest. A second pass compares every document with the reference of its
language by the Jensen-Shannon divergence (bits, 0 to 1). A finite text
departs from its own source by chance; about 1 / (8 n ln 2) for each bin,
never more than half of the bin's share, and three standard deviations of
their sum are allowed for before the limit applies. Documents under ``MIN_WORDS`` words or ``MIN_CHARS`` characters are
not judged by that histogram.

The counts are written once, a row per (language, word) and portion of texts
that has it. A word that is common in a language is common in one of the
portions, so only the words that are common somewhere are summed over all.
What reaches the driver is bounded by the shares: at most ``LANGUAGE_SHARE``
languages with at most ``WORD_SHARE`` words of at most ``LONGEST`` bytes.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import portions, stage

BASE_WORDS = 50
BASE_REPEAT = 50               # per cent of the words in repeated windows
WINDOW = 3
MIN_WORDS = 50
MIN_CHARS = 200
WORD_LIMIT = 0.05              # bits beyond chance
CLASS_LIMIT = 0.06
DEVIATIONS = 3
WORD_SHARE = 400
LANGUAGE_SHARE = 1000
LONGEST = 64                   # bytes of a common word
HELD = 200_000                 # distinct words a task holds between two hand-overs,
HELD_BYTES = 32 << 20          # and their bytes

CLASSES = ["upper", "lower", "letter", "mark", "number", "punctuation", "symbol", "space", "other"]
SYMBOLS = "#*%&@\\_"           # punctuation by its category, but no mark of a sentence
COUNTED = "#*$%&|<>"           # n_symbols
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLANK = b" \t\n\x0b\x0c\r"

_CATEGORY = {"Lu": 0, "Ll": 1, "L": 2, "M": 3, "N": 4, "P": 5, "S": 6, "Z": 7}


@cache
def class_table() -> np.ndarray:
    """Character class of every code point, by its general category."""
    out = np.empty(0x110000, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))
        out[i] = _CATEGORY.get(c, _CATEGORY.get(c[0], 8))
    out[[ord(c) for c in SYMBOLS]] = 6
    out[list(BLANK)] = 7
    return out


class Measured:
    """Base figures and histogram of one text."""

    __slots__ = ("words", "ids", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes")

    def __init__(self, text: str, ids: dict):
        raw = text.encode()
        self.words = words = raw.split()
        self.n_words = len(words)
        table = class_table()
        ascii_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)[:128]
        self.classes = np.bincount(table[:128], ascii_, len(CLASSES)).astype(np.int64)
        if len(text) != len(raw):
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            self.classes += np.bincount(table[points[points > 127]], minlength=len(CLASSES))
        self.word_chars = len(text) - int(ascii_[list(BLANK)].sum())
        self.n_symbols = int(ascii_[[ord(c) for c in COUNTED]].sum())
        lines = [x for x in raw.split(b"\n") if x.strip()]
        self.n_dup_lines = len(lines) - len(set(lines))
        self.ids = np.fromiter(map(ids.__getitem__, words), np.int64, self.n_words)
        self.n_repeat_words = repeated_words(self.ids)

    @property
    def base_failed(self) -> bool:
        return self.n_words < BASE_WORDS or 100 * self.n_repeat_words > BASE_REPEAT * self.n_words


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    if ids.max() < 1 << 21:
        key = (ids[:n] << 42) | (ids[1:n + 1] << 21) | ids[2:]
    else:
        _, pair = np.unique((ids[:n] << 32) | ids[1:n + 1], return_inverse=True)
        key = (pair.astype(np.int64) << 32) | ids[2:]
    order = key.argsort(kind="stable")
    same = np.diff(key[order]) == 0
    twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    cover = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        cover[twice + k] = True
    return int(cover.sum())


class _Ids(dict):
    """word -> number"""

    bytes = 0

    def __missing__(self, word: bytes) -> int:
        self.bytes += len(word)
        i = self[word] = len(self)
        return i

    def full(self) -> bool:
        return len(self) > HELD or self.bytes > HELD_BYTES

    def clear(self) -> None:
        super().clear()
        self.bytes = 0


def bare(word: bytes) -> bytes:
    """The word as the histograms count it: A-Z lower-cased, without ASCII
    punctuation around it."""
    return word.lower().strip(PUNCTUATION)


def _measured(batches: Iterator[pa.RecordBatch], ids: _Ids) -> Iterator[tuple[pa.RecordBatch, list[Measured]]]:
    for b in portions(batches):
        yield b, [Measured(text or "", ids) for text in b.column("text").to_pylist()]


_COUNTS = "lang string, class int, word string, n long, often boolean"


def _count_rows(lang: str, classes: np.ndarray, seen: np.ndarray, names: list[bytes]) -> pa.RecordBatch:
    """A portion's counts of one language; ``often`` marks words that are
    common in this portion alone."""
    told: Counter = Counter()
    for i in np.flatnonzero(seen):
        word = bare(names[i])
        told[word if len(word) <= LONGEST else b""] += int(seen[i])
    n = np.array([*classes, *told.values()], np.int64)
    often = n * WORD_SHARE >= seen.sum()
    k = len(CLASSES)
    often[:k] = False
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(n), pa.string()), pa.array([*range(k), *[None] * len(told)], pa.int32()),
         pa.array([None] * k + list(told), pa.binary()).cast(pa.string()), pa.array(n), pa.array(often)], names=["lang", "class", "word", "n", "often"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the documents that pass the base rules, handed over
    whenever ``HELD`` distinct words are held."""
    ids = _Ids()
    seen: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(0, np.int64))
    classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))

    def handed_over() -> Iterator[pa.RecordBatch]:
        names = list(ids)
        for lang in seen:
            yield _count_rows(lang, classes[lang], seen[lang], names)
        ids.clear()
        seen.clear()
        classes.clear()

    for b, all_ in _measured(batches, ids):
        by = defaultdict(list)
        for lang, m in zip(b.column("lang").to_pylist(), all_):
            if not m.base_failed:
                by[lang].append(m)
        for lang, some in by.items():
            n = np.bincount(np.concatenate([m.ids for m in some]), minlength=len(ids))
            n[:len(seen[lang])] += seen[lang]
            seen[lang] = n
            classes[lang] += sum(m.classes for m in some)
        if ids.full():
            yield from handed_over()
    yield from handed_over()


class Reference:
    """What a language's documents look like."""

    def __init__(self, classes: np.ndarray, words: dict[str, int], total: int):
        self.classes = classes / max(classes.sum(), 1)
        self.index = {w.encode(): i for i, w in enumerate(sorted(words))}
        common = np.array([words[w] for w in sorted(words)], float)
        self.words = np.append(common, total - common.sum()) / max(total, 1)


def references(docs: DataFrame) -> dict[str, Reference]:
    """The reference of every language that has ``1 / LANGUAGE_SHARE`` of the
    words of the documents that pass the base rules."""
    counts = stage(docs.select("lang", "text").filter("lang IS NOT NULL").mapInArrow(_counts, _COUNTS), "divergence-counts")
    totals = counts.filter("class IS NULL").groupBy("lang").agg(F.sum("n").alias("total"))
    everything = totals.agg(F.sum("total")).first()[0] or 0
    large = totals.filter(F.col("total") * LANGUAGE_SHARE >= everything)
    # a word that is common in its language is common in one portion at least
    often = counts.filter("often AND word <> ''").select("lang", "word").distinct()
    common = (counts.join(often, ["lang", "word"]).groupBy("lang", "word").agg(F.sum("n").alias("n"))
              .join(large, "lang").filter(F.col("n") * WORD_SHARE >= F.col("total")))
    by_class = counts.filter("class IS NOT NULL").groupBy("lang", "class").agg(F.sum("n").alias("n")).join(large, "lang")
    rows = common.withColumn("class", F.lit(None).cast("int")).unionByName(by_class.withColumn("word", F.lit(None).cast("string"))).collect()
    classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES)))
    words: dict[str, dict[str, int]] = defaultdict(dict)
    total = {}
    for r in rows:
        total[r.lang] = r.total
        if r["class"] is None:
            words[r.lang][r.word] = r.n
        else:
            classes[r.lang][r["class"]] = r.n
    return {lang: Reference(classes[lang], words[lang], n) for lang, n in total.items()}


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Divergence in bits of each row of p from q (shares)."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=-1)
    return (a + b) / 2


def allowance(q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What n draws from q may depart from it by chance: about a chi-square
    variable a bin, so the mean and ``DEVIATIONS`` standard deviations."""
    mean = np.minimum(1 / (8 * math.log(2) * np.maximum(n, 1))[:, None], q / 2)
    return mean.sum(axis=1) + DEVIATIONS * np.sqrt(2 * (mean * mean).sum(axis=1))


class _Common(dict):
    """word as written -> bin of the word histogram, remembered."""

    def __init__(self, reference: Reference):
        self.index, self.rest = reference.index, len(reference.index)

    def __missing__(self, word: bytes) -> int:
        i = self.index.get(bare(word), self.rest)
        if len(word) <= LONGEST:
            if len(self) >= HELD:
                self.clear()
            self[word] = i
        return i


def excess(all_: list[Measured], ref: Reference, bins: _Common) -> tuple[np.ndarray, np.ndarray]:
    """Divergence beyond chance of each text's character classes and common
    words from the reference; null (NaN) under the minimum lengths."""
    classes = np.array([m.classes for m in all_], float)
    chars = classes.sum(axis=1)
    words = np.array([np.bincount(np.fromiter(map(bins.__getitem__, m.words), np.int64, m.n_words), minlength=bins.rest + 1) for m in all_], float)
    n = words.sum(axis=1)
    by_class = jensen_shannon(classes / np.maximum(chars, 1)[:, None], ref.classes) - allowance(ref.classes, chars)
    by_word = jensen_shannon(words / np.maximum(n, 1)[:, None], ref.words) - allowance(ref.words, n)
    return np.where(chars >= MIN_CHARS, by_class, np.nan), np.where(n >= MIN_WORDS, by_word, np.nan)


def _judge(refs: dict[str, Reference]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = {lang: _Common(r) for lang, r in refs.items()}
        ids = _Ids()
        for b, all_ in _measured(batches, ids):
            if ids.full():
                ids.clear()
            langs = b.column("lang").to_pylist()
            by_class, by_word = np.full(len(all_), np.nan), np.full(len(all_), np.nan)
            for lang, ref in refs.items():
                at = [i for i, x in enumerate(langs) if x == lang]
                if at:
                    by_class[at], by_word[at] = excess([all_[i] for i in at], ref, bins[lang])
            if at := [i for i, x in enumerate(langs) if x is None]:
                both = [excess([all_[i] for i in at], ref, bins[lang]) for lang, ref in refs.items()]
                if both:                                   # the nearest language by words, by classes where too short
                    near = np.nan_to_num([w for _, w in both]) * 1000 + np.nan_to_num([c for c, _ in both])
                    pick = near.argmin(axis=0)
                    by_class[at] = np.array([c for c, _ in both])[pick, range(len(at))]
                    by_word[at] = np.array([w for _, w in both])[pick, range(len(at))]
            failed = np.array([m.base_failed for m in all_], bool)
            kept = ~failed & ~(by_class > CLASS_LIMIT) & ~(by_word > WORD_LIMIT)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([getattr(m, c) for m in all_], pa.int64()) for c in FIGURES),
                 pa.array(failed), pa.array(kept), *(pa.array(x, pa.float64(), from_pandas=True) for x in (by_class, by_word))],
                names=["doc_id", *FIGURES, "base_failed", "kept", "class_excess", "word_excess"])
    return run


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality(docs: DataFrame, refs: dict[str, Reference] | None = None) -> DataFrame:
    """doc_id, the five figures, base_failed, kept, and how far character
    classes and common words diverge from the language's reference beyond
    chance (class_excess, word_excess; null where not judged), per row.

    ``refs`` are learned from ``docs`` unless given. Null, empty and blank
    texts have no words and fail the base rules. A null language is judged
    by the nearest reference; a language without reference (too few words,
    or an empty corpus) by the base rules alone. Rows that share a doc_id are
    judged one by one; a null doc_id stays null. A text is held whole by its
    task, whatever its length. Other columns are not read.
    """
    refs = references(docs) if refs is None else refs
    return (docs.select(F.col("doc_id").cast("long"), "text", "lang")
            .mapInArrow(_judge(refs), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                      "base_failed boolean, kept boolean, class_excess double, word_excess double"))
