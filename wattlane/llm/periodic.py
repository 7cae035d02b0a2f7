"""Periodic runs in texts by online dyadic square catching (operator 13).

A run is a stretch of consecutive words with smallest period q, of at least
``max(min_length, 3 q)`` words, that no neighbouring word extends.

``SquareCatcher`` reads a stream of word ids. For every class of periods
[2^c, 2^(c+1)) it keeps catchers over the completed blocks of 2^c words (8
at least): each appended word closes one suffix of that length a class, which
is compared with the one block that ends such a period earlier. A stretch
that repeats with period q holds such a block whole, so no run is missed. A
match that lies in a known run of a dividing period is part of that run. The
others must go on for half of what a run still lacks, to the left or to the
right; then the square is extended word by word to both sides and merged into
the runs. Squares that touch the end of the stream are taken up again by the
next append. Suffixes are compared by dyadic 64-bit names (the name of
2^(c+1) words is mixed from its halves' names); extension compares the words
themselves, so no collision makes up or stretches a run.

Texts are read in one pass without a shuffle. Short texts of a batch share a
stream, with separators that equal no word between them; a long text is a
stream of its own, appended in portions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import mix, portions

MIN_LENGTH = 24
EXPONENT = 3
BLOCK = 8                      # words of the shortest block
PORTION = 1 << 17              # words appended at a time
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)
_DEPTH = BLOCK.bit_length() - 1


class _Level:
    """Names of the suffixes of ``size`` words, as far back as the catchers
    of that size look."""

    def __init__(self, size: int):
        self.size = size
        self.back = 8 * size
        self.names = np.zeros(0, np.uint64)
        self.first = 0                          # where the suffix of names[0] ends

    def push(self, names: np.ndarray, end: int) -> None:
        self.names = np.concatenate([self.names, names]) if len(self.names) else names
        self.first = end - len(self.names)

    def at(self, ends: np.ndarray) -> np.ndarray:
        return self.names[ends - self.first]

    def trim(self) -> None:
        if len(self.names) > 2 * self.back:
            self.first += len(self.names) - self.back
            self.names = self.names[-self.back:].copy()


class SquareCatcher:
    """Runs of a stream of word ids (0 or more; a negative id that occurs
    once separates texts). ``longest``: words of its longest text."""

    def __init__(self, longest: int, min_length: int = MIN_LENGTH):
        if min_length < MIN_LENGTH:
            raise ValueError(f"a run of fewer than {MIN_LENGTH} words need not hold a whole block")
        self.min_length = min_length
        self.limit = longest // EXPONENT        # longest period
        self.words = np.zeros(0, np.int64)
        self.n = 0
        self.levels = [_Level(1 << k) for k in range(max(self.limit.bit_length(), _DEPTH + 1))]
        self.found: dict[tuple[int, int], int] = {}        # (start, period) -> end
        self.open: dict[int, list[tuple[int, int]]] = {}   # class -> matches (end, period) at the stream's end

    def append(self, ids: np.ndarray) -> None:
        old, new = self.n, self.n + len(ids)
        if new > len(self.words):
            grown = np.empty(max(new, 2 * old), np.int64)
            grown[:old] = self.words[:old]
            self.words = grown
        self.words[old:new] = ids
        self.n = new
        for (start, p), end in self.found.items():
            if end == old:
                self.found[start, p] = self._right(old - 1, p)
        if self.limit < 1:
            return
        names = mix(ids.astype(np.uint64) * _B + _A)
        for k, level in enumerate(self.levels):
            level.push(names, new)
            for c in range(_DEPTH + 1) if k == _DEPTH else [k] if k > _DEPTH else []:
                if 1 << c <= self.limit:
                    self._advance(c, level, old)
            size = level.size
            ends = np.arange(max(old, 2 * size - 1), new)
            names = np.zeros(new - old, np.uint64)
            if len(ends) and k + 1 < len(self.levels):
                names[ends - old] = mix(level.at(ends - size) * _A + level.at(ends) * _B + np.uint64(size))
        for level in self.levels:
            level.trim()

    def _advance(self, c: int, level: _Level, old: int) -> None:
        """The suffixes that the new words close against the blocks of one
        class of periods."""
        size, least, most = level.size, 1 << c, min(2 << c, self.limit + 1)
        t = np.arange(max(old, size - 1 + least), self.n)
        block = (t - least + 1) // size * size - 1          # last block that ends ``least`` or more before
        p = t - block
        ok = p < most
        t, p, block = t[ok], p[ok], block[ok]
        hit = level.at(t) == level.at(block)
        t, p = t[hit], p[hit]
        if again := self.open.pop(c, None):
            more = np.array(again, np.int64)
            t, p = np.concatenate([more[:, 0], t]), np.concatenate([more[:, 1], p])
        if not len(t):
            return
        own = np.zeros(len(t), bool)
        first = int((t - p).min()) - size
        for (start, q), end in self.found.items():
            if end > first and q < most:
                own |= (t < end) & (t - p - size + 1 >= start) & (p % q == 0)
        t, p = t[~own], p[~own]
        if not len(t):
            return
        lack = np.maximum(self.min_length - p, (EXPONENT - 1) * p)
        half = np.maximum(lack - size + 1, 0) // 2
        left = t - half - p >= size - 1
        left[left] = level.at((t - half)[left]) == level.at((t - half - p)[left])
        known = t + half < self.n
        right = known.copy()
        right[known] = level.at((t + half)[known]) == level.at((t + half - p)[known])
        late = ~left & ~known
        again = [(int(a), int(b)) for a, b in zip(t[late], p[late])]
        t, p = t[left | right], p[left | right]
        order = np.lexsort((t, p))
        last_p, reach = 0, 0
        for at, q in zip(t[order].tolist(), p[order].tolist()):
            if q == last_p and at < reach:
                continue                                   # the same square again
            end, start = self._right(at, q), self._left(at, q)
            last_p, reach = q, end
            if end - start + q >= max(self.min_length, EXPONENT * q):
                self.found[start - q, q] = end
            elif end == self.n and end - start >= size:
                again.append((end - 1, q))
        if again:
            self.open[c] = again

    def _right(self, at: int, p: int) -> int:
        """Where the words after ``at`` stop repeating those p before."""
        w, at, step = self.words[:self.n], at + 1, 64
        while at < self.n:
            end = min(at + step, self.n)
            differ = w[at:end] != w[at - p:end - p]
            if differ.any():
                return at + int(differ.argmax())
            at, step = end, 2 * step
        return self.n

    def _left(self, at: int, p: int) -> int:
        """First of the words up to ``at`` that repeat those p before."""
        w, end, step = self.words, at + 1, 64
        while end > p:
            start = max(end - step, p)
            differ = w[start:end] != w[start - p:end - p]
            if differ.any():
                return end - int(differ[::-1].argmax())
            end, step = start, 2 * step
        return end

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period."""
        return sorted((start, end - start, p) for (start, p), end in self.found.items())


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def text_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """The runs of each text (a list of words). Texts of similar length share
    streams of about ``PORTION`` words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i in range(len(texts)) if len(texts[i]) >= min_length), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        stream, total = [], 0
        while at < len(order) and (not stream or total + len(texts[order[at]]) <= PORTION):
            stream.append(order[at])
            total += len(texts[order[at]]) + 1
            at += 1
        known, starts = _Ids(), []
        ids = np.empty(total, np.int64)
        end = 0
        for k, i in enumerate(stream):
            n = len(texts[i])
            starts.append(end)
            ids[end:end + n] = np.fromiter(map(known.__getitem__, texts[i]), np.int64, n)
            ids[end + n] = -1 - k
            end += n + 1
        catcher = SquareCatcher(len(texts[stream[-1]]), min_length)
        for lo in range(0, total, PORTION):
            catcher.append(ids[lo:lo + PORTION])
        for start, length, p in catcher.runs():
            k = int(np.searchsorted(starts, start, "right")) - 1
            out[stream[k]].append((start - starts[k], length, p))
    return out


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; the
    first by start, then period, of several."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, p in runs:
            keep[start + p:start + length] = False
        words = list(compress(words, keep.tolist()))
    return b" ".join(words)


def stutter(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For a tenth of all ids (by crc32) the words from a place on repeat the
    first few of them up to the end; place and period follow from the id."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _finder(min_length: int, rewrite: Rewrite | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            ids = b.column("doc_id").to_pylist()
            texts = [(x or "").encode().split() for x in b.column("text").to_pylist()]
            if rewrite:
                texts = [rewrite(i, w) for i, w in zip(ids, texts)]
            runs = text_runs(texts, min_length)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            best = [greatest(r) for r in runs]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), struct),
                 *(pa.array([r and r[k] for r in best], pa.int64()) for k in range(3)),
                 pa.array([r and 1000 * r[1] // r[2] for r in best], pa.int64()),
                 pa.array([collapse(w, r).decode() for w, r in zip(texts, runs)], pa.string())],
                names=["doc_id", "n_words", "runs", "start", "length", "period", "exponent_milli", "collapsed_text"])
    return run


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, rewrite: Rewrite | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (start, length, period by
    start, then period), the run with the greatest exact length / period
    (start, length, period, exponent_milli; null without runs) and
    collapsed_text (the words that no run repeats, joined by one space).

    ``rewrite`` (doc_id, words) -> words is applied before. Words are
    maximal stretches without ASCII white space. Null, empty and blank texts
    have no words and no runs; rows that share a doc_id are judged one by
    one; a null doc_id stays null. Other columns are not read. A text is held
    whole by its task, whatever its length.
    """
    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(_finder(min_length, rewrite),
                        "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, start long, "
                        "length long, period long, exponent_milli long, collapsed_text string"))


def digests(found: DataFrame) -> DataFrame:
    """``periodic_runs`` with the runs and the collapsed text as SHA-256."""
    line = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", "exponent_milli",
                        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
