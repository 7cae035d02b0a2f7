"""Phrase collocations from an FM-index per shard (operator 12).

1. A task turns its texts into shards of about ``SHARD_WORDS`` word ids (id 0
   ends a piece, ids differ between languages).
2. Words that occur ``min_count`` times in all shards stay; each shard puts
   an end of piece in place of the others. (No phrase with a rarer word can
   be frequent.)
3. For 2, 3, 4 words in turn every shard orders its rotations and those of
   the reversed text by as many words as a phrase of the turn before has,
   which gives the two Burrows-Wheeler transforms of that depth. Each
   frequent phrase is a pair of equally long intervals in them. The symbols
   in its interval of the reversed transform extend it to the right, those in
   the other to the left; either extension gives the longer phrase's start in
   the forward order, and phrases that both sides reach have a frequent
   prefix and a frequent suffix. Their counts are the interval sizes.
4. A phrase is named by the numbers of its prefix and its suffix, so from the
   second turn on shards exchange (prefix, suffix, count) and no text. A
   shard sends each bucket (by hash of the name) its sorted names and counts
   as one compressed message of a few bytes an entry; the bucket adds them
   over all shards, numbers the frequent ones and answers each shard with the
   places and numbers of its own. A phrase has at most one entry a shard, so
   a bucket's size follows from the texts' size and not from a phrase's count.

Cuts and overlaps are joins of the few frequent phrases along these numbers:
the counts of all beginnings and ends of a phrase come with its prefix and
suffix, and an extension by one word reports its count to both. (What a
longer phrase covers, its part that is one word longer covers at least as
often, so one word is enough.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattlane.llm.common import mix, portions, stage, text_bytes, tidy, unstage

MIN_COUNT = 30
MAX_WORDS = 4
COVERED = (4, 5)               # an extension with 4/5 of the count covers a phrase
TOP = 2000
UND = "und"
SHARD_WORDS = 1_200_000
SHARD_BYTES = 64 << 20         # of text, should its words be very long
BUCKET_BYTES = 16 << 20        # of text for each bucket of phrases
WORD_BUCKET_BYTES = 64 << 20   # and of words

END = b"."                     # no word holds it
_MAP = bytes(ord(".") if chr(i) in ".,;:!?\n\x0b\x0c\r" else i for i in range(256)).lower()

# Rows of a shard: a message to a bucket (its first entry's place in the
# shard), or, under these bucket numbers, what the shard keeps.
IDS, STATE = -1, -2
_SHARD = "shard long, bucket int, first int, body binary"
# Rows of a bucket: an answer to a shard, or (shard null) a frequent name.
_BUCKET = "shard long, places binary, numbers binary, number long, prefix long, suffix long, f long, lang string, word string"


def _squeeze(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    v = np.ascontiguousarray(values)
    return zstandard.compress(v.view(np.uint8).reshape(-1, v.itemsize).T.tobytes(), 1)


def _unsqueeze(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _join(*parts: bytes) -> bytes:
    return b"".join([np.array([len(parts), *map(len, parts)], "<i8").tobytes(), *parts])


def _split(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    ends = 8 * (n + 1) + np.cumsum([0, *np.frombuffer(blob, "<i8", n, 8)])
    return [blob[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())],
                                      names=["shard", "bucket", "first", "body"])


def tokens(text: str) -> list[bytes]:
    """Words and ends of pieces."""
    return text.encode().translate(_MAP).replace(END, b" . ").split()


class _Shard:
    """Word ids of some texts and their dictionaries."""

    class _Ids(dict):
        def __init__(self, shard: _Shard):
            self.shard = shard
            self[END] = 0

        def __missing__(self, word: bytes) -> int:
            self.shard.kinds += 1
            i = self[word] = self.shard.kinds
            return i

    def __init__(self):
        self.kinds = 0
        self.ids: dict[str, _Shard._Ids] = {}
        self.parts: list[np.ndarray] = []
        self.size = self.bytes = 0

    def add(self, lang: str, text: str) -> None:
        if lang not in self.ids:
            self.ids[lang] = self._Ids(self)
        words = tokens(text)
        ids = np.empty(len(words) + 1, np.int32)
        ids[:-1] = np.fromiter(map(self.ids[lang].__getitem__, words), np.int32, len(words))
        ids[-1] = 0
        self.parts.append(ids)
        self.size += len(ids)
        self.bytes += len(text)

    def rows(self, shard: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """The ids, the commonest word first (small numbers compress well),
        with each word's place in the order of (bucket, name), and in that
        order the messages: names (language, a blank, word) and counts."""
        names = []
        for lang, known in self.ids.items():
            head = lang.encode() + b" "
            for word, i in known.items():
                if i:
                    name = head + word
                    names.append((xxhash.xxh3_64_intdigest(name) % buckets, name, i))
        names.sort()
        ids = _short(np.concatenate([np.zeros(1, np.int32), *self.parts]))
        n = np.bincount(ids, minlength=self.kinds + 1)[1:]
        ranked = n.argsort(kind="stable")[::-1]
        rank, place = np.zeros(self.kinds + 1, np.int32), np.empty(self.kinds, np.int32)
        rank[ranked + 1] = np.arange(1, self.kinds + 1)
        order = np.fromiter((x[2] for x in names), np.int64, len(names)) - 1
        place[order] = np.arange(self.kinds)
        yield _rows([(shard, IDS, 0, _join(_squeeze(rank[ids]), _squeeze(place[ranked])))])
        n = n[order]
        bucket = np.fromiter((x[0] for x in names), np.int64, len(names))
        for b, lo, hi in _groups(bucket):
            yield _rows([(shard, b, lo, _join(_squeeze(n[lo:hi]), _squeeze(np.fromiter((len(x[1]) for x in names[lo:hi]), np.int64, hi - lo)),
                                              zstandard.compress(b"".join(x[1] for x in names[lo:hi]), 1)))])


def _groups(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of each run of equal values."""
    if len(sorted_):
        first = np.flatnonzero(np.diff(sorted_, prepend=sorted_[0] - 1))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(sorted_)]):
            yield int(sorted_[lo]), lo, hi


def _short(ids: np.ndarray) -> np.ndarray:
    """Without ends of pieces that follow another."""
    return ids[np.concatenate([[True], (ids[1:] != 0) | (ids[:-1] != 0)])] if len(ids) else ids


def _shards(shard_words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        shard = _Shard()
        for b in portions(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                shard.add(lang, text)
                if shard.size >= shard_words or shard.bytes >= SHARD_BYTES:
                    yield from shard.rows(number, buckets)
                    number, shard = number + 1, _Shard()
        if shard.kinds:
            yield from shard.rows(number, buckets)
    return run


class ContextBWT:
    """The two Burrows-Wheeler transforms of ``ids`` (which begin and end
    with 0), rotations ordered by their first ``depth`` symbols: ``before``
    are the symbols before the rotations of the text, ``after`` the symbols
    after those of the reversed text. Enough to extend any phrase of
    ``depth`` symbols to either side."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.n = len(ids)
        self.symbols = int(ids.max(initial=0)) + 1
        self.before = np.roll(ids, 1)[self._order([np.roll(ids, -k) for k in range(depth)])]
        self.after = np.roll(ids, -1)[self._order([np.roll(ids, k) for k in range(depth)])]

    def _order(self, keys: list[np.ndarray]) -> np.ndarray:
        """Rows by the first key, then the second ... (the rank of what is
        sorted so far and the next symbol, packed over the row)."""
        rank = keys[0].astype(np.int64)
        order, most = packed_order(rank, self.symbols), self.symbols
        for key in keys[1:]:
            both = rank * self.symbols + key
            order = packed_order(both, most * self.symbols)
            step = np.diff(both[order], prepend=-1) != 0
            rank = np.empty(self.n, np.int64)
            rank[order] = np.cumsum(step) - 1
            most = int(step.sum())
        return order

    @staticmethod
    def starts(transform: np.ndarray) -> np.ndarray:
        """For every row the row that the LF mapping takes it to."""
        out = np.empty(len(transform), np.int64)
        out[packed_order(transform.astype(np.int64), int(transform.max(initial=0)) + 1)] = np.arange(len(transform))
        return out


def packed_order(key: np.ndarray, most: int) -> np.ndarray:
    """Stable argsort of a non-negative key under ``most``."""
    bits = max(len(key) - 1, 1).bit_length()
    if most << bits < 1 << 63:
        packed = (key << bits) | np.arange(len(key))
        packed.sort()
        return packed & ((1 << bits) - 1)
    return key.argsort(kind="stable")


def extensions(transform: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """All one-symbol extensions of the intervals [start, start + size) of a
    transform: (interval, count, rows of smaller symbols in the interval,
    first row the LF mapping gives)."""
    total = int(size.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 4
    which = np.repeat(np.arange(len(start)), size)
    rows = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + start[which]
    symbol = transform[rows].astype(np.int64)
    most = int(transform.max()) + 1
    key = which * most + symbol
    order = packed_order(key, len(start) * most)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(np.append(first, total))
    interval = key[first] // most
    smaller = first - (np.cumsum(size) - size)[interval]
    real = key[first] % most != 0                        # ends of pieces extend nothing
    lf = ContextBWT.starts(transform)[rows[order[first]]]
    return interval[real], count[real], smaller[real], lf[real]


def extend(ids: np.ndarray, depth: int, start: np.ndarray, mirror: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """The phrases one word longer than the given ones (of ``depth`` words:
    starts in the forward and the reversed order, sizes, numbers) whose
    prefix and suffix are given: start, mirror, size, prefix and suffix
    numbers."""
    bwt = ContextBWT(ids, depth)
    by, n, smaller, lf = extensions(bwt.after, mirror, size)
    right_start, right_mirror = start[by] + smaller, lf
    qy, _, _, left_start = extensions(bwt.before, start, size)
    _, r, q = np.intersect1d(right_start, left_start, assume_unique=True, return_indices=True)
    return right_start[r], right_mirror[r], n[r], number[by[r]], number[qy[q]]


def _placed(found: tuple[np.ndarray, ...], buckets: int) -> tuple[np.ndarray, ...]:
    """Phrases in the order of (bucket, prefix, suffix), with the bucket."""
    _, _, _, prefix, suffix = found
    with np.errstate(over="ignore"):
        bucket = (mix(prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + suffix.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((suffix, prefix, bucket))
    return tuple(x[order] for x in (*found, bucket))


def _messages(shard: int, found: tuple[np.ndarray, ...], keep: bool) -> pa.Table:
    """A message for each bucket, and with ``keep`` what the shard needs of
    these phrases in the next turn."""
    start, mirror, n, prefix, suffix, bucket = found
    rows = [(shard, STATE, 0, _join(*(_squeeze(x.astype(np.int32)) for x in (start, mirror, n))))] if keep else []
    for b, lo, hi in _groups(bucket):
        rows.append((shard, b, lo, _join(_squeeze(n[lo:hi]), _squeeze(np.diff(prefix[lo:hi], prepend=0)), _squeeze(suffix[lo:hi]))))
    return pa.Table.from_batches([_rows(rows)])


def _answers(known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(places, numbers) of a shard's frequent names, by place."""
    if not known.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.concatenate([_unsqueeze(x, np.int32) for x in known.column("places").to_pylist()]).astype(np.int64)
    numbers = np.concatenate([_unsqueeze(x, np.int64) for x in known.column("numbers").to_pylist()])
    order = places.argsort()
    return places[order], numbers[order]


def _kept(rows: pa.Table, bucket: int) -> bytes | None:
    i = np.flatnonzero(rows.column("bucket").to_numpy() == bucket)
    return rows.column("body")[int(i[0])].as_py() if len(i) else None


def _first_pairs(ids: np.ndarray, numbers: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    size = np.bincount(ids, minlength=len(numbers) + 1)
    start = (np.cumsum(size) - size)[1:]
    return _placed(extend(ids, 1, start, start, size[1:], numbers), buckets)


def _pairs(buckets: int):
    """Frequent words of a shard -> its shortened ids with the words' numbers,
    and its pairs."""
    @tidy
    def run(key: tuple[pa.Scalar, ...], shard: pa.Table, known: pa.Table) -> pa.Table:
        places, numbers = _answers(known)
        body = _kept(shard, IDS)
        if body is None or not len(places):
            return pa.Table.from_batches([_rows([])])
        ids, place = (_unsqueeze(x, np.int32) for x in _split(body))
        number = np.full(len(place), -1, np.int64)
        number[places] = numbers
        number = number[place]
        frequent = number >= 0
        symbol = np.append(0, np.where(frequent, np.cumsum(frequent), 0)).astype(np.int32)
        ids, number = _short(symbol[ids]), number[frequent]
        kept = pa.Table.from_batches([_rows([(key[0].as_py(), IDS, 0, _join(_squeeze(ids), _squeeze(number)))])])
        return pa.concat_tables([kept, _messages(key[0].as_py(), _first_pairs(ids, number, buckets), False)])
    return run


def _longer(depth: int, buckets: int, keep: bool):
    """Frequent phrases of ``depth`` words of a shard -> those one longer.
    Pairs are found again, as the shard's words know their numbers; of longer
    candidates the shard has kept the intervals."""
    @tidy
    def run(key: tuple[pa.Scalar, ...], shard: pa.Table, known: pa.Table) -> pa.Table:
        places, numbers = _answers(known)
        body, state = _kept(shard, IDS), _kept(shard, STATE)
        if body is None or not len(places):
            return pa.Table.from_batches([_rows([])])
        ids, words = _split(body)
        ids = _unsqueeze(ids, np.int32)
        found = _first_pairs(ids, _unsqueeze(words, np.int64), buckets)[:3] if depth == 2 else [_unsqueeze(x, np.int32) for x in _split(state)]
        start, mirror, size = (x[places].astype(np.int64) for x in found)
        order = start.argsort()
        return _messages(key[0].as_py(), _placed(extend(ids, depth, start[order], mirror[order], size[order], numbers[order]), buckets), keep)
    return run


def _bucket_rows(bucket: int, messages: pa.Table, group: np.ndarray, f: np.ndarray, lengths: list[int], min_count: int, names) -> pa.Table:
    """The frequent groups of a bucket's entries as names (``names(frequent)``
    gives their columns), and the answers."""
    frequent = np.flatnonzero(f >= min_count)
    number = np.full(len(f), -1, np.int64)
    number[frequent] = (bucket << 40) | np.arange(len(frequent))
    shards, first = messages.column("shard").to_pylist(), messages.column("first").to_pylist()
    told, ends = number[group], np.cumsum([0, *lengths])
    rows = []
    for shard, at, lo, hi in zip(shards, first, ends[:-1], ends[1:]):
        mine = np.flatnonzero(told[lo:hi] >= 0)
        if len(mine):
            rows.append((shard, _squeeze((mine + at).astype(np.int32)), _squeeze(told[lo:hi][mine])))
    c = list(zip(*rows)) or [()] * 3
    k, m = len(rows), len(frequent)
    prefix, suffix, lang, word = names(frequent)

    def column(head, tail, kind) -> pa.Array:
        return pa.chunked_array([pa.nulls(k, kind) if head is None else pa.array(head, kind), pa.nulls(m, kind) if tail is None else pa.array(tail, kind)])
    return pa.table([column(c[0], None, pa.int64()), column(c[1], None, pa.binary()), column(c[2], None, pa.binary()), column(None, number[frequent], pa.int64()),
                     column(None, prefix, pa.int64()), column(None, suffix, pa.int64()), column(None, f[frequent], pa.int64()),
                     column(None, lang, pa.string()), column(None, word, pa.string())],
                    names=["shard", "places", "numbers", "number", "prefix", "suffix", "f", "lang", "word"])


def _add_words(min_count: int):
    """Also a row (number null) with the bucket's words of each language."""
    @tidy
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        group, counts, lengths = [], [], []
        for body in t.column("body").to_pylist():
            n, size, raw = _split(body)
            ends, raw = np.cumsum(_unsqueeze(size, np.int64)).tolist(), zstandard.decompress(raw)
            group += [known.setdefault(raw[a:b], len(known)) for a, b in zip([0, *ends], ends)]
            counts.append(_unsqueeze(n, np.int64))
            lengths.append(len(ends))
        group = np.array(group, np.int64)
        f = np.zeros(len(known), np.int64)
        np.add.at(f, group, np.concatenate(counts))
        words = [w.rsplit(b" ", 1) for w in known]

        def names(frequent):
            return None, None, [words[i][0].decode() for i in frequent], [words[i][1].decode() for i in frequent]
        out = _bucket_rows(key[0].as_py(), t, group, f, lengths, min_count, names)
        totals: dict[str, int] = {}
        for (lang, _), n in zip(words, f.tolist()):
            totals[lang.decode()] = totals.get(lang.decode(), 0) + n
        rows = {c: [None] * len(totals) for c in out.column_names} | {"lang": list(totals), "f": list(totals.values())}
        return pa.concat_tables([out, pa.table(rows, out.schema)])
    return run


def _add_phrases(min_count: int):
    @tidy
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        parts = [_split(x) for x in t.column("body").to_pylist()]
        n = [_unsqueeze(p[0], np.int64) for p in parts]
        prefix = np.concatenate([np.cumsum(_unsqueeze(p[1], np.int64)) for p in parts])
        suffix = np.concatenate([_unsqueeze(p[2], np.int64) for p in parts])
        order = np.lexsort((suffix, prefix))
        p, s = prefix[order], suffix[order]
        first = np.flatnonzero((np.diff(p, prepend=-1) != 0) | (np.diff(s, prepend=-1) != 0))
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        f = np.add.reduceat(np.concatenate(n)[order], first)
        return _bucket_rows(key[0].as_py(), t, group, f, [len(x) for x in n], min_count, lambda frequent: (p[first[frequent]], s[first[frequent]], None, None))
    return run


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, shard_words: int = SHARD_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1, 2 ... ``max_words`` words (number, prefix,
    suffix, f, lang, phrase, last word, and the counts of their beginnings
    and ends by length), and the number of words of every language."""
    size = text_bytes(docs)
    buckets, word_buckets = size // BUCKET_BYTES + 1, size // WORD_BUCKET_BYTES + 1
    found = stage(docs.select(F.coalesce("lang", F.lit(UND)).alias("lang"), "text").filter("text IS NOT NULL")
                  .mapInArrow(_shards(shard_words, word_buckets), _SHARD), "collocation-shards")
    told = stage(found.filter("bucket >= 0").groupBy("bucket").applyInArrow(_add_words(min_count), _BUCKET), "collocation-words")
    totals = told.filter("shard IS NULL AND number IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    none = F.expr("cast(array() as array<bigint>)")
    levels = [told.filter("number IS NOT NULL").select("number", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f",
                                                       none.alias("heads"), none.alias("tails"))]
    first, kept = found, found.filter(F.col("bucket") == IDS)
    for depth in range(1, max_words):
        answers = told.filter("shard IS NOT NULL").select("shard", "places", "numbers")
        work = _pairs(buckets) if depth == 1 else _longer(depth, buckets, depth + 1 < max_words)
        found = stage(kept.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(work, _SHARD), f"collocation-{depth + 1}")
        if depth == 1:
            unstage(first)                                   # the shortened ids stand for them from here on
            texts = found.filter(F.col("bucket") == IDS)
        kept = texts.unionByName(found.filter(F.col("bucket") == STATE))
        told = stage(found.filter("bucket >= 0").groupBy("bucket").applyInArrow(_add_phrases(min_count), _BUCKET), f"collocation-frequent-{depth + 1}")
        below = levels[-1]
        p = below.select(F.col("number").alias("prefix"), "lang", F.col("phrase").alias("_begin"), "heads", F.col("f").alias("_head"))
        s = below.select(F.col("number").alias("suffix"), "last", "tails", F.col("f").alias("_tail"))
        level = (told.filter("number IS NOT NULL").select("number", "prefix", "suffix", "f").join(p, "prefix").join(s, "suffix")
                 .select("number", "prefix", "suffix", "lang", F.concat_ws(" ", "_begin", "last").alias("phrase"), "last", "f",
                         F.concat("heads", F.array("_head")).alias("heads"), F.concat(F.array("_tail"), "tails").alias("tails")))
        levels.append(stage(level, f"collocation-level-{depth + 1}"))
    return levels, totals


# Decimals of 38 digits: the products may pass 64 bits.
_CUTS = """array_min(transform(sequence(1, size(heads)), k -> struct(
  (cast(f as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(heads[k - 1] as decimal(20,0)) + cast(tails[k - 1] as decimal(20,0))) as score,
  k as k, heads[k - 1] as l, tails[k - 1] as r)))"""


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``max_words`` words by
    score: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line
    breaks and these into words at blanks and tabs. A null text has no words;
    a null lang counts as ``und``. Rows that share a doc_id are different
    texts; no column but text and lang is read. Equal scores are ordered by
    count, then phrase (byte order). A text is held whole by its task,
    whatever its length. No words, or no frequent phrase: no rows. The number
    of shards (of ``shard_words`` ids or the rest of a task) changes nothing.
    """
    if max_words < 2:
        raise ValueError("a collocation has two words or more")
    levels, totals = frequent_phrases(docs, min_count, max_words, shard_words)
    out = None
    for at in range(1, len(levels)):
        here = levels[at]
        if at + 1 < len(levels):
            above = levels[at + 1]
            covers = (above.select(F.col("prefix").alias("number"), "f").unionByName(above.select(F.col("suffix").alias("number"), "f"))
                      .groupBy("number").agg(F.max("f").alias("_more")))
            share = (F.col("_more").cast("decimal(20,0)") * COVERED[1]) >= (F.col("f").cast("decimal(20,0)") * COVERED[0])
            here = here.join(covers, "number", "left").filter(~F.coalesce(share, F.lit(False)))
        here = here.select("lang", "phrase", F.col("f").alias("a"), F.expr(_CUTS).alias("c"))
        out = here if out is None else out.unionByName(here)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = (out.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
