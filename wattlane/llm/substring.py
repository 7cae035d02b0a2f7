"""Exact substring dedup with fixed-block anchors (operator 2).

A window is ``window`` consecutive words of one document. A word goes when
some window that covers it has a word sequence that also starts earlier
(smaller doc_id, or the same document and an earlier start).

1. Texts are dealt once to packs of about ``PACK_BYTES`` by a hash of
   (doc_id, text). The exchange is planned three times with the same
   shape, so Spark runs it once and reuses it.
2. Index and probes: the blocks at word positions 0, b, 2b ... of each
   document (b = window / 2) are the reference blocks; every rolling window
   of b words probes them. A pack sends each of its distinct block hashes
   once, as delta-coded 32-bit values per hash bucket, with two bits: "is a
   reference block here" and "occurs twice here". A passage shared by a
   third of all documents therefore costs one entry a pack, and no bucket
   sees a pair.
3. A window always holds a whole reference block of its own document, so
   it can only repeat where that block was hit from elsewhere. Runs of hit
   blocks are extended to the left and right as far as no unhit block lies
   in between; the windows inside are compared by full 64-bit hash (plus
   the bucket): for each distinct one, the pack with the smallest doc_id
   owns it. What is left of a stretch after this is its maximal exact
   repeat.
4. Packs drop the words of windows that they don't own or that they have
   seen before, and put the kept words together.

Null or blank text: no words, nothing removed, empty kept text. Rows with
the same doc_id are ordered by text; fully equal rows count as one after
the other. A null doc_id sorts last. Anchors only narrow the search: their
32-bit collisions cost work, never a word.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import WordHashes, partitions_for, rolling, text_bytes, tidy

WINDOW = 20
PACK_BYTES = 8 << 20
LAST = np.iinfo(np.int64).max
_LOW = np.uint64(0xFFFFFFFF)


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _unsqueeze(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the top 32 bits: rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _binary(values: list) -> pa.Array:
    return pa.array(values, pa.binary())


class Pack:
    """The documents of one pack in document order, as word hashes."""

    def __init__(self, t: pa.Table):
        ids = t.column("doc_id").to_pylist()
        texts = [x or "" for x in t.column("text").to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = np.array([LAST if ids[i] is None else ids[i] for i in self.order], np.int64)
        self.texts = [texts[i].encode() for i in self.order]
        known = WordHashes()
        hashes = [known.of(x.split()) for x in self.texts]
        self.lengths = np.array([len(h) for h in hashes], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(ids)), self.lengths)
        self.at = np.arange(len(self.hashes)) - (self.ends - self.lengths)[self.doc]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start positions (in the pack) and hashes of all k-word windows
        that stay inside one document."""
        start = np.flatnonzero(self.at + k <= self.lengths[self.doc])
        h = rolling(self.hashes, k)
        return start, h[start] if len(h) else np.zeros(0, np.uint64)


def _anchor_keys(h: np.ndarray, buckets: int) -> np.ndarray:
    return (_bucket(h, buckets) << np.uint64(32)) | (h & _LOW)


def _probes(block: int, buckets: int):
    """Distinct rolling block hashes of a pack, one row per bucket."""
    @tidy
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        p = Pack(t)
        start, h = p.windows(block)
        rolled = p.at[start] % block != 0
        w = np.sort((_anchor_keys(h, buckets) << np.uint64(1)) | rolled.astype(np.uint64))
        v = w >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        ref = (w[first] & np.uint64(1)) == 0
        twice = np.diff(np.append(first, len(v))) > 1
        u = v[first]
        b = (u >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(b, np.arange(buckets + 1))
        rows = []
        for i in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[i], cuts[i + 1])
            d = np.diff((u[s] & _LOW).astype(np.int64), prepend=0)
            rows.append((int(i), int(s.stop - s.start), (d & 0xFFFF).astype("<u2").tobytes(),
                         _squeeze((d >> 16).astype("<u2")), _squeeze(np.packbits(ref[s])), _squeeze(np.packbits(twice[s]))))
        c = list(zip(*rows)) or [()] * 6
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()),
                         *map(_binary, map(list, c[2:]))], names=["pack", "bucket", "n", "low", "high", "ref", "twice"])
    return run


@tidy
def _anchors(t: pa.Table) -> pa.Table:
    """Of one hash bucket: the reference blocks that occur twice or more,
    sent back to the packs that hold them."""
    parts, flags = [], []
    cols = [t.column(c).to_pylist() for c in ("pack", "bucket", "n", "low", "high", "ref", "twice")]
    for _, _, n, low, high, ref, twice in zip(*cols):
        d = np.frombuffer(low, "<u2").astype(np.uint64) + (_unsqueeze(high, "<u2").astype(np.uint64) << np.uint64(16))
        parts.append(np.cumsum(d))
        flags.append((np.unpackbits(_unsqueeze(ref, np.uint8), count=n), np.unpackbits(_unsqueeze(twice, np.uint8), count=n)))
    key = np.concatenate([(v << np.uint64(2)) | (f[0].astype(np.uint64) << np.uint64(1)) | f[1] for v, f in zip(parts, flags)])
    key.sort()
    v = key >> np.uint64(2)
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    many = np.diff(np.append(first, len(v))) > 1
    bits = np.bitwise_or.reduceat(key & np.uint64(3), first)
    hit = v[first[((bits & np.uint64(2)) > 0) & (many | ((bits & np.uint64(1)) > 0))]]
    back = []
    for pack, bucket, v, f in zip(cols[0], cols[1], parts, flags):
        v = v[f[0] > 0]
        v = v[np.isin(v, hit, assume_unique=True)]
        if len(v):
            back.append((pack, bucket, v.astype("<u4").tobytes()))
    c = list(zip(*back)) or [()] * 3
    return pa.table([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), _binary(list(c[2]))], names=["pack", "bucket", "hits"])


def _stretches(window: int, buckets: int):
    """Extended hits of a pack: its distinct candidate windows, each with
    the smallest doc_id that has it here."""
    block = window // 2

    @tidy
    def run(key: tuple[pa.Scalar, ...], t: pa.Table, hits: pa.Table) -> pa.Table:
        rows = []
        if hits.num_rows and t.num_rows:
            p = Pack(t)
            known = np.concatenate([np.frombuffer(h, "<u4").astype(np.uint64) | (np.uint64(b) << np.uint64(32))
                                    for b, h in zip(hits.column("bucket").to_pylist(), hits.column("hits").to_pylist())])
            known.sort()
            start, h = p.windows(block)
            is_ref = p.at[start] % block == 0
            start, h = start[is_ref], _anchor_keys(h[is_ref], buckets)
            i = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.zeros(len(p.hashes) + window, bool)
            hit[start[known[i] == h]] = True
            start, h = p.windows(window)
            own = start + (-p.at[start]) % block              # its first whole reference block
            ok = hit[own] & ((p.at[start] % block != 0) | (window < 2 * block) | hit[own + block])
            start, h = start[ok], h[ok]
            o = np.argsort(h, kind="stable")                  # ties: document order
            h, start = h[o], start[o]
            first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            h, ids = h[first], p.ids[p.doc[start[first]]]
            cuts = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
            rows = [(int(b), h[cuts[b]:cuts[b + 1]].tobytes(), ids[cuts[b]:cuts[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(cuts))]
        c = list(zip(*rows)) or [()] * 3
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array(c[0], pa.int32()), _binary(list(c[1])), _binary(list(c[2]))],
                        names=["pack", "bucket", "hashes", "ids"])
    return run


@tidy
def _owners(t: pa.Table) -> pa.Table:
    """Of one hash bucket: to each pack the windows it does not own."""
    packs = t.column("pack").to_numpy()
    o = np.argsort(packs, kind="stable")
    hs, ids = t.column("hashes").to_pylist(), t.column("ids").to_pylist()
    hs = [np.frombuffer(hs[i], np.uint64) for i in o]
    h, d = np.concatenate(hs), np.concatenate([np.frombuffer(ids[i], np.int64) for i in o])
    src = np.repeat(packs[o], [len(x) for x in hs])
    by = np.lexsort((d, h))                                   # stable: ties go to the smaller pack
    h, src = h[by], src[by]
    lost = np.concatenate([[False], h[1:] == h[:-1]])
    h, src = h[lost], src[lost]
    by = np.argsort(src, kind="stable")
    h, src = h[by], src[by]
    names, first = np.unique(src, return_index=True)
    return pa.table([pa.array(names, pa.int32()), _binary([x.tobytes() for x in np.split(h, first[1:])] if len(names) else [])],
                    names=["pack", "lost"])


def _kept(window: int, keep: Sequence[str], schema: pa.Schema):
    @tidy
    def run(key: tuple[pa.Scalar, ...], t: pa.Table, lost: pa.Table) -> pa.Table:
        p = Pack(t)
        start, h = p.windows(window)
        gone = np.zeros(len(h), bool)
        if len(h):
            o = np.argsort(h, kind="stable")
            gone[o[1:]] = h[o[1:]] == h[o[:-1]]
            if lost.num_rows:
                known = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in lost.column("lost").to_pylist()]))
                gone |= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        cover = np.zeros(len(p.hashes) + 1, np.int64)
        np.add.at(cover, start[gone], 1)
        np.add.at(cover, start[gone] + window, -1)
        drop = np.cumsum(cover)[:-1] > 0
        texts, removed, at = [], [], 0
        for text, n in zip(p.texts, p.lengths):
            d = drop[at:at + n]
            words = text.split()
            removed.append(int(d.sum()))
            texts.append(b" ".join(compress(words, (~d).tolist()) if removed[-1] else words).decode())
            at += n
        rest = t.take(pa.array(p.order, pa.int64()))
        cols = [rest.column(c) for c in ("doc_id", *keep)]
        return pa.table([*cols, pa.array(p.lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                        names=["doc_id", *keep, "n_words", "n_removed", "kept_text"]).cast(schema)
    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the ``keep`` columns, n_words, n_removed and kept_text (the
    kept words joined by one space) for every row."""
    if window < 2:
        raise ValueError("window must be 2 words or more")
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    keep = list(keep)
    n = partitions_for(spark, text_bytes(docs), PACK_BYTES)
    src = docs.select(F.col("doc_id").cast("long"), "text", *keep)
    packs = (src.withColumn("pack", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
             .repartition(n, "pack"))
    block = max(window // 2, 1)
    hits = (packs.groupBy("pack")
            .applyInArrow(_probes(block, n), "pack int, bucket int, n int, low binary, high binary, ref binary, twice binary")
            .groupBy("bucket").applyInArrow(_anchors, "pack int, bucket int, hits binary"))
    lost = (packs.groupBy("pack").cogroup(hits.groupBy("pack"))
            .applyInArrow(_stretches(window, n), "pack int, bucket int, hashes binary, ids binary")
            .groupBy("bucket").applyInArrow(_owners, "pack int, lost binary"))
    out = src.select("doc_id", *keep, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
                     F.lit("").alias("kept_text")).schema
    return (packs.groupBy("pack").cogroup(lost.groupBy("pack"))
            .applyInArrow(_kept(window, keep, to_arrow_schema(out)), out))
