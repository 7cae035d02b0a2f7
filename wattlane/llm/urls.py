"""URL filter: rules first, then a character language-model ratio (operator 7).

Rules name a host and a path start; a rule fits its host, all subdomains
and every path that starts with its path, and the longest fitting rule
decides. URLs that a rule decides train two Markov models over characters,
one of accepted and one of rejected URLs. Their order varies from 0 to
``ORDER``: each order is smoothed with the next lower one,
P_k(s | c) = (n(c, s) + A P_{k-1}(s | c')) / (n(c) + A). All other URLs are
judged by the mean log-likelihood difference per character against a
threshold, calibrated for balanced accuracy on a quarter of the labelled
URLs under a model of the other three; the final model counts all.

Counts cover every labelled URL (equal URLs once). They are exact, one row
per (order, context, character) and per (order, context) of the corpus,
summed by Spark; the table grows with the corpus and is never held in one
place. URLs to score travel in packs of bounded size: a pack sends each of
its distinct n-grams once, a join brings their counts back. Null URLs and such without ``://`` have empty
host and path and no rule; they are scored as they are (null as empty,
score 0). Without labelled URLs of both classes everything is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import mix, stage, tidy

# Fixed values: (verdict, host, path start).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ORDER = 5
STRENGTH = 2.0
PACK = 1 << 18  # bytes of the URLs that are scored together
COUNTS = ("trial_0", "trial_1", "all_0", "all_1")  # per class: counts without the calibration URLs, all counts
BIN = 0.01
SPAN = 1000  # bins on each side of 0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each position, keys of (context, character), keys of the
    context), the latter two as (order + 1) x positions. A key is the number
    (order, context, character) in base 257, so different n-grams never
    share one; character 0 stands for the context alone."""
    if (order + 1) * 257 ** (order + 1) >= 1 << 63:
        raise ValueError(f"order {order} does not fit 64-bit keys")
    lengths = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    b = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    at = np.arange(len(b)) - (np.cumsum(lengths) - lengths)[doc]
    contexts = []
    context = np.zeros(len(b), np.int64)
    for k in range(order + 1):
        if k:
            back = np.zeros(len(b), np.int64)
            back[k:] = b[:-k]
            back[at < k] = 0                       # before the start: one sign
            context = context * 257 + back
        contexts.append((k * 257 ** order + context) * 257)
    contexts = np.array(contexts)
    return doc, contexts + b, contexts


def _cells(texts: list[bytes], order: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_grams`` with the keys hashed to the cells of a small count table."""
    doc, *keys = _grams(texts, order)
    grams, contexts = ((mix(k.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64) for k in keys)
    return doc, grams, contexts


def _slices(texts: list[bytes], chars: int = PACK) -> Iterator[slice]:
    """Runs of texts of about ``chars`` bytes, at least one text each."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > chars:
            yield slice(start, i)
            start, held = i, 0
        held += len(t) + 8
    if start < len(texts):
        yield slice(start, len(texts))


def _count(order: int):
    """Rows (kind, key, n) of labelled URLs, combined per slice.
    kind: 2 * calibration + class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = 2 * batch.column("calibrate").to_numpy(zero_copy_only=False) + batch.column("label").to_numpy()
            urls = [u.encode() for u in batch.column("shown").to_pylist()]
            for part in _slices(urls):
                doc, grams, contexts = _grams(urls[part], order)
                k = kind[part][doc]
                for c in range(4):
                    keys, n = np.unique(np.concatenate([grams[:, k == c].ravel(), contexts[:, k == c].ravel()]), return_counts=True)
                    if len(keys):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys), pa.array(n.astype(np.int64))],
                                                         names=["kind", "key", "n"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their pack."""
    pack = TaskContext.get().partitionId() << 32
    for b in batches:
        sizes = [u.encode() for u in b.column("shown").to_pylist()]
        for part in _slices(sizes):
            some = b.slice(part.start, part.stop - part.start)
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(some.num_rows, pack, np.int64))], names=[*b.schema.names, "pack"])
            pack += 1


def _wanted(order: int):
    """A pack to (pack, key) rows: each n-gram it must know, once."""
    def run(t: pa.Table) -> pa.Table:
        _, grams, contexts = _grams([u.encode() for u in t.column("shown").to_pylist()], order)
        keys = np.unique(np.concatenate([grams.ravel(), contexts.ravel()]))
        return pa.table([pa.array(np.full(len(keys), t.column("pack")[0].as_py(), np.int64)), pa.array(keys)], names=["pack", "key"])
    return run


def _mean_ratio(doc: np.ndarray, n: list, seen: list, texts: list[bytes], strength: float) -> np.ndarray:
    """Mean over characters of log P_accepted - log P_rejected (0 if empty).
    n, seen: per class (rejected first), per order, the counts of each
    position's context and of its (context, character)."""
    logs = []
    for ns, ss in zip(n, seen):
        p = np.full(len(doc), 1 / 256)
        for a, b in zip(ns, ss):
            p = (b + strength * p) / (a + strength)
        logs.append(np.log(p))
    sums = np.bincount(doc, logs[1] - logs[0], len(texts))
    return sums / np.maximum([len(t) for t in texts], 1)


def log_ratio(texts: list[bytes], tables: np.ndarray, order: int = ORDER, strength: float = STRENGTH) -> np.ndarray:
    """``_mean_ratio`` under small tables of hashed cells."""
    doc, grams, contexts = _cells(texts, order, int(tables.shape[1]).bit_length() - 1)
    return _mean_ratio(doc, [t[contexts] for t in tables], [np.minimum(t[grams], t[contexts]) for t in tables], texts, strength)


def _score(order: int, strength: float):
    """A pack and the counts of its n-grams to its rows with scores:
    calibration URLs under the trial counts, others under all."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [u.encode() for u in left.column("shown").to_pylist()]
        keys = right.column("key").to_numpy()
        o = np.argsort(keys)
        keys = np.append(keys[o], np.iinfo(np.int64).max)  # found by what is in no count
        counts = [np.append(right.column(c).to_numpy()[o], 0).astype(np.float64) for c in COUNTS]
        doc, grams, contexts = _grams(texts, order)
        at = [np.searchsorted(keys, k) for k in (contexts, grams)]
        known = [keys[i] == k for i, k in zip(at, (contexts, grams))]
        n, seen = ([np.where(known[j], c[at[j]], 0) for c in counts] for j in range(2))
        trial, every = (_mean_ratio(doc, n[i:i + 2], seen[i:i + 2], texts, strength) for i in (0, 2))
        score = np.where(left.column("label").is_valid().to_numpy(), trial, every)
        return left.drop_columns(["pack"]).append_column("score", pa.array(score))
    return run


def calibrated_threshold(histogram: list[tuple[int, int, int]]) -> float:
    """Threshold (score >= it is accepted) of the best balanced accuracy,
    nearest to 0, from (bin, class, count) rows."""
    h = np.zeros((2, 2 * SPAN + 1))
    for b, c, n in histogram:
        h[c, b + SPAN] += n
    if not h.sum(1).all():
        return 0.0
    h /= h.sum(1, keepdims=True)
    kept = np.concatenate([np.cumsum(h[1][::-1])[::-1], [0]])       # accepted ones at or above a bin
    cut = np.concatenate([[0], np.cumsum(h[0])])                    # rejected ones below it
    good = kept + cut
    best = np.flatnonzero(good >= good.max() - 1e-9)
    return float((best[np.abs(best - SPAN).argmin()] - SPAN) * BIN)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides)
    for every row."""
    src = pages.select(F.col("page_id").cast("long"), "url")
    shown = F.regexp_replace(F.coalesce("url", F.lit("")), r"^.*?://", "")
    rule, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    judged = (src.withColumn("host", host_of()).withColumn("path", path_of())
              .withColumn("rule", rule).withColumn("ruled", verdict).withColumn("shown", shown))
    label = (F.col("ruled") == "allow").cast("int")
    labelled = (judged.filter("rule IS NOT NULL").select("shown", label.alias("label")).distinct()
                .withColumn("calibrate", (F.pmod(F.xxhash64("shown"), F.lit(4)) == 0).cast("int")))
    sums = [F.sum(F.when(F.col("kind").isin(kinds), F.col("n")).otherwise(0)).alias(c)
            for c, kinds in zip(COUNTS, ([0], [1], [0, 2], [1, 3]))]
    counts = stage(labelled.mapInArrow(_count(order), "kind int, key long, n long").groupBy("key").agg(*sums), "url-counts")
    if not all(counts.agg(F.coalesce(F.max("all_0") > 0, F.lit(False)), F.coalesce(F.max("all_1") > 0, F.lit(False))).first()):
        return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"),
                             F.lit(None).cast("double").alias("score"))
    free = judged.filter("rule IS NULL").select("page_id", "host", "path", "shown", F.lit(None).cast("int").alias("label"))
    tried = labelled.filter("calibrate = 1").select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("host"),
                                                    F.lit(None).cast("string").alias("path"), "shown", "label")
    fields = "page_id long, host string, path string, shown string, label int"
    packs = stage(free.unionByName(tried).mapInArrow(_pack, fields + ", pack long"), "url-packs")
    known = packs.select("pack", "shown").groupBy("pack").applyInArrow(tidy(_wanted(order)), "pack long, key long").join(counts, "key")
    scored = stage(packs.groupBy("pack").cogroup(known.groupBy("pack")).applyInArrow(tidy(_score(order, STRENGTH)), fields + ", score double"), "url-scores")
    bins = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-SPAN)), F.lit(SPAN)).cast("int")
    threshold = calibrated_threshold([tuple(r) for r in scored.filter("label IS NOT NULL").groupBy(bins.alias("bin"), "label").count().collect()])
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    ruled = judged.filter("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"),
                                                     F.lit(None).cast("double").alias("score"))
    return ruled.unionByName(scored.filter("label IS NULL").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                                                                   own.alias("verdict"), "score"))
