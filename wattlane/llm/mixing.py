"""Mixing sources to target weights by pivotal dependent rounding (operator 3).

Size of a document: its words. Sources in code-point order (null last)
weigh 1, 2, 3, repeating, and share all words; no target exceeds ``CAP``
times its source's words, and what is cut is reshared by weight until none
is above. Resharing is one aggregate over the source table a round.

Each document of a source should be taken target / source_size times, a
whole part plus a fraction. The fractions are rounded together: two
documents pass mass (probability times size, so that the source's words
stay the same) at random until one of them is 0 or 1; the other meets the
next document. Documents are dealt to bounded blocks by hash; each block
leaves at most one open document, and these meet again in the next level
of a reduction tree, until one a source is left and rounded by itself. So
a source misses its target by less than one document, a source with a
third of all rows is as many blocks as it needs, and expectations are kept.

All draws come from hashes of the document's key, so reruns and recomputed
tasks agree. Rows equal in doc_id, source and size are one item with a
count. Null text or blank: size 0, taken 0, not in the
mix. Null doc_id and source are
values of their own.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattlane.llm.common import WORD, stage
from wattlane.operators.ordering import range_positions

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK = 4096
SEED = 11
EPS = 1e-9


def sources_with_targets(items: DataFrame) -> DataFrame:
    """source, source_size, target, n (rows) from items (source, size, m)."""
    src = stage(items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n")), "sources")
    src = range_positions(src, [], [F.col("source").isNull(), F.col("source")], "_pos")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod("_pos", F.lit(len(WEIGHTS))) + 1).cast("int"))
    src = stage(src.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * CAP), "sources")
    level = 0.0
    while True:  # the level only rises, past one source's cap a round at least
        capped = F.col("cap") < F.col("w") * F.lit(level)
        r = src.agg(F.sum("source_size").alias("t"), F.sum(F.when(capped, F.col("cap"))).alias("c"), F.sum(F.when(~capped, F.col("w"))).alias("w")).first()
        new = max(((r["t"] or 0) - (r["c"] or 0.0)) / r["w"], 0.0) if r["w"] else level
        if new <= level:
            break
        level = new
    return src.select("source", "source_size", "n", F.least("cap", F.col("w") * F.lit(level)).alias("target"))


def _draw(key: str, level: int, seed: int) -> float:
    return (xxhash.xxh3_64_intdigest(f"{key}/{level}", seed) >> 11) / (1 << 53)


def pivotal(keys: list[str], sizes: list[int], probs: list[float], level: int, seed: int = SEED):
    """(ups, open): ups[i] is 1 or 0 where item i is settled, None for the
    open one, whose index and probability ``open`` holds (None if none)."""
    ups: list = [None] * len(keys)
    at, p = None, 0.0
    # long documents first (equal ones in hash order): the last ones to meet
    # are short, and so is, mostly, the one that stays open
    for i in sorted(range(len(keys)), key=lambda i: (-sizes[i], xxhash.xxh3_64_intdigest(keys[i], seed))):
        if probs[i] <= EPS or probs[i] >= 1 - EPS:
            ups[i] = int(probs[i] > 0.5)
            continue
        if at is None:
            at, p = i, probs[i]
            continue
        q, a, b = probs[i], sizes[at], sizes[i]
        up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))  # words to or from the open one
        d = up if _draw(keys[i], level, seed) * (up + down) < down else -down
        p, q = p + d / a, q - d / b
        if p <= EPS or p >= 1 - EPS:
            ups[at] = int(p > 0.5)
            at, p = i, q
            if q <= EPS or q >= 1 - EPS:
                ups[i], at = int(q > 0.5), None
        else:
            ups[i] = int(q > 0.5)
    return ups, None if at is None else (at, p)


def _round_block(level: int, final: bool, seed: int):
    def run(t: pa.Table) -> pa.Table:
        keys, sizes, probs = (t.column(c).to_pylist() for c in ("key", "size", "p"))
        ups, left = pivotal(keys, sizes, probs, level, seed)
        if left is not None:
            i, p = left
            probs[i] = p
            if final:
                ups[i] = int(_draw(keys[i], -1, seed) < p)
        return pa.table([t.column("source"), t.column("block"), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()),
                         pa.array(probs, pa.float64()), pa.array(ups, pa.int32())], names=["source", "block", "key", "size", "p", "up"])
    return run


def decide(docs: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row per distinct (doc_id, source, size): key, doc_id, source,
    size, source_size, target, m (rows), whole (copies of each row) and
    n_up (rows that get one copy more)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    items = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"))
    items = stage(items.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
                  .withColumn("key", item_key()), "items")
    src = stage(sources_with_targets(items), "targets")
    share = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(CAP)))).otherwise(0.0)
    t = src.withColumnRenamed("source", "_s")
    items = (items.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
             .withColumn("whole", F.floor(share)).withColumn("frac", share - F.col("whole"))
             .withColumn("settled", F.floor(F.col("m") * F.col("frac") + EPS))
             .withColumn("p", F.greatest(F.col("m") * F.col("frac") - F.col("settled"), F.lit(0.0))))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(float(block))), F.lit(1)).cast("long")
    cur = (items.filter((F.col("p") > EPS) & (F.col("size") > 0))
           .select("source", F.pmod(F.xxhash64("key", F.lit(seed)), blocks).alias("block"), "key", "size", "p"))
    most = src.agg(F.max("n")).first()[0] or 0
    width, level, settled = max(-(-most // block), 1), 0, []
    while True:
        out = stage(cur.groupBy("source", "block").applyInArrow(
            _round_block(level, width == 1, seed), "source string, block long, key string, size long, p double, up int"), "rounded")
        settled.append(out.filter("up IS NOT NULL").select("key", "up"))
        if width == 1:
            break
        cur = (out.filter("up IS NULL").drop("up").withColumn("block", F.floor(F.col("block") / block).cast("long")))
        width, level = -(-width // block), level + 1
    ups = settled[0]
    for s in settled[1:]:
        ups = ups.unionByName(s)
    return (items.join(ups, "key", "left")
            .select("key", "doc_id", "source", "size", "source_size", "target", "m", F.col("whole").cast("long"),
                    (F.col("settled") + F.coalesce("up", F.lit(0))).cast("long").alias("n_up")))


def item_key():
    """A text key of (doc_id, source, size) in which nulls are values."""
    return F.md5(F.to_json(F.struct("doc_id", "source", "size")))


def mixing_plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats
    counted) for every row."""
    d = decide(docs, seed)
    step = 1000  # rows of one item come in runs, never as one long array
    runs = d.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / step))))
    rows = runs.withColumn("_i", F.explode(F.sequence(F.col("_run") * step, F.least(F.col("_run") * step + step, F.col("m")) - 1)))
    copies = F.col("whole") + (F.col("_i") < F.col("n_up")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it
    is taken. Of rows with one key, the first by text get the extra copy."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.withColumn("_key", F.md5(F.to_json(F.struct(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size")))))
    d = decide(docs, seed).select(F.col("key").alias("_key"), "whole", "n_up").filter("whole > 0 OR n_up > 0")
    d = d.select("_key", F.col("whole").alias("_whole"), F.col("n_up").alias("_up"))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("text")))
    copies = (F.col("_whole") + (nth <= F.col("_up")).cast("long")).cast("int")
    taken = keyed.join(d, "_key").withColumn("_copies", copies).filter("_copies > 0")
    return taken.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)
