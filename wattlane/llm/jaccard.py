"""N-gram Jaccard join by grouped prefixes (operator 5).

A document's set is its distinct 5-word shingles (lower-cased A-Z). Two
documents link when 100 * |A and B| >= 75 * |A or B|. Two linked sets
always share a shingle among the first n - ceil(0.75 n) + 1 of each, in any
one order of all shingles.

1. Order. One pass counts shingles in a fixed-size sketch (sized by the
   corpus, at most 2**26 counters). Shingles whose counter stands out come
   last, by how much; all others are ordered by hash. So a passage that
   thousands of documents share stays out of the prefixes, and the order
   needs no exact counts to be right.
2. Groups. Documents with equal size and equal prefix are one group;
   documents with equal sets are one node of it.
3. Index and filter. Prefix shingles meet in hash buckets as delta-coded
   blobs; a task sends one entry per group, with size and position. Two
   groups of a list fit when size and position leave room for the overlap
   that a link needs (where the list is their first common shingle, they
   must). Groups that fit, directly or through others, come under one
   leader, the smallest document among them. So every pair that can link is
   together under some leader, and no list emits its pairs: what goes on is
   (leader, group), without repeats.
4. Expand and verify. A leader's groups are expanded to their nodes, in
   parts of at most ``PART`` nodes (a leader with more is cut by hash, each
   part with the leader in it). A task verifies a part on whole sets, as
   48-bit shingle hashes, and emits a spanning forest of its links.
5. Components of these links. Where a leader has several parts, nodes that
   are not yet in the leader's component meet the nodes of all other parts,
   block by block. No link between different components can be missed.

Without words or text: an empty set, linked with nothing. Null doc_ids are
never nodes; their rows come back with a null component. Repeated rows
share a component. Where rows share a doc_id but not the text, the smallest
of their sets is compared for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import WordHashes, partitions_for, portions, rolling, stage, text_bytes, tidy
from wattlane.llm.components import components, roots

WORDS = 5
NUM, DEN = 75, 100
CHUNKS = 64
KEEP = np.uint64((1 << 48) - 1)
LOW = np.uint64(0xFFFFFFFF)
INDEX_ROWS = 1 << 21
PART = 1024
EXACT = 1024
NONE = np.iinfo(np.int64).min
ITEMS = 1024
TASK_BYTES = 8 << 20


def shingle_set(text: str | None, known: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(rolling(known.of(words), k))


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-n * num // den) + 1


def sketch_bits(total_bytes: int) -> int:
    """About 32 shingles a counter, between 2**14 and 2**26 counters."""
    return int(min(26, max(14, np.ceil(np.log2(max(total_bytes / 6 / 32, 1))))))


def _sketch(bits: int):
    """Counts of shingles by the top bits of their hash, a row per chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, held, size = WordHashes(), np.zeros(1 << bits, np.uint32), [], 0
        for b in portions(batches):
            for text in b.column("text").to_pylist():
                held.append((shingle_set(text, known) >> np.uint64(64 - bits)).astype(np.int64))
                size += len(held[-1])
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
        parts = [zstandard.compress(p.astype("<u4").tobytes(), 1) for p in np.split(counts, CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "counts"])
    return run


def _add_counts(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zstandard.decompress(c), "<u4").astype(np.int64) for c in t.column("counts").to_pylist())
    return pa.table([t.column("chunk")[:1], pa.array([zstandard.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names=["chunk", "counts"])


def rank_classes(docs: DataFrame, bits: int) -> np.ndarray:
    """Per counter: 0 for the usual, else 1 + log2 of how far it stands
    out. At most 2**26 bytes, whatever the corpus."""
    rows = (docs.select("text").mapInArrow(_sketch(bits), "chunk int, counts binary")
            .groupBy("chunk").applyInArrow(_add_counts, "chunk int, counts binary").collect())
    counts = np.zeros((CHUNKS, (1 << bits) // CHUNKS), np.int64)
    for r in rows:
        counts[r["chunk"]] = np.frombuffer(zstandard.decompress(bytes(r["counts"])), "<i8")
    counts = counts.ravel()
    usual = max(2 * counts.mean(), 8)
    return np.floor(np.log2(np.maximum(counts / usual, 0.5)) + 1).astype(np.uint8)


def _index(bits: int, classes, buckets: int):
    """A row per document (n, digest, prefix digest) and, in between, blobs
    of the prefix shingles of the task's groups by hash bucket."""
    names = ["doc_id", "n", "digest", "pdigest", "bucket", "low", "high", "gids", "ns", "at"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 5]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=names)

    def blobs(groups: dict) -> pa.RecordBatch:
        lengths = [len(p) for p, _ in groups.values()]
        tok = np.concatenate([p for p, _ in groups.values()])
        gid = np.repeat(np.array([g for _, g in groups.values()], np.int64), lengths)
        n = np.repeat(np.array([k[0] for k in groups], np.uint32), lengths)
        at = np.concatenate([np.arange(k, dtype=np.uint32) for k in lengths])
        b = ((tok >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        key = (b << np.uint64(32)) | (tok & LOW)
        o = np.argsort(key)
        key, gid, n, at = key[o], gid[o], n[o], at[o]
        cuts = np.searchsorted(key >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        rows = []
        for i in np.flatnonzero(np.diff(cuts)):
            d = np.diff((key[cuts[i]:cuts[i + 1]] & LOW).astype(np.int64), prepend=0)
            rows.append((None, None, None, None, int(i), (d & 0xFFFF).astype("<u2").tobytes(),
                         zstandard.compress((d >> 16).astype("<u2").tobytes(), 1),
                         *(zstandard.compress(x[cuts[i]:cuts[i + 1]].tobytes(), 1) for x in (gid, n, at))))
        return batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = WordHashes(), classes.value
        groups, size = {}, 0
        for b in portions(batches):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                s = shingle_set(text, known)
                n = len(s)
                if not n:
                    rows.append((doc, 0, *[None] * 8))
                    continue
                p = prefix_length(n)
                c = rank[(s >> np.uint64(64 - bits)).astype(np.int64)]
                pre = s[:p]                                  # s is in hash order
                if c.any():
                    pre = s[np.argsort(c, kind="stable")[:p]]
                digest = xxhash.xxh3_128_digest(pre.tobytes())
                rows.append((doc, n, xxhash.xxh3_128_digest(s.tobytes()), digest, *[None] * 6))
                if doc is not None and (n, digest) not in groups:
                    groups[n, digest] = (pre, doc)
                    size += p
                    if size >= INDEX_ROWS:
                        yield blobs(groups)
                        groups, size = {}, 0
            yield batch(rows)
        if groups:
            yield blobs(groups)
    return run


def fits(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sets of sizes n and m whose first common shingle is at i and j can
    link: what is left of each holds the overlap that a link needs."""
    need = NUM * (n + m)
    return (need <= (NUM + DEN) * (n - i)) & (need <= (NUM + DEN) * (m - j))


def fitting(gid: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Leader of each entry of one list (sorted by gid), ``NONE`` where no
    other entry fits. Lists above ``EXACT`` entries are only cut where sizes leave
    a gap no pair can bridge (a superset of what fits)."""
    if len(gid) <= EXACT:
        ok = fits(n[:, None], at[:, None], n[None, :], at[None, :]) & (gid[:, None] != gid[None, :])
        root = roots(len(gid), *np.nonzero(ok))
        return np.where(ok.any(1), gid[root], NONE)
    o = np.argsort(n, kind="stable")
    gap = np.concatenate([[False], n[o][1:] * NUM > n[o][:-1] * DEN])
    part = np.cumsum(gap)
    low = np.full(part[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, part, gid[o])
    out = np.empty(len(gid), np.int64)
    out[o] = np.where(np.bincount(part)[part] > 1, low[part], NONE)
    return out


@tidy
def _leaders(t: pa.Table) -> pa.Table:
    """Of one hash bucket: (gid, leader) for the shingles that two or more
    fitting entries share, without repeats."""
    low, high = (t.column(c).to_pylist() for c in ("low", "high"))
    tok = np.concatenate([np.cumsum(np.frombuffer(a, "<u2").astype(np.uint64) + (np.frombuffer(zstandard.decompress(h), "<u2").astype(np.uint64) << np.uint64(16)))
                          for a, h in zip(low, high)])
    gid, n, at = (np.concatenate([np.frombuffer(zstandard.decompress(x), d).astype(np.int64) for x in t.column(c).to_pylist()])
                  for c, d in (("gids", np.int64), ("ns", np.uint32), ("at", np.uint32)))
    o = np.lexsort((gid, tok))
    tok, gid, n, at = tok[o], gid[o], n[o], at[o]
    first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    length = np.diff(np.append(first, len(tok)))
    leader = np.full(len(tok), NONE, np.int64)
    two = first[length == 2]
    ok = fits(n[two], at[two], n[two + 1], at[two + 1]) & (gid[two] != gid[two + 1])
    leader[two[ok]] = leader[two[ok] + 1] = gid[two[ok]]
    for a, k in zip(first[length > 2], length[length > 2]):
        leader[a:a + k] = fitting(gid[a:a + k], n[a:a + k], at[a:a + k])
    met = leader != NONE
    pairs = np.unique(np.stack([gid[met], leader[met]]), axis=1)
    return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], names=["gid", "leader"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's set as 48-bit hashes, once for each of its places."""
    known = WordHashes()
    for b in portions(batches):
        sets = [np.sort(shingle_set(x, known) & KEEP) for x in b.column("text").to_pylist()]
        data = pa.array([s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in sets], pa.binary())
        places = pa.concat_arrays([b.column("places")])
        row = pa.array(np.repeat(np.arange(b.num_rows), np.diff(places.offsets.to_numpy())))
        flat = places.flatten()
        for at in range(0, len(row), 4096):
            r, f = row.slice(at, 4096), flat.slice(at, 4096)
            yield pa.RecordBatch.from_arrays([*(f.field(i) for i in range(f.type.num_fields)), b.column("node").take(r), data.take(r)],
                                             names=[*(f.type.field(i).name for i in range(f.type.num_fields)), "node", "items"])


def _items(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Intersection sizes of the sets before ``split`` with all sets, by
    products of the incidence of shared items."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    o = np.argsort(flat, kind="stable")
    flat, row = flat[o], row[o]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    item = np.cumsum(first) - 1
    shared = np.bincount(item) > 1
    column = np.cumsum(shared) - 1
    take = shared[item]
    row, column = row[take], column[item[take]]
    out = np.zeros((split, len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), ITEMS):
        a, b = np.searchsorted(column, [lo, lo + ITEMS])   # columns rise
        x = np.zeros((len(sets), min(ITEMS, int(shared.sum()) - lo)), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        out += x[:split] @ x.T
    return out


def _links(nodes: np.ndarray, items: list[bytes], x: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (u, v) among nodes; the first ``x`` meet all others."""
    sets = [_items(i) for i in items]
    n = np.array([len(s) for s in sets])
    same = overlaps(sets, x)
    us, vs = [], []
    for a in range(0, x, 128):
        i, j = np.nonzero(DEN * same[a:a + 128] >= NUM * (n[a:min(a + 128, x), None] + n[None, :] - same[a:a + 128]))
        if len(i) > 4 * len(nodes):  # dense: a spanning forest of these rows is enough
            r = roots(len(nodes), i + a, j)
            i, j = np.arange(len(nodes)), r
            a = 0
        us.append(i + a)
        vs.append(j)
    root = roots(len(nodes), np.concatenate(us), np.concatenate(vs))
    away = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[away], nodes[root[away]]


def _verify(keys: list[str]):
    """Rows sorted by ``keys`` and side: links inside each group, of side 0
    with everything. Groups are bounded; only one is held at a time."""
    def links(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(rows)
        both = np.stack([t.column("side").to_numpy(), t.column("node").to_numpy()])
        nodes, first = np.unique(both, axis=1, return_index=True)
        if nodes.shape[1] < both.shape[1]:  # rows that share a doc_id: the smallest set stands for it
            sets = t.column("items").to_pylist()
            t = t.take(pa.array(sorted(range(len(sets)), key=lambda i: (both[0, i], both[1, i], len(sets[i]), sets[i]))))
            nodes, first = np.unique(np.stack([t.column("side").to_numpy(), t.column("node").to_numpy()]), axis=1, return_index=True)
        items = t.column("items").take(pa.array(first)).to_pylist()
        x = int((nodes[0] == 0).sum())
        return _links(nodes[1], items, x) if x and len(items) > 1 else (np.zeros(0, np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held = None, []
        for b in portions(batches, 4096):
            key = np.stack([b.column(k).to_numpy() for k in keys], 1)
            cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            found = []
            for a, z in zip([0, *cuts], [*cuts, b.num_rows]):
                if a == z:
                    continue
                if open_key is not None and tuple(key[a]) != open_key:
                    found.append(links(held))
                    held = []
                open_key = tuple(key[a])
                held.append(b.slice(a, z - a))
            if found:
                yield _pairs(found)
        if held:
            yield _pairs([links(held)])

    def _pairs(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]).astype(np.int64)) for k in (0, 1)], names=["u", "v"])
    return run


def _verified(src: DataFrame, places: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Links (u, v) among the nodes that meet: places has node, side and the
    (int or long) ``keys``. Texts move once, to their places' node; sets
    move once per place."""
    cols = [*keys, "side"]
    at = places.groupBy("node").agg(F.collect_list(F.struct(*cols)).alias("places"))
    kinds = {f.name: f.dataType.simpleString() for f in places.schema.fields}
    spread = (src.join(at, src["doc_id"] == at["node"]).select("node", "text", "places")
              .mapInArrow(_spread, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", node long, items binary"))
    return stage(spread.repartition(n, *keys).sortWithinPartitions(*cols).mapInArrow(_verify(keys), "u long, v long"), "links")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long"), "text")
    size = text_bytes(src)
    bits = sketch_bits(size)
    classes = spark.sparkContext.broadcast(rank_classes(src, bits))
    buckets = partitions_for(spark, size // 24, INDEX_ROWS // 2)
    every = stage(src.mapInArrow(_index(bits, classes, buckets), "doc_id long, n long, digest binary, pdigest binary, "
                                 "bucket int, low binary, high binary, gids binary, ns binary, at binary"), "index")
    rows = every.filter("bucket IS NULL").select("doc_id", "n", "digest", "pdigest")
    real = rows.filter("n > 0 AND doc_id IS NOT NULL")
    # equal sets are one node (its smallest doc_id), equal sizes and prefixes one group
    nodes = stage(real.groupBy("n", "digest").agg(F.min("doc_id").alias("node"), F.any_value("pdigest").alias("pdigest")), "nodes")
    star = (every.filter("bucket IS NOT NULL").select("bucket", "low", "high", "gids", "ns", "at").repartition(buckets, "bucket")
            .groupBy("bucket").applyInArrow(_leaders, "gid long, leader long").distinct())
    group_of = real.select(F.col("doc_id").alias("gid"), "n", "pdigest").dropDuplicates(["gid"])
    grouped = star.join(group_of, "gid").select("n", "pdigest", "leader").distinct()
    many = nodes.groupBy("n", "pdigest").agg(F.min("node").alias("leader"), F.count("*").alias("m")).filter("m > 1").drop("m")
    under = stage(grouped.unionByName(many).join(nodes, ["n", "pdigest"]).select("leader", "node").distinct(), "leaders")
    counts = under.groupBy("leader").agg(F.count("*").alias("m"), F.min("node").alias("head")).filter("m > 1")
    parts = F.ceil(F.col("m") / PART).cast("int")
    led = stage(under.join(counts, "leader").withColumn("parts", parts)
                .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "parts")
    heads = (led.filter((F.col("node") == F.col("head")) & (F.col("parts") > 1))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    places = led.unionByName(heads.select(led.columns)).select("leader", "part", "node", F.lit(0).alias("side")).distinct()
    n = partitions_for(spark, size, TASK_BYTES)
    links = _verified(src, places, ["leader", "part"], n)

    cut = led.filter("parts > 1")
    if not cut.isEmpty():
        comp = stage(components(links), "components")
        cut = cut.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        of = cut.filter("node = head").select("leader", F.col("component").alias("main"))
        cut = stage(cut.join(of, "leader"), "open")
        x = (cut.filter("component <> main").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("other <> part")
             .select("leader", "part", "other", "node", F.lit(0).alias("side")))
        met = x.select("leader", "part", "other").distinct()
        y = (cut.select("leader", F.col("part").alias("other"), "node").join(met, ["leader", "other"])
             .select("leader", "part", "other", "node", F.lit(1).alias("side")))
        links = links.unionByName(_verified(src, x.unionByName(y), ["leader", "part", "other"], n))
    comp = components(links)
    per_node = (nodes.select("n", "digest", "node").join(comp, "node", "left")
                .select("n", "digest", F.coalesce("component", "node").alias("component_id")))
    return (rows.join(per_node, ["n", "digest"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))
