"""Embedding near-dedup by an exact metric range join (operator 6).

Two vectors link at cosine >= ``threshold``: on unit vectors, at distance
r or less. Pivots cut the space into cells; a vector's home is the cell of
its nearest pivot. A vector within r of another's home cell must lie within
r of the plane between the two pivots, (d(x, q)^2 - d(x, p)^2) / 2 d(p, q)
<= r (the triangle inequality in its hyperplane form), so it is copied to
those cells and to no other; then each cell joins alone.

Equal vectors are collapsed before (one representative with its count), so
exact copies cost one row. Only vectors of one length can link: the pivots are
those of the most frequent length, and every other length is a cell of its
own. A cell is joined in blocks of bounded size, one task a pair of blocks. In
a block, members within r / 2 of a common centre are all linked by the
triangle inequality; they are counted, not compared. Only counts and one
link a vector and block component leave a task, never all pairs.

Products run in single precision; whatever comes within ``DOUBT`` of the
threshold is computed again in double precision on the original vectors.
Null, zero or non-finite vectors and rows without a vec_id link with nothing;
their component is their vec_id. Without pruning (spread-out vectors in many
dimensions: one pivot is chosen) the work is that of all pairs in blocks;
results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import stage
from wattlane.llm.components import components, roots

THRESHOLD = 0.9
PIVOTS = (1, 4, 16, 64)
BLOCK = 8192
SAMPLE = 1024
DOUBT = 1e-5


def matrix(col: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(dtype, copy=False)


def usable(emb: str = "embedding"):
    """Not null, not zero, all components finite."""
    bad = F.exists(emb, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(F.col(emb).isNotNull() & ~bad & F.exists(emb, lambda v: v != 0), F.lit(False))


def common_size(vectors: DataFrame) -> int:
    """The most frequent length among usable vectors (0: none)."""
    r = (vectors.filter(usable()).groupBy(F.size("embedding").alias("d")).count()
         .orderBy(F.desc("count"), "d").first())
    return r["d"] if r else 0


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """rep (smallest vec_id), n and embedding of each distinct vector."""
    # 0.0 and -0.0 are one value: grouping normalises them
    return vectors.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pick_pivots(reps: DataFrame, radius: float, counts=PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Unit pivots: farthest-first among a bounded sample of rows (smallest
    hashes), as many of ``counts`` as promise the fewest comparisons."""
    rows = reps.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").collect()
    if not rows:
        return np.zeros((0, 0))
    x = unit_rows(np.array([r["embedding"] for r in rows], np.float64))
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(max(counts), len(x)):
        i = int(near.argmin())
        if near[i] > 1 - 1e-9:
            break
        chosen.append(i)
        near = np.maximum(near, x @ x[i])
    best, least = x[chosen[:1]], 1.0
    for c in counts:
        p = x[chosen[:c]]
        home, present = cells_of(x, p, radius)
        share = float((np.bincount(home, minlength=len(p)) * present.sum(0)).sum()) / len(x) ** 2
        if share < 0.8 * least:
            best, least = p, share
    return best


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, present): home cell of each unit vector and the boolean
    matrix of cells it must be present in."""
    sim = x @ pivots.T
    home = sim.argmax(1)
    gap = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    lead = sim[np.arange(len(x)), home][:, None] - sim      # (d(x,q)^2 - d(x,p)^2) / 2
    present = lead <= radius * gap[home] + 1e-9
    present[np.arange(len(x)), home] = True
    return home, present


def _assign(pivots: np.ndarray, radius: float):
    """rep rows to (cell, home?) rows, norms taken out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = unit_rows(matrix(b.column("embedding")))
            home, present = cells_of(x, pivots, radius)
            row, cell = np.nonzero(present)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("rep").take(pa.array(row)),
                                              pa.array(cell == home[row])], names=["cell", "rep", "home"])
    return run


def link_block(x: np.ndarray, y: np.ndarray, same: np.ndarray, weight: np.ndarray, threshold: float):
    """Rows x against rows y (unit vectors; same[i] is x's row in y or -1).

    Returns (counts, near, links): weighted number of linked y per x, and
    links (i, j) that join all that is linked: x rows, then y rows offset
    by len(x)."""
    counts = np.zeros(len(x), np.int64)
    a, b = [np.flatnonzero(same >= 0)], [len(x) + same[same >= 0]]
    half = 2 * np.arcsin(min(np.sqrt(2 - 2 * threshold) / 2, 1.0)) / 2       # half the linking angle
    core = np.zeros(len(y), bool)
    xcore = np.zeros(len(x), bool)
    if len(y):
        # a dense centre: the y row nearest to the mean of those linked to the busiest of a few
        probe = y[:: max(len(y) // 16, 1)].astype(np.float32)
        busy = (probe @ y.T.astype(np.float32) >= threshold).sum(1)
        centre = y[(probe @ y.T.astype(np.float32) >= threshold)[busy.argmax()]].mean(0) if busy.max() else y[0]
        norm = np.linalg.norm(centre)
        if norm > 0:
            centre /= norm
            sure = np.cos(half) + 1e-9
            core, xcore = y @ centre >= sure, x @ centre >= sure
    if core.any() and xcore.any():
        counts[xcore] += weight[core].sum()
        hub = int(np.flatnonzero(core)[0])
        rest = np.flatnonzero(core)
        xs = np.flatnonzero(xcore)
        a += [xs, np.full(len(rest), xs[0])]
        b += [np.full(len(xs), len(x) + hub), len(x) + rest]
    else:
        core[:], xcore[:] = False, False
    for rows, cols in ((np.flatnonzero(xcore), np.flatnonzero(~core)), (np.flatnonzero(~xcore), np.arange(len(y)))):
        if not len(rows) or not len(cols):
            continue
        ys = y[cols]
        y32 = ys.astype(np.float32).T.copy()
        for i in range(0, len(rows), 512):
            r = rows[i:i + 512]
            s = x[r].astype(np.float32) @ y32
            u, v = np.nonzero(s >= threshold - DOUBT)
            doubt = s[u, v] < threshold + DOUBT
            if doubt.any():
                exact = np.einsum("ij,ij->i", x[r[u[doubt]]], ys[v[doubt]])
                ok = np.ones(len(u), bool)
                ok[doubt] = exact >= threshold
                u, v = u[ok], v[ok]
            counts[r] += np.bincount(u, weight[cols[v]], len(r)).astype(np.int64)
            if len(u) > 4 * (len(r) + len(cols)):  # dense: a spanning forest is enough
                root = roots(len(r) + len(cols), u, len(r) + v)
                u, v = np.arange(len(root)), root
                names = np.concatenate([r, len(x) + cols])
                a.append(names[u])
                b.append(names[v])
            else:
                a.append(r[u])
                b.append(len(x) + cols[v])
    return counts, np.concatenate(a), np.concatenate(b)


def _join_cell(threshold: float):
    """One task: a block of present vectors against a block of home ones."""
    def run(t: pa.Table) -> pa.Table:
        left = t.column("side").to_numpy() == 0
        lt, rt = t.filter(pa.array(left)), t.filter(pa.array(~left))
        if not lt.num_rows or not rt.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["rep", "links", "root"])
        x, y = (unit_rows(matrix(m.column("embedding"))) for m in (lt, rt))
        xi, yi = lt.column("rep").to_numpy(), rt.column("rep").to_numpy()
        o = np.argsort(yi)
        at = np.minimum(np.searchsorted(yi[o], xi), len(yi) - 1)
        same = np.where(yi[o][at] == xi, o[at], -1)
        counts, a, b = link_block(x, y, same, rt.column("n").to_numpy(), threshold)
        # one row is found as its own partner: leave it out
        own = rt.column("n").to_numpy()[same[same >= 0]]
        counts[same >= 0] -= own
        ids = np.concatenate([xi, yi])
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        root = ids[order][roots(len(ids), place[a], place[b])][place[:len(xi)]]
        busy = (counts > 0) | (root != xi)
        return pa.table([pa.array(xi[busy]), pa.array(counts[busy]), pa.array(root[busy])], names=["rep", "links", "root"])
    return run


def range_join(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    size = common_size(rows)
    takes_part = usable() & F.col("vec_id").isNotNull()
    out = ["vec_id", "n_links", "component_id"]
    rest = rows.filter(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = rows.filter(takes_part)
    reps = stage(distinct_vectors(rows), "vectors")
    radius = float(np.sqrt(2 - 2 * threshold))
    length = F.size("embedding")
    p = pick_pivots(reps.filter(length == size), radius)
    if len(p):
        spread = reps.filter(length == size).select("rep", "embedding").mapInArrow(_assign(p, radius), "cell int, rep long, home boolean")
        others = reps.filter(length != size).select((-length).alias("cell"), "rep", F.lit(True).alias("home"))
        spread = stage(spread.unionByName(others), "cells")
        sizes = spread.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("nx"),
                                           F.ceil(F.count_if("home") / block).cast("int").alias("ny")).filter("ny > 0")
        sized = spread.join(sizes, "cell")
        x = sized.select("cell", "rep", F.lit(0).alias("side"), F.pmod(F.xxhash64("rep"), F.col("nx")).cast("int").alias("bx"),
                         F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("by"))
        y = sized.filter("home").select("cell", "rep", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"),
                                        F.pmod(F.xxhash64("rep"), F.col("ny")).cast("int").alias("by"))
        found = stage(x.unionByName(y).join(reps, "rep").groupBy("cell", "bx", "by")
                      .applyInArrow(_join_cell(threshold), "rep long, links long, root long"), "linked")
        comp = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        per = stage(reps.join(links, "rep", "left").join(comp, "rep", "left")
                    .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
                            F.coalesce("component", "rep").alias("component_id")), "per-vector")
        rest = rows.join(per, "embedding").select(out).unionByName(rest)
    return rest.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
