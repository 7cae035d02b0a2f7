"""Best-fit packing with swap-based local search (operator 9).

1. Every text is tokenised in one pass (shared unit encoder), closed with
   the end id and cut: only documents longer than ``size`` are cut, the
   first piece takes the remainder. The piece table (no texts, no ids, only
   lengths and a checksum) is written once.
2. Full pieces are sequences by themselves. The others are dealt to cells
   of about ``cell_rows`` pieces by a hash of their row id, so no key makes
   a cell hot. Each cell is packed best-fit decreasing; then local search
   exchanges one-for-one, two-for-one or moves pieces from the emptiest
   bin into fuller ones (each step raises the sum of squared fills) until
   the bin empties or no step is left, or the count meets the lower bound.
3. Bins that stay underfull in their cells are dissolved and their pieces
   dealt to fewer cells, round after round, until one cell is left: the
   rest left open by the partitioning is packed like everything else.

Null text: a document holding only the end id. An empty table gives an
empty result. Repeated rows are packed once each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import portions, stage
from wattlane.llm.tokens import encoder, load_tokenizer, prove_whole

SIZE = 1024
CELL_ROWS = 8192
UNDERFULL = 0.97


def id_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def piece_table(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece."""
    end = id_bytes([end_id])
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole(load_tokenizer(tokenizer_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, id_bytes, whole.value)
        for b in portions(batches):
            cols: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                units = enc.units(text or "")
                data = memoryview((enc.whole_text(text) if units is None else b"".join(units)) + end)
                n = len(data) // 4
                first = n if n <= size else (n % size or size)
                at, piece = 0, 0
                while at < n:
                    length = first if piece == 0 else size
                    for c, v in zip(cols, (doc, piece, at, length, zlib.crc32(data[4 * at:4 * (at + length)]))):
                        c.append(v)
                    at, piece = at + length, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col("doc_id").cast("long"), "text")
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of one cell: ``items[b]`` lists (length, row)."""

    def __init__(self, size: int):
        self.size = size
        self.items: list[list[tuple[int, int]]] = []
        self.fill: list[int] = []

    def best_fit(self, pieces: list[tuple[int, int]]) -> None:
        """Longest first, each into the fullest bin that still takes it."""
        open_bins: list[list[int]] = [[] for _ in range(self.size + 1)]  # by free room
        rooms = 0  # bit r is set while some bin has r tokens free
        for piece in sorted(pieces, key=lambda p: (-p[0], p[1])):
            n = piece[0]
            fits = rooms >> n
            if fits:
                room = n + ((fits & -fits).bit_length() - 1)
                b = open_bins[room].pop()
                if not open_bins[room]:
                    rooms &= ~(1 << room)
                self.items[b].append(piece)
                self.fill[b] += n
            else:
                b, room = len(self.items), self.size
                self.items.append([piece])
                self.fill.append(n)
            left = room - n
            if left:
                open_bins[left].append(b)
                rooms |= 1 << left

    def local_search(self) -> None:
        """Empty the emptiest bin by steps that each raise the sum of
        squared fills: one or two of its pieces go to a bin at least as
        full, for one piece of that bin or (one alone) for nothing. A bin
        without a step left is closed as a source, and the next emptiest
        follows, until the lower bound is met or all below ``UNDERFULL``
        were sources."""
        size = self.size
        fill = np.array(self.fill, np.int64)
        home = np.repeat(np.arange(len(fill)), [len(x) for x in self.items])
        lens = np.array([x[0] for it in self.items for x in it], np.int64)
        rows = [x for it in self.items for x in it]
        bound, used = -(-int(fill.sum()) // size), len(fill)
        backs = np.arange(size + 1)
        source = fill < UNDERFULL * size
        while used > bound and source.any():
            live = np.flatnonzero(source)
            src = live[fill[live].argmin()]
            room = np.where(fill >= fill[src], size - fill, 0)
            room[src] = 0
            widest = np.zeros(size + 1, np.int64)     # by length of the piece that comes back, 0: none
            np.maximum.at(widest, lens, room[home])
            widest[0] = room.max()
            own = np.flatnonzero(home == src)
            i, j = np.triu_indices(len(own))          # i == j: one piece alone
            sums = np.where(i == j, lens[own[i]], lens[own[i]] + lens[own[j]])
            sums, pick = np.unique(sums, return_index=True)
            d = sums[:, None] - backs[None, :]
            d[(d < 0) | (d > widest[None, :])] = 0
            d[i[pick] != j[pick], 0] = 0              # two pieces only go against one
            g, back = divmod(int(d.argmax()), size + 1)
            d = int(d[g, back])
            if not d:
                source[src] = False
                continue
            group = list({int(own[i[pick[g]]]), int(own[j[pick[g]]])})
            if back:
                k = int(np.flatnonzero((lens == back) & (room[home] >= d))[0])
                target = home[k]
                home[k] = src
            else:
                target = int(np.flatnonzero(room >= d)[0])
            home[group] = target
            fill[src] -= d
            fill[target] += d
            source[target] &= fill[target] < UNDERFULL * size
            if not fill[src]:
                used -= 1
                source[src] = False
        self.fill = fill.tolist()
        self.items = [[] for _ in self.fill]
        for b, x in zip(home.tolist(), rows):
            self.items[b].append(x)


def pack(lengths, rows, size: int = SIZE) -> Bins:
    """Best-fit decreasing, then local search, over one cell."""
    bins = Bins(size)
    bins.best_fit(list(zip(lengths, rows)))
    bins.local_search()
    return bins


def _pack_cell(size: int):
    def run(group: pa.Table) -> pa.Table:
        bins = pack(group.column("length").to_pylist(), group.column("row").to_pylist(), size)
        cols: list[list] = [[], [], [], [], []]
        for items, fill in zip(bins.items, bins.fill):
            items.sort(reverse=True)
            name, at = min((r for _, r in items), default=0), 0
            for n, r in items:
                for c, v in zip(cols, (r, n, 2 * name, at, fill)):
                    c.append(v)
                at += n
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["row", "length", "sequence_id", "offset", "fill"])
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = SIZE,
                   cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stage(piece_table(docs, tokenizer_path, end_id, size)
                   .withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = (pieces.filter(F.col("length") == size)
             .withColumns({"sequence_id": F.col("row") * 2 + 1, "offset": F.lit(0).cast("long")}))
    todo = pieces.filter(F.col("length") < size).select("row", "length")
    placed = []
    while True:
        n = todo.count()
        if not n:
            break
        cells = -(-n // cell_rows)
        done = stage(todo.withColumn("cell", F.pmod(F.xxhash64("row", F.lit(len(placed))), F.lit(cells)).cast("int"))
                     .groupBy("cell").applyInArrow(_pack_cell(size), "row long, length long, sequence_id long, offset long, fill long"),
                     "packed")
        if cells == 1:
            placed.append(done)
            break
        shut = F.col("fill") >= F.lit(int(size * UNDERFULL))
        todo_next = done.filter(~shut).select("row", "length")
        if todo_next.count() > n // 2:  # little closes by itself: another deal would not help
            placed.append(done)
            break
        placed.append(done.filter(shut))
        todo = todo_next
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = whole.select(cols)
    if placed:
        at = placed[0]
        for p in placed[1:]:
            at = at.unionByName(p)
        out = out.unionByName(pieces.join(at.select("row", "sequence_id", "offset"), "row").select(cols))
    return out
