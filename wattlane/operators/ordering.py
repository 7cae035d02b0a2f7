"""Row positions and exact quantiles without a single-key shuffle.

``row_number() over (partition by k order by o)`` sends every row of a key
to one task. When one key holds a third of the table that task is the
job. Here the rows are range-partitioned on (keys, order) instead, so a
hot key is spread over many contiguous partitions; each partition numbers
its own rows, and a small table of per-(partition, key) counts turns
local numbers into positions within the key. Only the count table (about
one row per partition plus one per key) is ordered by key.

The numbered frame is written once as a table in the shared scratch
folder (``spark.checkpoint.dir``) before it is read twice (by the count
table and by the rows). Without that, column pruning can give the two
readers different range exchanges whose sampled bounds differ, so the
partition ids would not agree; nested operators would also multiply the
plan. The written table fixes the numbers, cuts the lineage, and needs no
recomputation after an executor loss.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlane.operators.selection import selected_quantiles
from wattlane.session import materialize, ship_package

# Groups up to this many rows share the one-shuffle built-in plan
# (``row_number`` / ``percentile`` / a plain window): one task holds one
# group, which is bounded. Larger ("hot") groups are split over tasks by the
# range-partitioned path. ``limit=`` overrides it per call. Without keys the
# one group is the whole table: always the range-partitioned path.
GROUP_LIMIT = 2_000_000


def split_hot(df: DataFrame, keys: Sequence[str], limit: int | None = None,
              max_group: int | None = None):
    """(cold rows, hot rows): rows of groups above ``limit`` are hot. Either
    side is None when empty. The group counts are one partial aggregate;
    the hot-key table (at most rows / limit keys) is written once and
    joined semi / anti (AQE broadcasts it when it is small). A caller that
    already knows the largest group size passes ``max_group`` and saves the
    counting job when everything is bounded."""
    keys = list(keys)
    limit = GROUP_LIMIT if limit is None else limit
    if not keys:
        return None, df
    if max_group is not None and max_group <= limit:
        return df, None
    hot = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") > limit).select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    if hot.isEmpty():
        return df, None
    hot = materialize(hot, "hot-keys")
    on = None  # null keys are a group like any other
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_h_{k}"))
        on = same if on is None else on & same
    cold = df.join(hot, on, "left_anti")
    return (None if cold.isEmpty() else cold), df.join(hot, on, "left_semi")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _num_partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   pos_col: str = "pos", partitions: int | None = None,
                   limit: int | None = None, max_group: int | None = None) -> DataFrame:
    """Add ``pos_col`` = 0-based position of the row within ``keys`` (the
    whole table when ``keys`` is empty) in ``order``.

    ``order`` should make the order total (end it with a unique column);
    otherwise ties get some order that is fixed within one run. Bounded
    groups use ``row_number``; hot groups the range-partitioned numbering.
    """
    keys = list(keys)
    ocols = [F.col(o) if isinstance(o, str) else o for o in order]
    cold, hot = split_hot(df, keys, limit, max_group)
    parts = []
    if cold is not None:
        w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*ocols)
        parts.append(cold.withColumn(pos_col, (F.row_number().over(w) - 1).cast("long")))
    if hot is not None:
        parts.append(range_positions(hot, keys, order, pos_col, partitions))
    return _union(parts)


def _keyless_offsets(runs: DataFrame, sums: Sequence[str], names: dict, keep: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums over partition ids for a table with one row per
    partition. It has at most ``spark.sql.shuffle.partitions`` rows (a
    configured bound), so it is summed on the driver and comes back as a
    small broadcast table -- no single-partition window over anything."""
    spark = runs.sparkSession
    rows = sorted(runs.select("_pid", *sums, *keep).collect(), key=lambda r: r["_pid"])
    acc = {c: 0 for c in sums}
    out = []
    for r in rows:
        out.append((r["_pid"], *[acc[c] for c in sums], *[r[k] for k in keep]))
        for c in sums:
            acc[c] += r[c] or 0
    fields = ["_pid int"] + [f"{names[c]} {runs.schema[c].dataType.simpleString()}" for c in sums] + \
             [f"{k} {runs.schema[k].dataType.simpleString()}" for k in keep]
    return spark.createDataFrame(out, ", ".join(fields))


def range_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                    pos_col: str = "pos", partitions: int | None = None) -> DataFrame:
    """Skew-safe numbering (see module doc); any group size."""
    keys = list(keys)
    n = _num_partitions(df, partitions)
    sort_cols = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    s = (df.repartitionByRange(n, *sort_cols)
         .sortWithinPartitions(*sort_cols)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_lid", F.monotonically_increasing_id()))
    s = materialize(s, "positions")
    runs = s.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_cnt"),
                                        F.min("_lid").alias("_first"))
    if keys:
        w = Window.partitionBy(*keys).orderBy("_pid")
        runs = runs.withColumn(
            "_off", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    else:
        runs = F.broadcast(_keyless_offsets(runs, ["_cnt"], {"_cnt": "_off"}, ["_first"]))
    runs = runs.select(F.col("_pid").alias("_rpid"), *[F.col(k).alias(f"_r_{k}") for k in keys],
                       "_off", "_first")
    cond = s["_pid"] == runs["_rpid"]
    for k in keys:
        cond = cond & s[k].eqNullSafe(runs[f"_r_{k}"])
    out = s.join(runs, cond, "inner")
    return (out.withColumn(pos_col, F.col("_off") + F.col("_lid") - F.col("_first"))
            .drop("_pid", "_lid", "_rpid", "_off", "_first", *[f"_r_{k}" for k in keys]))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
              names: Sequence[str] | None = None, method: str = "exact",
              accuracy: int = 10000, limit: int | None = None,
              max_group: int | None = None) -> DataFrame:
    """Per-key quantiles with linear interpolation (pandas ``quantile``).

    ``method='exact'``: bounded groups use the ``percentile`` aggregate; of
    hot groups the two ranks around p*(n-1) are found by selection (no value
    buffer per key, no exchange of rows). ``'approx'`` uses
    ``percentile_approx`` (mergeable sketch, one pass). Nulls are ignored;
    keys whose values are all null get no row.
    """
    keys = list(keys)
    names = list(names) if names else [f"q{int(round(p * 100)):02d}" for p in probs]
    d = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    if method == "approx":
        return d.groupBy(*keys).agg(*[
            F.percentile_approx("_v", float(p), accuracy).alias(nm) for p, nm in zip(probs, names)])
    if method == "aggregate":
        return d.groupBy(*keys).agg(*[
            F.percentile("_v", F.lit(float(p))).alias(nm) for p, nm in zip(probs, names)])
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")

    # ``percentile`` combines map-side, so without keys only its final merge
    # is serial: up to the group limit it serves the whole table too.
    if keys:
        cold, hot = split_hot(d, keys, limit, max_group)
    else:
        small = d.count() <= (GROUP_LIMIT if limit is None else limit)
        cold, hot = (d, None) if small else (None, d)
    parts = []
    if cold is not None:
        parts.append(cold.groupBy(*keys).agg(*[
            F.percentile("_v", F.lit(float(p))).alias(nm) for p, nm in zip(probs, names)]))
    if hot is not None:
        parts.append(selected_quantiles(hot, keys, probs, names))
    return _union(parts)


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     extra: Sequence[Column] = (), limit: int | None = None) -> dict:
    """Whole-table quantiles of several columns (``{col}__q{pp}``) plus any
    ``extra`` one-row aggregates, as literals. When the table is within the
    group limit everything is ONE aggregate pass (``percentile`` with an
    array of probabilities per column); above it the columns go through
    selection together, which never holds a column in one task."""
    limit = GROUP_LIMIT if limit is None else limit
    names = {p: f"q{int(round(p * 100)):02d}" for p in probs}
    n = df.count()
    if n <= limit:
        aggs = [F.percentile(F.col(c), F.array(*[F.lit(float(p)) for p in probs])).alias(f"_{c}") for c in cols]
        row = df.select(*aggs, *extra).first()
        out = {}
        for c in cols:
            vals = row[f"_{c}"] or [None] * len(probs)
            for p, v in zip(probs, vals):
                out[f"{c}__{names[p]}"] = F.lit(v).cast("double")
        for e in df.select(*extra).schema.fields if extra else []:
            out[e.name] = F.lit(row[e.name]).cast(e.dataType)
        return out
    out = row_literals(df.select(*extra)) if extra else {}
    # (column, value) rows, selected per column
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_x")) for c in cols])).alias("_e")).select("_e.*")
    found = {r["_c"]: r for r in quantiles(long, "_x", probs, ["_c"], [names[p] for p in probs], limit=0).collect()}
    for c in cols:
        for p in probs:
            out[f"{c}__{names[p]}"] = F.lit(found[c][names[p]] if c in found else None).cast("double")
    return out


def median(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "median",
           method: str = "exact", max_group: int | None = None) -> DataFrame:
    return quantiles(df, value, [0.5], keys, [name], method, max_group=max_group)


def one_row(df: DataFrame) -> dict:
    """Fields of a one-row statistics DataFrame as literals (see
    ``row_literals``); read as ``one_row(df)["name"]``."""
    return row_literals(df)


def row_literals(df: DataFrame) -> dict:
    """Compute a one-row statistics DataFrame now and return its fields as
    typed literals. The result is a handful of numbers (bounded), and the
    plans that use them stay small instead of embedding the statistics'
    whole lineage once per reference."""
    row = df.first()
    out = {}
    for f in df.schema.fields:
        v = None if row is None else row[f.name]
        out[f.name] = F.lit(v).cast(f.dataType)
    return out


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   cols: Sequence[str], suffix: str = "_cum",
                   partitions: int | None = None, limit: int | None = None) -> DataFrame:
    """Inclusive running sums of ``cols`` within ``keys`` in ``order``.

    Bounded groups: a plain window. Hot groups: same layout as
    ``range_positions`` -- range partitioning spreads a hot key, each
    (partition, key) run sums locally, and a small table of run totals
    supplies the offsets.
    """
    keys = list(keys)
    ocols = [F.col(o) if isinstance(o, str) else o for o in order]
    cold, hot = split_hot(df, keys, limit)
    parts = []
    if cold is not None:
        w = ((Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*ocols)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        parts.append(cold.withColumns({f"{c}{suffix}": F.sum(c).over(w) for c in cols}))
    if hot is not None:
        parts.append(_range_running(hot, keys, order, cols, suffix, partitions))
    return _union(parts)


def _running_within(keys: list[str], cols: list[str]):
    """Running sums of ``cols`` over the sorted rows of one partition,
    starting again where the keys change."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, {c: 0 for c in cols}
        for b in batches:
            if not b.num_rows:
                continue
            marks = [b.column(k).to_pylist() for k in keys]
            rows = list(zip(*marks)) if keys else [()] * b.num_rows
            new = np.array([i for i in range(len(rows)) if (rows[i] != rows[i - 1] if i else rows[0] != last)], np.int64)
            sums = []
            for c in cols:
                v = b.column(f"_run_{c}").to_numpy(zero_copy_only=False)
                total = np.cumsum(v)
                head = int(new[0]) if len(new) else len(v)
                # where a sum starts, all before it is taken off
                before = np.where(new > 0, total[new - 1], 0).astype(v.dtype)
                out = total.copy()
                out[head:] -= np.repeat(before, np.diff(np.append(new, len(v))))
                out[:head] += carry[c]
                carry[c] = out[-1]
                sums.append(pa.array(out))
            last = rows[-1]
            keep = [n for n in b.schema.names if not n.startswith("_run_")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *sums], names=[*keep, *(f"_loc_{c}" for c in cols)])
    return run


def _range_running(df: DataFrame, keys: list[str], order, cols, suffix, partitions) -> DataFrame:
    ship_package(df.sparkSession)
    n = _num_partitions(df, partitions)
    ocols = [F.col(o) if isinstance(o, str) else o for o in order]
    sort_cols = [F.col(k) for k in keys] + ocols
    kinds = {c: "double" if df.schema[c].dataType.simpleString() in ("double", "float") else "long" for c in cols}
    s = (df.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols).withColumn("_pid", F.spark_partition_id())
         .withColumns({f"_run_{c}": F.coalesce(F.col(c).cast(kinds[c]), F.lit(0).cast(kinds[c])) for c in cols}))
    plain = s.drop(*[f"_run_{c}" for c in cols])
    schema = plain.select("*", *[F.lit(0).cast(kinds[c]).alias(f"_loc_{c}") for c in cols]).schema
    # the rows stay where the range sort put them: no second exchange
    s = materialize(s.mapInArrow(_running_within(keys, list(cols)), schema), "running")
    runs = s.groupBy("_pid", *keys).agg(*[F.sum(c).alias(f"_tot_{c}") for c in cols])
    if keys:
        wk = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.select(F.col("_pid").alias("_rpid"), *[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[F.coalesce(F.sum(f"_tot_{c}").over(wk), F.lit(0)).alias(f"_off_{c}")
                             for c in cols])
    else:
        runs = F.broadcast(_keyless_offsets(runs, [f"_tot_{c}" for c in cols],
                                            {f"_tot_{c}": f"_off_{c}" for c in cols}, [])
                           .withColumnRenamed("_pid", "_rpid"))
    cond = s["_pid"] == runs["_rpid"]
    for k in keys:
        cond = cond & s[k].eqNullSafe(runs[f"_r_{k}"])
    out = s.join(runs, cond, "inner").withColumns(
        {f"{c}{suffix}": F.coalesce(F.col(f"_off_{c}"), F.lit(0)) + F.col(f"_loc_{c}") for c in cols})
    return out.drop("_pid", "_rpid", *[f"_r_{k}" for k in keys],
                    *[f"_loc_{c}" for c in cols], *[f"_off_{c}" for c in cols])
