"""Per-entity lag and rolling features, row ids and chronological splits.

Lags and rolling windows count rows, not hours (use the hourly spine
first for calendar semantics). A rolling statistic is NULL until its
window holds ``size`` non-null values, like pandas ``rolling(size)``.

Skew: entities up to the group limit (``ordering.GROUP_LIMIT``) use a
plain window per entity (one shuffle). Rows of larger entities are
numbered by ``range_positions`` (no single-entity task), cut into blocks
of ``block_rows`` consecutive rows, and the last ``reach`` rows of each
block are copied into the next block as read-only history. The window
then runs per (entity, block), so the largest window partition is
``block_rows + reach`` rows whatever the size of one entity's series.

A window wider than a block is put together from moments (count, mean, sum
of squared deviations, merged as Chan, Golub & LeVeque do): the end of the
block it starts in, the whole blocks between, and the beginning of its own
block. Beginnings and ends are windows within blocks, whole blocks are one
row each, and the row where a window starts is found by an equi-join on the
position, as are lags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlane.operators.ordering import _union, range_positions, split_hot, with_positions
from wattlane.session import materialize

DEFAULT_BLOCK_ROWS = 1 << 20


def _rolling_ok(c: Column, w, size: int) -> Column:
    return F.count(c).over(w) == F.lit(size)


def lag_rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                lags: Sequence[int] = (1, 24), size: int = 24, prefix: str | None = None,
                ratio: bool = False, block_rows: int = DEFAULT_BLOCK_ROWS,
                limit: int | None = None, max_group: int | None = None) -> DataFrame:
    """Add ``{prefix}_lag_{k}``, ``{prefix}_rolling_mean_{size}``,
    ``{prefix}_rolling_std_{size}`` (sample std) and optionally
    ``{prefix}_ratio_mean`` = value / rolling mean (NULL on 0 or NULL)."""
    keys = list(keys)
    prefix = prefix or value
    reach = max(max(lags, default=0), size - 1)
    if block_rows < 1:
        raise ValueError("block_rows must be positive")
    v = F.col(value)

    def features(w) -> dict:
        wr = w.rowsBetween(-(size - 1), 0)
        cols = {f"{prefix}_lag_{k}": F.lag(v, k).over(w) for k in lags}
        ok = _rolling_ok(v, wr, size)
        cols[f"{prefix}_rolling_mean_{size}"] = F.when(ok, F.avg(v).over(wr))
        cols[f"{prefix}_rolling_std_{size}"] = F.when(ok, F.stddev_samp(v).over(wr))
        return cols

    cold, hot = split_hot(df, keys, limit, max_group)
    parts = []
    if cold is not None:
        w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*order)
        parts.append(cold.withColumns(features(w)))
    if hot is not None and block_rows <= reach:
        parts.append(_wide(hot, keys, order, value, lags, size, prefix, block_rows))
    elif hot is not None:
        p = range_positions(hot, keys, order, "_pos")
        blk = F.floor(F.col("_pos") / F.lit(block_rows))
        targets = F.when(F.col("_pos") % F.lit(block_rows) >= F.lit(block_rows - reach),
                         F.array(blk, blk + 1)).otherwise(F.array(blk))
        p = p.withColumn("_blk", F.explode(targets)).withColumn("_home", blk == F.col("_blk"))
        w = Window.partitionBy(*keys, "_blk").orderBy("_pos")
        parts.append(p.withColumns(features(w)).where("_home").drop("_pos", "_blk", "_home"))
    out = _union(parts)
    if ratio:
        out = out.withColumn(f"{prefix}_ratio_mean",
                             F.try_divide(v, F.col(f"{prefix}_rolling_mean_{size}")))
    return out


def _merged(parts: Sequence[tuple[Column, Column, Column]]) -> tuple[Column, Column, Column]:
    """(n, mean, m2) of several disjoint parts; an empty part has n 0 and
    anything else."""
    n, mean, m2 = parts[0]
    n, mean, m2 = F.coalesce(n, F.lit(0)), F.coalesce(mean, F.lit(0.0)), F.coalesce(m2, F.lit(0.0))
    for k, a, b in parts[1:]:
        k, a, b = F.coalesce(k, F.lit(0)), F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
        all_ = F.greatest(n + k, F.lit(1))
        gap = a - mean
        n, mean, m2 = n + k, mean + gap * k / all_, m2 + b + gap * gap * n * k / all_
    return n, mean, m2


def _wide(df: DataFrame, keys: list[str], order: Sequence[str], value: str, lags: Sequence[int], size: int, prefix: str, block: int) -> DataFrame:
    """The features of ``lag_rolling`` for windows that span blocks."""
    names = df.columns
    block = max(min(block, size - 1), 1)                          # a window never lies in one block
    p = range_positions(df, keys, order, "_pos").withColumn("_blk", F.floor(F.col("_pos") / block).cast("long"))
    v = F.col(value).cast("double")
    w = Window.partitionBy(*keys, "_blk").orderBy("_pos")

    def moments(x, tag: str) -> dict:
        return {f"_n{tag}": F.count(v).over(x), f"_a{tag}": F.avg(v).over(x), f"_m{tag}": F.count(v).over(x) * F.var_pop(v).over(x)}
    p = materialize(p.withColumns(moments(w.rowsBetween(Window.unboundedPreceding, 0), "b") | moments(w.rowsBetween(0, Window.unboundedFollowing), "e")), "wide-rows")
    whole = p.groupBy(*keys, "_blk").agg(F.count(v).alias("_n"), F.avg(v).alias("_a"), (F.count(v) * F.var_pop(v)).alias("_m"))
    by_block = Window.partitionBy(*keys).orderBy("_blk")
    least = (size - 1) // block                                   # blocks from the window's start to its end, or one more
    total = whole
    for tag, span in (("0", least), ("1", least + 1)):
        if span > 1:
            x = by_block.rangeBetween(-(span - 1), -1)
            n, s = F.sum("_n").over(x), F.sum(F.col("_n") * F.coalesce("_a", F.lit(0.0))).over(x)
            mean = s / F.greatest(n, F.lit(1))
            # deviations of the blocks' means from theirs, kept as a difference of block sums
            m2 = F.sum(F.coalesce("_m", F.lit(0.0))).over(x) + F.greatest(F.sum(F.col("_n") * F.coalesce("_a", F.lit(0.0)) * F.coalesce("_a", F.lit(0.0))).over(x) - n * mean * mean, F.lit(0.0))
        else:
            n, mean, m2 = F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0)
        total = total.withColumns({f"_n{tag}": n, f"_a{tag}": mean, f"_m{tag}": m2})
    total = total.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_blk").alias("_b"), *[f"_{c}{t}" for t in "01" for c in "nam"])

    def same(other: str) -> Column | None:
        on = None
        for i, k in enumerate(keys):
            e = F.col(k).eqNullSafe(F.col(f"{other}{i}"))
            on = e if on is None else on & e
        return on

    def joined(left: DataFrame, right: DataFrame, other: str, extra: Column) -> DataFrame:
        on = same(other)
        return left.join(right, extra if on is None else on & extra, "left").drop(*[f"{other}{i}" for i in range(len(keys))])
    start = p.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], (F.col("_pos") + (size - 1)).alias("_at"), F.col("_blk").alias("_from"),
                     *[F.col(f"_{c}e").alias(f"_{c}s") for c in "nam"])
    out = joined(p, start, "_j", F.col("_pos") == F.col("_at"))
    out = joined(out, total, "_k", F.col("_blk") == F.col("_b"))
    between = [F.when(F.col("_blk") - F.col("_from") == least, F.col(f"_{c}0")).otherwise(F.col(f"_{c}1")) for c in "nam"]
    n, mean, m2 = _merged([tuple(F.col(f"_{c}s") for c in "nam"), tuple(between), tuple(F.col(f"_{c}b") for c in "nam")])
    full = F.col("_from").isNotNull() & (n == size)
    if size == 1:
        full, mean = F.col(value).isNotNull(), F.col(value).cast("double")
    out = out.withColumns({f"{prefix}_rolling_mean_{size}": F.when(full, mean),
                           f"{prefix}_rolling_std_{size}": F.when(full & (F.lit(size) > 1), F.sqrt(m2 / F.lit(max(size - 1, 1))))})
    for k in lags:
        back = p.select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(keys)], (F.col("_pos") + k).alias("_to"), F.col(value).alias(f"{prefix}_lag_{k}"))
        out = joined(out, back, "_l", F.col("_pos") == F.col("_to")).drop("_to")
    return out.select(*names, *[f"{prefix}_lag_{k}" for k in lags], f"{prefix}_rolling_mean_{size}", f"{prefix}_rolling_std_{size}")


def row_ids(df: DataFrame, order: Sequence[str], name: str = "row_id",
            limit: int | None = None) -> DataFrame:
    """Surrogate id 0..n-1 in ``order`` (which should be total). Above the
    group limit it comes from per-partition offsets, never from a
    single-partition window."""
    return with_positions(df, [], order, name, limit=limit)


def chronological_split(df: DataFrame, order: Sequence[str], test_size: float = 0.2,
                        name: str = "is_test", limit: int | None = None) -> DataFrame:
    """First ``int(n * (1 - test_size))`` rows in ``order`` are train, the rest
    test. Only the count reaches the driver."""
    n = df.count()
    cutoff = F.lit(int(n * (1.0 - test_size)))
    p = with_positions(df, [], order, "_pos", limit=limit, max_group=n)
    return p.withColumn(name, (F.col("_pos") >= cutoff).cast("int")).drop("_pos")
