"""Exploratory aggregates: profiles, group means, histograms, box
statistics, correlations, previews and samples.

All of these are aggregations with partial (map-side) combine; the only
exact order statistics go through the skew-safe ``quantiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, FloatType, MapType, NumericType, StructType

from wattlane.operators.ordering import one_row, quantiles


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns in schema order (booleans are not numeric)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)
            and f.name not in set(exclude)]


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, column, null_count) for every column in one pass."""
    cols = list(cols or df.columns)
    wide = df.select(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"{i}, '{c}', c{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (ordinal, column_name, null_count)")


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """(ordinal, column, type, distinct, nulls, completeness text) per column.

    Distinct counts exclude NULL. ``approx=True`` uses HyperLogLog++
    (``approx_count_distinct``), one aggregate for all columns. Exact counts
    read the table once, whatever the number of columns: every row becomes
    one (ordinal, value) pair a column, equal pairs are combined before the
    one exchange that brings a value's pairs together, and what is left is
    counted by column.
    """
    spark = df.sparkSession
    kinds = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    names = spark.createDataFrame(kinds, "ordinal int, column_name string, data_type string")
    if approx:
        wide = df.select(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(df.columns) for x in (
            F.approx_count_distinct(F.col(c)).alias(f"d{i}"), F.count_if(F.col(c).isNull()).alias(f"z{i}"))])
        stack = ", ".join(f"{i}, d{i}, z{i}" for i in range(len(kinds)))
        counts = wide.selectExpr("n", f"stack({len(kinds)}, {stack}) AS (ordinal, distinct_values, null_values)")
    else:
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), _as_text(df, c).alias("value")) for i, c in enumerate(df.columns)])).alias("p"))
        each = pairs.groupBy("p.ordinal", "p.value").agg(F.count("*").alias("k"))
        counts = each.groupBy("ordinal").agg(F.count("value").alias("distinct_values"),
                                             F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0)).alias("null_values"), F.sum("k").alias("n"))
    # one row a column: of an empty table there are no pairs
    out = names.join(counts, "ordinal", "left").select(*names.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("distinct_values", "null_values", "n")])
    pct = F.bround(F.try_divide((F.col("n") - F.col("null_values")) * 100.0, F.col("n")), 1)
    return out.withColumn("completeness", F.when(pct.isNotNull(), F.concat(F.format_string("%.1f", pct), F.lit("%")))).drop("n")


def _as_text(df: DataFrame, c: str) -> Column:
    """A text that tells the column's values apart as ``=`` does (0.0 and
    -0.0 are one value); long ones by their SHA-256."""
    kind = df.schema[c].dataType
    v = F.col(c)
    if isinstance(kind, (DoubleType, FloatType)):
        t = F.when(v == 0, F.lit("0")).otherwise(v.cast("string"))
    elif isinstance(kind, BinaryType):
        t = F.hex(v)
    elif isinstance(kind, (ArrayType, MapType, StructType)):
        t = F.to_json(F.struct(v))
        t = F.when(v.isNotNull(), t)
    else:
        t = v.cast("string")
    return F.when(F.length(t) > 60, F.concat(F.lit("sha256:"), F.sha2(t, 256))).otherwise(t)


def dataset_summary(df: DataFrame, key: str = "building_id", label: str = "anomaly",
                    ts: str = "timestamp") -> DataFrame:
    """rows, columns, buildings, anomalies, anomaly rate %, first/last day,
    whole-day span and total nulls, all in one aggregate."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.select(
        F.count(F.lit(1)).alias("total_records"),
        F.lit(len(df.columns)).alias("features"),
        F.count_distinct(key).alias("buildings"),
        F.sum(label).cast("long").alias("anomalies"),
        (F.avg(label) * 100).alias("anomaly_rate"),
        F.to_date(F.min(ts)).alias("first_day"),
        F.to_date(F.max(ts)).alias("last_day"),
        span_days(F.min(ts), F.max(ts)).alias("span_days"),
        nulls.cast("long").alias("missing_values"),
    )


def span_days(lo: Column, hi: Column) -> Column:
    """Whole days between two timestamps (timedelta ``.days``: floor).
    ``timestamp_diff`` on zone-less timestamps ignores the session zone, so
    a daylight-saving change cannot shift the span."""
    micros = F.timestamp_diff("MICROSECOND", lo, hi)
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """count and share % per value; the share divides by a scalar subquery."""
    total = df.select(F.count(F.lit(1))).scalar()
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("share_pct", F.col("count") * 100.0 / total))


def group_stats(df: DataFrame, by: Sequence[str] | str, value: str,
                stats: Sequence[str] = ("mean",), prefix: str = "") -> DataFrame:
    """mean / std (sample) / min / max / sum / count per group."""
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
           "sum": F.sum, "count": F.count}
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(*[fns[s](value).alias(f"{prefix}{s}") for s in stats])


def histogram(df: DataFrame, value: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram between the (global) min and max; the last bin
    is closed; empty bins are present with count 0; a constant column puts
    everything in bin 0. Output: bin, bin_lo, bin_hi, count."""
    spark = df.sparkSession
    bounds = one_row(df.select(F.min(value).alias("mn"), F.max(value).alias("mx")))
    mn, mx = bounds["mn"], bounds["mx"]
    width = (mx - mn) / F.lit(float(bins))
    idx = F.when(mx == mn, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - mn) / width).cast("int"), F.lit(bins - 1)))
    counts = (df.where(F.col(value).isNotNull()).groupBy(*by, idx.alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        grid = (counts.select(*by).distinct()
                .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))))
    out = grid.join(counts, [*by, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.select(*by, "bin", (mn + F.col("bin") * width).alias("bin_lo"),
                      (mn + (F.col("bin") + 1) * width).alias("bin_hi"), F.col("count").cast("long"))


def box_stats(df: DataFrame, value: str, by: Sequence[str] = (), whis: float = 1.5) -> DataFrame:
    """q1, median, q3, whiskers (furthest data within 1.5 IQR of the box),
    outlier count and n per group. Quartiles are exact and skew-safe; the
    second pass joins them back on the group key."""
    by = list(by)
    q = quantiles(df, value, [0.25, 0.5, 0.75], by, ["q1", "median", "q3"])
    lo_f = F.col("q1") - F.lit(whis) * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + F.lit(whis) * (F.col("q3") - F.col("q1"))
    x = F.col(value)
    if by:
        joined = df.where(x.isNotNull()).join(q, by, "inner")
    else:
        qs = one_row(q)
        joined = df.where(x.isNotNull()).withColumns(
            {"q1": qs["q1"], "median": qs["median"], "q3": qs["q3"]})
    agg = joined.groupBy(*by).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(x >= lo_f, x)).alias("whisker_lo"),
        F.max(F.when(x <= hi_f, x)).alias("whisker_hi"),
        F.count_if((x < lo_f) | (x > hi_f)).alias("outliers"),
        F.count(F.lit(1)).alias("n"))
    return agg


def _pair_moments(x: Column, y: Column, tag: str) -> list[Column]:
    """Sums over the rows where both x and y are present (pairwise-complete)."""
    xp = F.when(y.isNotNull(), x)
    yp = F.when(x.isNotNull(), y)
    return [F.count(xp + yp).alias(f"n{tag}"), F.sum(xp).alias(f"sx{tag}"), F.sum(yp).alias(f"sy{tag}"),
            F.sum(xp * xp).alias(f"sxx{tag}"), F.sum(yp * yp).alias(f"syy{tag}"),
            F.sum(xp * yp).alias(f"sxy{tag}")]


def _corr_from_moments(tag: str) -> Column:
    n = F.col(f"n{tag}").cast("double")
    mx, my = F.col(f"sx{tag}") / n, F.col(f"sy{tag}") / n
    cov = F.col(f"sxy{tag}") / n - mx * my
    vx = F.col(f"sxx{tag}") / n - mx * mx
    vy = F.col(f"syy{tag}") / n - my * my
    # a constant side (variance zero up to rounding) has no correlation
    tiny_x = vx <= F.lit(1e-12) * (F.col(f"sxx{tag}") / n)
    tiny_y = vy <= F.lit(1e-12) * (F.col(f"syy{tag}") / n)
    r = F.try_divide(cov, F.sqrt(vx * vy))
    return (F.when((n == 0) | tiny_x | tiny_y, F.lit(None).cast("double"))
            .otherwise(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))))


def correlation_matrix(df: DataFrame, cols: Sequence[str], lower_only: bool = False) -> DataFrame:
    """Long-form Pearson matrix (i, j, col_i, col_j, corr) on pairwise-complete
    rows, then ``stack``. A constant side gives NULL, never a divide-by-zero.
    ``lower_only`` keeps i > j (the masked heatmap).

    A first, cheap pass counts NULLs and takes the mean per column (values
    are centred on it). Pairs of NULL-free columns
    share per-column sums and need one cross sum each; only pairs touching a
    column with NULLs carry their own masked sums. Everything else is ONE
    aggregate of plain sums, which stays inside codegen."""
    cols = list(cols)
    first = df.select(*[F.count_if(F.col(c).isNull()).alias(f"z{i}") for i, c in enumerate(cols)],
                      *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    has_null = [bool(first[f"z{i}"]) for i in range(len(cols))]
    # centred values: correlation is shift-invariant, and centring keeps the
    # plain sums free of cancellation for large-magnitude columns
    x = {c: F.col(c).cast("double") - F.lit(first[f"m{i}"] or 0.0) for i, c in enumerate(cols)}
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols)) if i >= j]
    aggs = [F.count(F.lit(1)).alias("n_all")]
    for i, c in enumerate(cols):
        if not has_null[i]:
            aggs += [F.sum(x[c]).alias(f"s{i}"), F.sum(x[c] * x[c]).alias(f"ss{i}")]
    for i, j in pairs:
        tag = f"{i}_{j}"
        if has_null[i] or has_null[j]:
            aggs += _pair_moments(x[cols[i]], x[cols[j]], tag)
        elif i != j:
            aggs.append(F.sum(x[cols[i]] * x[cols[j]]).alias(f"sxy{tag}"))
    moments = df.select(*aggs)
    shared = {}
    for i, j in pairs:
        tag = f"{i}_{j}"
        if not (has_null[i] or has_null[j]):
            shared.update({f"n{tag}": F.col("n_all"), f"sx{tag}": F.col(f"s{i}"), f"sy{tag}": F.col(f"s{j}"),
                           f"sxx{tag}": F.col(f"ss{i}"), f"syy{tag}": F.col(f"ss{j}"),
                           f"sxy{tag}": F.col(f"ss{i}") if i == j else F.col(f"sxy{tag}")})
    moments = moments.withColumns(shared)
    wide = moments.select(*[_corr_from_moments(f"{i}_{j}").alias(f"p{i}_{j}") for i, j in pairs])
    entries = []
    for i, j in pairs:
        entries.append(f"{i}, {j}, '{cols[i]}', '{cols[j]}', p{i}_{j}")
        if i != j and not lower_only:
            entries.append(f"{j}, {i}, '{cols[j]}', '{cols[i]}', p{i}_{j}")
    long = wide.selectExpr(f"stack({len(entries)}, {', '.join(entries)}) AS (i, j, col_i, col_j, corr)")
    return long.where("i > j") if lower_only else long


def weekday_means(df: DataFrame, value: str, ts: str = "timestamp") -> DataFrame:
    """Mean by day name in Monday..Sunday order; a weekday with no rows is
    present with NULL (left join from the 7-day spine)."""
    from wattlane.functions.calendar import day_name

    spark = df.sparkSession
    means = df.groupBy(F.weekday(ts).alias("dow")).agg(F.avg(value).alias("mean"))
    days = spark.range(7).select(F.col("id").cast("int").alias("dow"))
    names = F.element_at(F.array(*[F.lit(n) for n in ("Monday", "Tuesday", "Wednesday", "Thursday",
                                                     "Friday", "Saturday", "Sunday")]),
                         F.col("dow") + 1)
    return (days.join(means, "dow", "left")
            .select("dow", names.alias("day_name"), F.left(names, F.lit(3)).alias("day_abbr"), "mean"))


def daily_counts(df: DataFrame, flag: str = "anomaly", ts: str = "timestamp") -> DataFrame:
    """Number of flagged rows per calendar date; dates with none are absent."""
    return (df.where(F.col(flag) == 1).groupBy(F.to_date(ts).alias("date"))
            .agg(F.count(F.lit(1)).alias("anomalies")))


def bounded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``min(n, rows)`` rows without replacement: the n smallest
    md5(key || seed). Deterministic; each task keeps only its own top n
    (TakeOrderedAndProject), so at most n rows per task move."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def preview(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First n rows in an explicit order."""
    return df.orderBy(*order).limit(n)
