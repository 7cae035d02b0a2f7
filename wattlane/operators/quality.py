"""Data-quality operators: imputation, outlier flags and caps, scaling.

Statistics are computed in one aggregate pass, then attached to the rows
as scalar subqueries (one-row results) or by a join on the group key,
which AQE turns into a broadcast once it has measured the small side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.sources.files import load_meta, save_meta

from wattlane.operators.ordering import column_quantiles, median, quantiles, row_literals


def group_null_stats(df: DataFrame, value: str, key: str):
    """One small pass: largest group (``n``), NULL count (``z``) and total
    rows (``t``) -- everything the imputation and per-group routing need."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("z"))
            .agg(F.max("n").alias("n"), F.sum("z").alias("z"), F.sum("n").alias("t")).first())


def impute_median(df: DataFrame, value: str, key: str = "building_id",
                  method: str = "exact", stats=None) -> DataFrame:
    """NULL -> median of the row's group; still NULL -> global median of the
    already group-filled column (two passes, in that order).

    The group-filled table is written once to the scratch folder: the
    global median and every later pass read it instead of redoing the
    group medians and the join."""
    from wattlane.session import materialize

    # One small pass: NULL count and largest group. Without NULLs there is
    # nothing to fill (the result is the input); otherwise the group size
    # routes the medians without a second counting job.
    st = stats if stats is not None else group_null_stats(df, value, key)
    if st is None or not st["z"]:
        return df
    gm = median(df, value, [key], "_gmed", method, max_group=st["n"])
    filled = (df.join(gm, [key], "left")
              .withColumn(value, F.coalesce(F.col(value), F.col("_gmed"))).drop("_gmed"))
    filled = materialize(filled, "group-filled")
    glob = row_literals(median(filled, value, [], "_all", method, max_group=st["t"]))["_all"]
    return filled.withColumn(value, F.coalesce(F.col(value), glob))


def fill_mean(df: DataFrame, cols: Sequence[str], stats_from: DataFrame | None = None) -> DataFrame:
    """NULL -> column mean, the means taken in one pass over ``stats_from``
    (defaults to ``df``; pass the training rows to fit on train only)."""
    src = stats_from if stats_from is not None else df
    means = row_literals(src.select(*[F.avg(c).alias(c) for c in cols]))
    return df.withColumns({c: F.coalesce(F.col(c), means[c]) for c in cols})


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in cols})


def outlier_bounds(df: DataFrame, cols: Sequence[str], factor: float = 1.5,
                   method: str = "exact") -> DataFrame:
    """One row with q05, q25, q75, q95, mean and sample std of every column."""
    parts = []
    for c in cols:
        q = quantiles(df, c, [0.05, 0.25, 0.75, 0.95], [],
                      [f"{c}__q05", f"{c}__q25", f"{c}__q75", f"{c}__q95"], method)
        parts.append(q)
    moments = df.select(*[x for c in cols for x in (F.avg(c).alias(f"{c}__mean"),
                                                   F.stddev_samp(c).alias(f"{c}__std"))])
    return parts, moments


def outlier_flag(x: Column, method: str, factor: float, q25: Column, q75: Column,
                 mean: Column, std: Column) -> Column:
    if method == "iqr":
        iqr = q75 - q25
        return (x < q25 - F.lit(factor) * iqr) | (x > q75 + F.lit(factor) * iqr)
    if method == "zscore":
        return F.abs(F.try_divide(x - mean, std)) > F.lit(factor)
    raise ValueError(f"unknown outlier method {method!r}")


def cap_outliers(df: DataFrame, cols: Sequence[str], method: str = "iqr", factor: float = 1.5,
                 flag_suffix: str | None = None, quantile_method: str = "exact") -> DataFrame:
    """Replace flagged values: above q95 -> q95, otherwise -> q05.

    Quantiles and moments come from the original column. NULL is never
    flagged. A high outlier at or below q95 becomes q05 (kept as is).
    """
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unknown outlier method {method!r}")
    moments = [x for c in cols for x in (F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"))]
    if quantile_method == "exact":
        st = column_quantiles(df, cols, [0.05, 0.25, 0.75, 0.95], moments)
    else:
        parts, mom_df = outlier_bounds(df, cols, factor, quantile_method)
        st = row_literals(mom_df)
        for q in parts:
            st.update(row_literals(q))
    mom = qs = st
    new = {}
    flags = {}
    for c in cols:
        x = F.col(c)
        q05, q25 = qs[f"{c}__q05"], qs[f"{c}__q25"]
        q75, q95 = qs[f"{c}__q75"], qs[f"{c}__q95"]
        flag = F.coalesce(outlier_flag(x, method, factor, q25, q75,
                                       mom[f"{c}__mean"], mom[f"{c}__std"]), F.lit(False))
        new[c] = F.when(flag, F.when(x > q95, q95).otherwise(q05)).otherwise(x)
        if flag_suffix:
            flags[f"{c}{flag_suffix}"] = flag.cast("int")
    if flags:
        df = df.withColumns(flags)
    return df.withColumns(new)


def standardize(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                suffix: str = "") -> DataFrame:
    """(x - mean) / population std, fitted on ``fit_on`` (default ``df``);
    a constant column maps to 0 (sklearn's scaler semantics)."""
    src = fit_on if fit_on is not None else df
    stats = src.select(*[x for c in cols for x in (F.avg(c).alias(f"{c}__m"),
                                                  F.stddev_pop(c).alias(f"{c}__s"))])
    st = row_literals(stats)
    out = {}
    for c in cols:
        m, s = st[f"{c}__m"], st[f"{c}__s"]
        scale = F.when(s == 0, F.lit(1.0)).otherwise(s)
        out[f"{c}{suffix}"] = (F.col(c) - m) / scale
    return df.withColumns(out)


class Scaler:
    """The statistics of ``standardize`` as a model: fit once, apply to any
    table, save and load."""

    def __init__(self, means: dict, stds: dict):
        self.means, self.stds = means, stds

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> "Scaler":
        r = df.select(*[x for c in cols for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))]).first()
        return cls({c: r[f"{c}__m"] for c in cols}, {c: r[f"{c}__s"] for c in cols})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.means[c]).cast("double")) / F.lit(float(self.stds[c] or 1.0)) for c in self.means})

    def save(self, spark, path: str) -> str:
        return save_meta(spark, path, {"means": self.means, "stds": self.stds})

    @classmethod
    def load(cls, spark, path: str) -> "Scaler":
        m = load_meta(spark, path)
        return cls(m["means"], m["stds"])


def ratio_to_mean(x: Column, mean: Column) -> Column:
    """x / mean with pandas' fill: NULL operand or 0/0 -> 1.0, x/0 -> +-inf."""
    inf = F.when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return (F.when((mean == 0) & (x != 0), inf)
            .otherwise(F.coalesce(F.try_divide(x, mean), F.lit(1.0))))


def building_stats(df: DataFrame, value: str = "meter_reading", key: str = "building_id",
                   prefix: str = "building_", method: str = "exact") -> DataFrame:
    """mean, sample std, min, max, median per group (partial aggregation
    for the moments, skew-safe exact median)."""
    mom = df.groupBy(key).agg(F.avg(value).alias(f"{prefix}mean"),
                              F.stddev_samp(value).alias(f"{prefix}std"),
                              F.min(value).alias(f"{prefix}min"),
                              F.max(value).alias(f"{prefix}max"))
    med = median(df, value, [key], f"{prefix}median", method)
    return mom.join(med, [key], "left")
