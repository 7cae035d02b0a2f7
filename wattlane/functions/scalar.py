"""Small scalar helpers: clipping, z-scores, label maps, text formatting,
one-hot columns and vector arithmetic. All are JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (``greatest``/``least`` would skip it)."""
    x = _c(x)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def abs_zscore(x: Column | str, mean: Column, std: Column) -> Column:
    return F.abs(F.try_divide(_c(x) - mean, std))


def detector_label(score: Column | str, offset: Column | float) -> Column:
    """Isolation-style decision: score below the offset -> anomaly (1), else 0."""
    off = offset if isinstance(offset, Column) else F.lit(float(offset))
    return F.when(_c(score) < off, 1).otherwise(0)


def title_case(name: Column | str) -> Column:
    """'one_class_svm' -> 'One Class Svm'."""
    return F.initcap(F.regexp_replace(_c(name), "_", " "))


def fixed_text(x: Column | str, decimals: int = 3, missing: str = "N/A") -> Column:
    """Half-even rounding first, then fixed decimals; NULL -> ``missing``."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(missing)).otherwise(
        F.format_string(f"%.{decimals}f", F.bround(x, decimals)))


def percent_text(x: Column | str, decimals: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{decimals}f", F.bround(_c(x), decimals)), F.lit("%"))


def thousands_text(x: Column | str) -> Column:
    """Integer with thousands separators: 1234567 -> '1,234,567'."""
    return F.format_number(_c(x).cast("double"), 0)


def label_text(x: Column | str, normal: str = "Normal", anomalous: str = "Anomalie") -> Column:
    return F.when(_c(x) == 0, F.lit(normal)).otherwise(F.lit(anomalous))


def one_hot(x: Column | str, categories: Sequence[str], prefix: str) -> dict[str, Column]:
    """Fixed-domain one-hot columns in sorted category order; NULL or an
    unknown value gives all zeros."""
    x = _c(x)
    return {f"{prefix}_{v}": F.coalesce((x == F.lit(v)).cast("int"), F.lit(0))
            for v in sorted(categories)}


def mean_squared_diff(a: Column | str, b: Column | str) -> Column:
    """Row-wise mean of (a_i - b_i)^2 over two equal-length arrays."""
    sq = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v) / F.size(_c(a))
