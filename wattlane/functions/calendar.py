"""Calendar and cyclic features (column expressions, no UDFs)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Season names by month. English names label the panel,
# French names label the single series.
SEASONS_EN = {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8), "Fall": (9, 10, 11)}
SEASONS_FR = {"Hiver": (12, 1, 2), "Printemps": (3, 4, 5), "Été": (6, 7, 8), "Automne": (9, 10, 11)}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of_week(ts: Column | str) -> Column:
    """Monday = 0 ... Sunday = 6 (Spark's ``weekday``; ``dayofweek`` is Sunday = 1)."""
    return F.weekday(_c(ts))


def is_weekend(ts: Column | str) -> Column:
    return (F.weekday(_c(ts)) >= 5).cast("int")


def cyclic(value: Column | str, period: float) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*value/period."""
    angle = F.lit(2 * math.pi) * _c(value) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def season(month: Column | str, names: dict[str, tuple[int, ...]] = SEASONS_EN) -> Column:
    m = _c(month)
    expr = None
    for label, months in names.items():
        expr = F.when(m.isin(*months), F.lit(label)) if expr is None else expr.when(m.isin(*months), F.lit(label))
    return expr


def day_name(ts: Column | str) -> Column:
    """English day name; independent of the JVM locale."""
    names = F.array(*[F.lit(n) for n in
                      ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")])
    return F.element_at(names, F.weekday(_c(ts)) + 1)


def add_calendar(df: DataFrame, ts: str = "timestamp", minute: bool = False,
                 day_cycle: bool = True, month_cycle: bool = True) -> DataFrame:
    """year, month, day, hour, [minute], dayofweek, is_weekend and cyclic columns."""
    t = F.col(ts)
    cols = {
        "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t),
    }
    if minute:
        cols["minute"] = F.minute(t)
    cols["dayofweek"] = F.weekday(t)
    cols["is_weekend"] = is_weekend(t)
    if month_cycle:
        cols["month_sin"], cols["month_cos"] = cyclic(F.month(t), 12)
    cols["hour_sin"], cols["hour_cos"] = cyclic(F.hour(t), 24)
    if day_cycle:
        cols["day_sin"], cols["day_cos"] = cyclic(F.weekday(t), 7)
    return df.withColumns(cols)


def hourly_spine(df: DataFrame, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """One row per key and per hour from the global first to last hour.

    The bounds are a scalar subquery (one small aggregate), the keys a
    distinct (partial aggregation), and the hours are generated per key by
    ``explode(sequence(...))`` inside the task holding the key -- no join.
    """
    bounds = df.select(F.date_trunc("hour", F.min(ts)).cast("timestamp_ntz").alias("lo"),
                       F.date_trunc("hour", F.max(ts)).cast("timestamp_ntz").alias("hi"))
    lo = bounds.select("lo").scalar()
    hi = bounds.select("hi").scalar()
    keys_df = df.select(*keys).distinct()
    hours = F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 HOUR")))
    return keys_df.select(*keys, hours.alias(ts))
