"""Registry of every implemented operator as a runnable query.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, duckdb_sql | None)``.
Names start with the operator id of the blueprint. Each query reads the
driver's tables (whole tables; no row caps) and each SQL twin computes the
same result independently in DuckDB; queries without SQL are checked by
row count and by property tests.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattlane.sources import tables as T

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


TWO_PI = 2 * math.pi

R = f"WITH {T.SQL_READINGS}\n"
LB = f"WITH {T.SQL_LABELLED}\n"
SC = f"WITH {T.SQL_SCORED}\n"
SH = f"WITH {T.SQL_SHIPMENTS}\n"
Q = f"WITH {T.SQL_QUALITY}\n"


def cal_sql(ts: str = '"timestamp"', minute: bool = False, day_cycle: bool = True,
            month_cycle: bool = True) -> str:
    """DuckDB select-list for the calendar columns of ``add_calendar``."""
    parts = [f"CAST(year({ts}) AS INTEGER) AS year", f"CAST(month({ts}) AS INTEGER) AS month",
             f"CAST(day({ts}) AS INTEGER) AS day", f"CAST(hour({ts}) AS INTEGER) AS hour"]
    if minute:
        parts.append(f"CAST(minute({ts}) AS INTEGER) AS minute")
    parts += [f"CAST(isodow({ts}) - 1 AS INTEGER) AS dayofweek",
              f"CAST(isodow({ts}) - 1 >= 5 AS INTEGER) AS is_weekend"]
    if month_cycle:
        parts += [f"sin({TWO_PI!r} * month({ts}) / 12.0) AS month_sin",
                  f"cos({TWO_PI!r} * month({ts}) / 12.0) AS month_cos"]
    parts += [f"sin({TWO_PI!r} * hour({ts}) / 24.0) AS hour_sin",
              f"cos({TWO_PI!r} * hour({ts}) / 24.0) AS hour_cos"]
    if day_cycle:
        parts += [f"sin({TWO_PI!r} * (isodow({ts}) - 1) / 7.0) AS day_sin",
                  f"cos({TWO_PI!r} * (isodow({ts}) - 1) / 7.0) AS day_cos"]
    return ", ".join(parts)


# Import the families; each module registers its queries on import.
from wattlane.plans import q_sources  # noqa: E402,F401
from wattlane.plans import q_relational  # noqa: E402,F401
from wattlane.plans import q_explore  # noqa: E402,F401
from wattlane.plans import q_evaluate  # noqa: E402,F401
from wattlane.plans import q_models  # noqa: E402,F401
from wattlane.plans import q_pipelines  # noqa: E402,F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in QUERIES.items() if v[1]}
