"""Deterministic splits and per-group samples.

All draws are by md5 of the row key and a seed -- never ``rand()`` -- so a
recomputed partition after an executor loss picks the same rows, and the
same rule runs in plain SQL. A label is a hot key (one of two classes), so
the border between the parts is found by selection, not by ranking rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.operators.ordering import one_row
from wattlane.operators.selection import smallest


def hash_order(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2,
                     seed: int = 42, name: str = "is_validation") -> DataFrame:
    """Per label value, the ``round(test_size * n_label)`` rows with the
    smallest md5(key || seed) go to validation (``name`` = 1)."""
    take = df.groupBy(label).agg(F.round(F.lit(test_size) * F.count(F.lit(1))).cast("long").alias("_take"))
    return smallest(df, label, hash_order(key, seed), key, take, name).withColumn(name, F.col(name).cast("int"))


def group_fraction_sample(df: DataFrame, group: str, key: str, rate: float,
                          seed: int = 42) -> DataFrame:
    """``floor(n_group * rate)`` rows per group without replacement: the
    smallest md5(key || seed) of each group."""
    take = df.groupBy(group).agg(F.floor(F.count(F.lit(1)) * F.lit(rate)).cast("long").alias("_take"))
    return smallest(df, group, hash_order(key, seed), key, take, "_in").where("_in").drop("_in")


def balanced_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """n / (k * n_class) for binary labels (sklearn 'balanced'), from one
    counting pass attached as a scalar subquery."""
    c = one_row(df.select(F.count(F.lit(1)).alias("n"),
                          F.count_if(F.col(label) == 0).alias("n0"),
                          F.count_if(F.col(label) == 1).alias("n1")))
    k = (F.when(c["n0"] > 0, 1).otherwise(0) + F.when(c["n1"] > 0, 1).otherwise(0)).cast("double")
    w = F.when(F.col(label) == 1, c["n"] / (k * c["n1"])).otherwise(c["n"] / (k * c["n0"]))
    return df.withColumn(name, w)
