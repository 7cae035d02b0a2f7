"""Connected components by alternating large-star and small-star rounds.

Each round is a grouped minimum (combined before the shuffle) and a join
back on it, so a node with a third of all links never has to sit in one
group; every round's links are written to the scratch folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import stage


def _with_min(links: DataFrame) -> DataFrame:
    """u, v, m: the smallest of u and its neighbours next to each link."""
    low = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(low, "u")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``links``
    (two long columns u, v; any order, repeats allowed, nulls ignored)."""
    links = links.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    links = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _with_min(large)
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        links = stage(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    return (links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes under links a-b
    (hooking on the smaller root, then pointer jumping)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        if (lo == hi).all():
            return root
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
