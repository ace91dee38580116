"""Connected components of a table of links, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def _minima(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with low: the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("low"))
    return pairs.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest id that each linked node reaches. Staged.

    Rounds of two steps: each node hands its larger neighbours to its least one, then its smaller ones. Paths halve from
    round to round; when nothing changes, each node hangs on its root alone. No group is gathered: a step is a minimum for
    each node, and a join that Spark may split where a node has many links.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minima(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        low = _minima(large)
        small = low.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
        edges = staged(small.filter("u <> v").distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
