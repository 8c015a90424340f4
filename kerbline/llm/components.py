"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import discard, stored


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with the least node of u, from a stored table.

    As the least nodes are stored, both sides are shuffled for the join, or the small one is
    broadcast, and a node with a third of all links is a partition that adaptive
    execution splits. Aggregated and joined in one stage, it would be one task's.
    """
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return _joined(both.filter("v > u"), least).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    rest = _joined(down, least).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("u", "m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected links; root is the component's least node.

    Each round rewires links towards smaller nodes and stores the distinct rest, so rounds
    grow with the logarithm of the longest path. Minima come from map-side aggregation and
    are joined back, so a node with a third of all links is never one group in one task.
    Links with a NULL end and links of a node to itself are left out; no links give no rows.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    now, seen = stored(links, "links"), None
    while True:
        large = stored(_large_star(now), "links")
        after = stored(_small_star(large).distinct(), "links")
        discard(large)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
