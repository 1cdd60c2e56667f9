"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a grouped minimum (combined before the shuffle) and an equi-join; each round is written to the
shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard


def _star(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, with the least node of each neighbourhood, itself included."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a")


def _large(edges: DataFrame) -> DataFrame:
    star = _star(edges)
    return star.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of an edge table (a, b); the component is its least node.

    Nodes without an edge to another node are not returned; nulls are no nodes; no edges give no rows.
    """
    now = cut(edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).collect()[0]
        if new == state or new[0] == 0:
            break
        state, before = new, now
        now = cut(_small(_large(before)), "edges")
        discard(before)
    roots = now.groupBy("b").agg(F.first("b").alias("component")).select(F.col("b").alias("node"), "component")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
