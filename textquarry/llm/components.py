"""Connected components by alternating large-star and small-star steps, with each step's edges in the shared folder.

A node's least neighbour is a sum with a map-side part, joined back to its edges: a node with very many edges is split by that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours move to the least node around it: those above it (large), or it and those below (small)."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is the least node that can be reached."""
    edges = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == seen:
            break
        seen, before = sums, edges
        edges = settle(_star(settle(_star(edges, True), "edges"), False), "edges")
        discard(before)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
