"""Connected components of a table of links, by alternating large and small stars.

Each step replaces links so that every node points at smaller ones; no node's neighbours ever meet in one place (minima are
partial aggregates, and joins may split a hot node). Every step's links are a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: each node links its larger neighbours to its smallest one; small: its smaller ones and itself."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    out = both.join(low, "x").select("x", "y", "m")
    if large:
        out = out.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, most_steps: int = 50) -> DataFrame:
    """links (a, b): any order, repeats and loops allowed. Returns (node, component) for each node that has a link to another."""
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = written(edges, spark, "links")
    mark = None
    for _ in range(most_steps):
        edges = written(_star(_star(edges, True), False), spark, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"links did not settle in {most_steps} steps")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
