"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per vertex, aggregated before the shuffle, and a join; no
vertex's neighbours are gathered. Rounds grow with the logarithm of the longest
chain. Edges stay in the shared folder between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import packed


def _linked(edges: DataFrame, both: bool) -> DataFrame:
    """Links each vertex's neighbours to the smallest vertex around: the larger
    neighbours (both), or the smaller ones and the vertex itself."""
    if both:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = edges.join(least, "u")
    if both:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # the vertex's own link to the smallest is the one of the edge to it
    return near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a vertex with no other edge to a vertex that leads nowhere."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    wrong = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out > 0 AND into > 0")
    return wrong.limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (u, v) other than the components' smallest
    ones, which are their own. Nulls are left out."""
    edges = packed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(edges):
        edges = packed(_linked(_linked(edges, True), False))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
