"""Connected components of an edge table, as Spark jobs.

Alternating large-star and small-star steps (Kiveris et al., Connected
Components in MapReduce and Beyond, 2014): every step hangs the neighbours of a
vertex onto the smallest of them, with at most as many edges as before.  It
ends when every edge points straight at its component's smallest vertex, after
a number of rounds that grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """edges (u, v), u > v.  Large star: of u's neighbours the larger ones hang
    onto the smallest of u and them; small star: the smaller ones and u do.  The
    second table is what the first is read from."""
    ways = edges.select("u", "v")
    if large:
        ways = ways.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # The minimum by map-side combining and a join that can be split: a
    # vertex with a third of all edges is nobody's single task.
    least = materialize(ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "stars")
    joined = ways.join(least, "u")
    moved = joined.where("v > u") if large else joined.where("v <> m")
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), least


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (a, b); component is the
    smallest id of its component."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        hung, large = _star(now, large=True)
        hung, small = _star(hung, large=False)
        before, now = now, materialize(hung, "edges")
        discard(before, large, small)
        # Done when each u has one edge and no v is itself hung elsewhere.
        several = now.groupBy("u").count().where("count > 1")
        chained = now.join(now.select(F.col("u").alias("v")), "v", "left_semi")
        if several.isEmpty() and chained.isEmpty():
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
