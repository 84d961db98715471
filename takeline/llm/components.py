"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames.

Every step aggregates a minimum per node (combined before the shuffle) and joins it back, so no node's neighbours
are gathered into a list; a hub is a skewed join key, which adaptive execution splits.  Edges are cut to the shared
folder once a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeline.llm.common import cut


#: Edges that one partition holds between rounds, at least, so that few edges don't make many small files.
EDGES_A_PART = 10_000


def _cut(edges: DataFrame) -> DataFrame:
    edges = cut(edges)
    return edges.coalesce(1 + edges.count() // EDGES_A_PART)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with a smaller one in its component, from ``u, v`` pairs of longs.

    ``root`` is the smallest node.  Loops, repeated and reversed edges are harmless; no edges give no rows.
    """
    e = _cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        e = _cut(small.distinct())
        # Done when every child has one parent and no parent is a child.
        role = e.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        open_ = role.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or (child = 1 and parent = 1)")
        if not open_.limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
