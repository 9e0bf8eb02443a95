"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotext.llm.texts import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a BIGINT, b BIGINT, a <> b): root is the smallest node reachable.

    Alternating large-star and small-star steps: each links the neighbours of a node to
    the smallest of them, so paths shrink geometrically while the number of edges does
    not grow.  The smallest neighbour is a map-side combined aggregate; the join with it
    is a plain equi-join of two stored tables, whose hot nodes adaptive execution splits.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(linked.unionByName(low.withColumnRenamed("m", "v")).distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
