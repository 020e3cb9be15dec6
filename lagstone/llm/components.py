"""Connected components by alternating large-star and small-star rounds; edges stay distributed and are written after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagstone.llm import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node reached) of every node of ``edges``; self loops and repeated edges are allowed."""
    edges = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u"))
    edges = common.stage(edges.where("u != v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))  # u: node, v: neighbour
        least = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: every node has smaller neighbours only
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, edges = edges, common.stage(small.where("u != v").distinct(), "edges")
        common.drop(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
