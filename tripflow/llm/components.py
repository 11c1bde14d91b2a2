"""Connected components by alternating star contraction (each round halves what is not yet a star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.session import durable


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it reaches) for every node of ``links`` (columns x, y).

    Both steps are an aggregate with map-side minimum and a join back to the edges, so a hub with any number of links is
    never gathered in one task. The edges of a round are a table in the shared folder.
    """
    edges = links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct()
    edges, seen = durable(edges, "links"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(_least(both).withColumn("m", F.least("m", "u")), "least")
        far = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        far = durable(far.filter("u <> v").distinct(), "far")
        least = durable(_least(far), "least")
        near = far.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = durable(near.filter("u <> v").distinct(), "links")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
