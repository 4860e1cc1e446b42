"""Connected components by alternating large and small stars, each round a staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour larger than a vertex is linked to the least of the vertex and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Staged, so that the join deals both sides anew: Spark can split the rays of a large hub then.
    least, _ = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "stars")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its neighbours smaller than itself are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). A row (node, component) for each node that has an edge to another;
    component is the least node that is reachable. Null and looped edges are ignored.

    A round halves the depth of every tree at least, so their number grows with its logarithm. Stars
    with many rays are aggregated before the shuffle, and the join on a large hub is split by Spark."""
    spark = edges.sparkSession
    now, path = stage(edges.where("u != v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        nxt, new = stage(_small_star(_large_star(now)), "edges")
        drop(spark, path)
        now, path = nxt, new
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
