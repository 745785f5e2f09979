"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Hubs stay cheap: minima are pre-aggregated before the shuffle, and the join that hands them
    out is one that adaptive execution can split."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    out = out.where("u <> v")
    return out if large else out.distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(u, root) for every node of edges(u, v), root being the smallest node reachable. Nodes may be of any
    ordered type. Rounds grow with the logarithm of the longest path; only a checksum reaches the driver."""
    edges = stored(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        edges = stored(spark, _star(_star(edges, True), False), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    roots = edges.select("u", F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
