"""Traversals of a network, layer by layer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_table(df: DataFrame, *by: str) -> DataFrame:
    """df as a table (in folders of the columns `by`) in the folder that the cluster shares (spark.checkpoint.dir, which must be set), so that lineage stays short."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/fieldglass-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def layers(seeds: DataFrame, edges: DataFrame, key: list[str], depth: int) -> DataFrame:
    """Breadth-first search: (key..., depth) of every node that is at most `depth` steps from a seed.

    seeds has the key columns, the last of which is the node; edges has them too, and `target`. Every layer is a join
    with the edges and an anti join with what has been visited, written to the shared folder."""
    *scope, node = key
    visited = shared_table(seeds.select(*key).distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    for step in range(1, depth + 1):
        found = frontier.select(*key).join(edges.select(*key, "target"), key).select(*scope, F.col("target").alias(node)).where(F.col(node).isNotNull()).distinct()
        fresh = shared_table(found.join(visited.select(*key), key, "left_anti").withColumn("depth", F.lit(step)))
        if fresh.isEmpty():
            break
        visited, frontier = visited.unionByName(fresh), fresh
    return visited


def crawl(spark: SparkSession, seeds: DataFrame, neighbors: DataFrame, depth: int) -> DataFrame:
    """Devices by layer: neighbors is (scan_id, mgmt_ip, remote_ip, crawl) and only neighbours that may be crawled are visited."""
    edges = neighbors.where("crawl").select("scan_id", "mgmt_ip", F.col("remote_ip").alias("target"))
    return layers(seeds, edges, ["scan_id", "mgmt_ip"], depth)
