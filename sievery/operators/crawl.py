"""Breadth-first discovery over links, a level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievery.storage import Workspace


def crawl(start: DataFrame, links: DataFrame, depth: int, work: Workspace) -> DataFrame:
    """Nodes (node) within ``depth`` steps of ``start`` over ``links`` (source, target): node and depth, the least.

    The frontier of each level is what its links reach and no earlier level has; the loop ends early when it is empty.
    """
    visited = work.table(start.select("node").distinct().withColumn("depth", F.lit(0)), "visited")
    frontier = visited
    for level in range(1, depth + 1):
        reached = links.join(frontier, links["source"] == frontier["node"], "left_semi").select(F.col("target").alias("node")).distinct()
        frontier = work.table(reached.join(visited, "node", "left_anti").withColumn("depth", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        visited = work.table(visited.unionByName(frontier), "visited")
    return visited
