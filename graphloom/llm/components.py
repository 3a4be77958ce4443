"""Connected components of an edge table, by alternating large and small stars.

All steps are joins and aggregations of (u, v) rows; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import settle, small


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """Each node's larger neighbours, or its smaller ones and itself, are tied to the least of all."""
    parts = max(1, -(-n // 100_000))
    near = edges.union(edges.select("v", "u")) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts)
    tied = near.join(small(least, n), "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return out.distinct().coalesce(parts)


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, root) of every node of ``edges`` (u, v), and their number; the root is the component's least node."""
    edges, n = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while n:
        edges, n = settle(_star(_star(edges, n, True), n, False))
        before, mark = mark, (n, edges.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0])
        if mark == before:
            break
    return settle(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
