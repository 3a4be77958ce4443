"""Statistics of graphs and of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph


def degree_stats(graph: Graph) -> DataFrame:
    """Largest, smallest, mean and population deviation of the out-degree over all vertices."""
    d = F.col("degree")
    return graph.out_degrees().agg(F.max(d).alias("max_degree"), F.min(d).alias("min_degree"), F.avg(d).alias("avg_degree"), F.stddev_pop(d).alias("stddev_degree"))


def frontier_sizes(graph: Graph, levels: DataFrame) -> DataFrame:
    """level, vertices on it, and the edges that it expands."""
    reached = levels.where("level IS NOT NULL").join(graph.out_degrees(), "id")
    return reached.groupBy("level").agg(F.count(F.lit(1)).alias("vertices"), F.sum("degree").alias("edges"))


def edges_traversed(graph: Graph, levels: DataFrame) -> DataFrame:
    """The out-edges of all reached vertices: each expands once."""
    reached = levels.where("level IS NOT NULL").select("id")
    return graph.out_degrees().join(reached, "id", "left_semi").agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("n"))


def differing(a: DataFrame, b: DataFrame, value: str, tolerance: float = 1e-3) -> DataFrame:
    """Rows of two results (id, value) that differ by more than the tolerance, or where one is null or missing."""
    both = a.select("id", F.col(value).alias("x")).join(b.select("id", F.col(value).alias("y")), "id", "full")
    return both.where((F.col("x").isNull() != F.col("y").isNull()) | (F.abs(F.col("x") - F.col("y")) > tolerance))
