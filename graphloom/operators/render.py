"""Drawing data: corners of a square for each vertex, and a segment for each edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph


def quads(positions: DataFrame) -> DataFrame:
    """(id, x, y, radius) -> (id, corner, x, y): upper left, upper right, lower right, lower left, in pixels."""
    left, right = F.col("x") - F.col("radius"), F.col("x") + F.col("radius") - 1
    low, high = F.col("y") - F.col("radius"), F.col("y") + F.col("radius") - 1
    corners = F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((left, high), (right, high), (right, low), (left, low))])
    return positions.select("id", F.posexplode(corners).alias("corner", "at")).select("id", "corner", "at.x", "at.y")


def segments(graph: Graph, positions: DataFrame) -> DataFrame:
    """(src, dst, x0, y0, x1, y1)."""
    return graph.triplets(positions.select("id", "x", "y")).select("src", "dst", *[F.col(f"{e}_{c}").cast("double").alias(f"{c}{i}") for i, e in enumerate(("src", "dst")) for c in ("x", "y")])
