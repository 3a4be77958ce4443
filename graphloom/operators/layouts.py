"""Adjacency layouts: where each edge (eid, src, dst) is stored.

Vertices are numbered i = 0, 1, ... by id, or by out-degree (largest first) and id; a vertex's edges
k = 0, 1, ... by descending eid. Places come from range-partitioned numbering, so that no hub's edges and no
global order has to pass one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.plans.config import numbered, scanned

HYBRID_WIDTH = 16


def _vertices(graph: Graph, by_degree: bool, sums: dict | None = None) -> DataFrame:
    order = [F.desc("degree"), F.asc("id")] if by_degree else [F.asc("id")]
    return numbered(graph.out_degrees(), order, "i", sums)


def _ranked(graph: Graph) -> DataFrame:
    """Edges with k, their place among their source's. A hub's edges may lie in many ranges."""
    return scanned(graph.edges, [F.asc("src"), F.desc("eid")], ["src"], {"k": ("count", F.lit(1))}).withColumn("k", F.col("k") - 1)


def _place(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return edges.join(vertices.withColumnRenamed("id", "src"), "src")


def csr(graph: Graph) -> DataFrame:
    """Edges of vertex i from the sum of the degrees before it."""
    return numbered(graph.edges, [F.asc("src"), F.desc("eid")], "slot").select("eid", "src", "dst", "slot")


def ell(graph: Graph) -> DataFrame:
    """slot = i + k * vertices, column by column."""
    n = graph.vertices.count()
    return _place(_ranked(graph), _vertices(graph, False)).select("eid", "src", "dst", (F.col("i") + F.col("k") * n).alias("slot"))


def meg(graph: Graph) -> DataFrame:
    """Like ell over vertices by degree, without holes: column k starts after the edges of smaller k."""
    ranked = _ranked(graph)
    columns = numbered(ranked.groupBy("k").agg(F.count(F.lit(1)).alias("n")), [F.asc("k")], "_", {"start": F.col("n")}).select("k", "start")
    return _place(ranked, _vertices(graph, True)).join(columns, "k").select("eid", "src", "dst", (F.col("i") + F.col("start")).alias("slot"))


def hybrid(graph: Graph, width: int = HYBRID_WIDTH) -> DataFrame:
    """ell for k < width, the rest one after the other behind it; vertices by degree."""
    n = graph.vertices.count()
    vertices = _vertices(graph, True, {"over": F.greatest(F.col("degree") - width, F.lit(0))})
    slot = F.when(F.col("k") < width, F.col("i") + F.col("k") * n).otherwise(F.lit(n * width) + F.col("over") + F.col("k") - width)
    return _place(_ranked(graph), vertices).select("eid", "src", "dst", slot.alias("slot"))


def message_slots(graph: Graph) -> DataFrame:
    """eid, slot (of csr), message_slot: messages lie by destination, and there by slot; head: the first of each."""
    placed = scanned(csr(graph), [F.asc("dst"), F.asc("slot")], ["dst"], {"nth": ("count", F.lit(1))}, index="message_slot")
    return placed.select("eid", "src", "dst", "slot", "message_slot", (F.col("nth") == 1).cast("int").alias("head"))


def relabel_by_degree(graph: Graph) -> Graph:
    """The same graph with ids 0, 1, ... by descending out-degree, then id."""
    ids = _vertices(graph, True).select("id", "i")
    edges = graph.edges.join(ids.select(F.col("id").alias("src"), F.col("i").alias("_src")), "src").join(ids.select(F.col("id").alias("dst"), F.col("i").alias("_dst")), "dst")
    edges = edges.withColumns({"src": F.col("_src"), "dst": F.col("_dst")}).select(*graph.edges.columns)
    return Graph(ids.select(F.col("i").alias("id")), edges)
