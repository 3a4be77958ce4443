"""Edge, message and vertex maps. User logic is given as functions of a row's columns that return Columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.plans.config import scanned

#: How messages to one vertex become one. ``list`` keeps all, sorted.
COMBINERS: dict[str, Callable[[str], Column]] = {
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "product": F.product,
    "count": F.count,
    "any": F.bool_or,
    "list": lambda c: F.sort_array(F.collect_list(c)),
}


class Row:
    """Columns by attribute: ``row.weight`` or, of an edge's ends, ``row.src_rank``."""

    def __init__(self, alias: str | None = None) -> None:
        self._alias = alias

    def __getattr__(self, name: str) -> Column:
        return F.col(f"{self._alias}.{name}" if self._alias else name)


def edge_map(graph: Graph, state: DataFrame, send: Callable[[Row], Column], active: Callable[[Row], Column] | None = None, to: str = "dst") -> DataFrame:
    """Messages (id, val): one for each edge whose source is active. Inactive sources go before the join."""
    if active is not None:
        state = state.where(active(Row()))
    triplets = graph.triplets(state, both=False)
    return triplets.select(F.col(to).alias("id"), send(Row()).alias("val"))


def edgelist_map(graph: Graph, fold: Callable[[Column], Column], value: str = "val") -> DataFrame:
    """(id, value): ``fold`` of each vertex's out-edges, an array of (dst, weight), empty for a vertex without.

    Edges that have an ``eid`` come as they are stored, the last one first (as in the layouts); others sorted by (dst, weight).
    """
    ends = F.struct("dst", "weight")
    if "eid" in graph.edges.columns:
        stored = F.sort_array(F.collect_list(F.struct("eid", ends.alias("edge"))), asc=False)
        lists = graph.edges.groupBy(F.col("src").alias("id")).agg(F.transform(stored, lambda e: e["edge"]).alias("out"))
    else:
        lists = graph.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(ends)).alias("out"))
    none = F.array().cast(lists.schema["out"].dataType)
    return graph.vertices.select("id").join(lists, "id", "left").select("id", F.coalesce("out", none).alias("out")).select("id", fold(F.col("out")).alias(value))


def message_map(messages: DataFrame, change: Callable[[Row], Column]) -> DataFrame:
    return messages.withColumn("val", change(Row()))


def combine(messages: DataFrame, op: str, vertices: DataFrame | None = None, init: object = None) -> DataFrame:
    """(id, val), one a vertex. With ``vertices``, those without a message have ``init``."""
    out = messages.groupBy("id").agg(COMBINERS[op]("val").alias("val"))
    if vertices is None:
        return out
    out = vertices.select("id").join(out, "id", "left")
    return out if init is None else out.withColumn("val", F.coalesce("val", F.lit(init)))


def vertex_map(state: DataFrame, messages: DataFrame | None, update: Callable[[Row], Mapping[str, Column]]) -> DataFrame:
    """``state`` with columns changed; with ``messages``, ``row.val`` is the vertex's message or null."""
    if messages is None:
        return state.withColumns(dict(update(Row())))
    return state.join(messages, "id", "left").withColumns(dict(update(Row()))).drop("val")


def segmented_scan(messages: DataFrame, op: str, order: list[str]) -> DataFrame:
    """Inclusive running ``op`` of the messages to each vertex; a vertex's messages are a segment, which many tasks may share."""
    return scanned(messages.withColumnRenamed("val", "_in"), ["id", *order], ["id"], {"val": (op, F.col("_in"))}).select(*messages.columns)


def edges_of(graph: Graph, frontier: DataFrame) -> DataFrame:
    """Vertex frontier (id) -> edge frontier: the out-edges of its vertices."""
    return graph.edges.join(frontier.select(F.col("id").alias("src")).distinct(), "src", "left_semi")


def ends_of(edges: DataFrame) -> DataFrame:
    """Edge frontier -> vertex frontier: where its edges end, each once."""
    return edges.select(F.col("dst").alias("id")).distinct()
