"""A directed multigraph: vertices(id, ...) and edges(src, dst, weight, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.config import partitions


@dataclass(frozen=True)
class Graph:
    """Parallel edges and self loops are kept; vertices exist by themselves, with or without edges."""

    vertices: DataFrame
    edges: DataFrame

    def check(self) -> Graph:
        """Raise if an edge ends at no vertex, an id is null or repeated, or a weight is negative."""
        ids = self.vertices.select("id")
        if not ids.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty():
            raise ValueError("vertex ids must be unique and not null")
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        if not ends.where("id IS NULL").isEmpty() or not ends.join(ids, "id", "left_anti").isEmpty():
            raise ValueError("every edge must run between vertices")
        if "weight" in self.edges.columns and not self.edges.where("weight < 0").isEmpty():
            raise ValueError("weights must not be negative")
        return self

    def by(self, key: str) -> Graph:
        """The graph with its edges kept in memory, partitioned by ``src`` or ``dst`` for repeated use."""
        return Graph(self.vertices, self.edges.repartition(partitions(self.edges.sparkSession), key).persist())

    def reverse(self) -> Graph:
        other = {"src": "dst", "dst": "src"}
        return Graph(self.vertices, self.edges.select(*[F.col(other.get(c, c)).alias(c) for c in self.edges.columns]))

    def undirected(self) -> Graph:
        """Each edge in both directions (a bag: nothing is merged)."""
        return Graph(self.vertices, self.edges.unionByName(self.reverse().edges))

    def out_degrees(self) -> DataFrame:
        return self._degrees("src")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst")

    def _degrees(self, end: str) -> DataFrame:
        counts = self.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))

    def triplets(self, state: DataFrame, both: bool = True) -> DataFrame:
        """Edges with the columns of ``state`` (id, ...) of their source as src_*, and of their end as dst_*."""
        named = lambda end: state.withColumnsRenamed({"id": end} | {c: f"{end}_{c}" for c in state.columns if c != "id"})
        out = self.edges.join(named("src"), "src")
        return out.join(named("dst"), "dst") if both else out

    def sinks(self) -> DataFrame:
        """Vertices without out-edges."""
        return self.vertices.join(self.edges.select(F.col("src").alias("id")), "id", "left_anti")

    def largest(self) -> DataFrame:
        """The vertex with the most out-edges; the smallest id among equals."""
        return self.out_degrees().orderBy(F.desc("degree"), "id").limit(1)
