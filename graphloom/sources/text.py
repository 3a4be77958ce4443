"""Text formats: arcs with a header, one value a vertex, adjacency lists; and graphs loaded from several files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.operators.partitioning import Partitioned, partition
from graphloom.plans.config import numbered


def read_arcs(spark: SparkSession, path: str) -> Graph:
    """``p <tag> N M`` gives the vertices 1 to N, each ``a src dst weight`` an edge; other lines are comments.

    No or more than one header is an error at once, an arc line without its three fields when the edges are read.
    """
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    headers = parts.where(F.col("f")[0] == "p").select(F.get("f", F.lit(2)).try_cast("bigint").alias("n")).limit(2).collect()
    if len(headers) != 1 or headers[0].n is None:
        raise ValueError(f"{path} must have one header line: p <tag> <vertices> <edges>")
    arcs = parts.where(F.col("f")[0] == "a")
    told = F.when(F.size("f") >= 4, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not an arc: "), F.array_join("f", " "))).cast("array<string>"))
    arcs = arcs.select(told.alias("f")).select(F.col("f")[1].cast("bigint").alias("src"), F.col("f")[2].cast("bigint").alias("dst"), F.col("f")[3].cast("double").alias("weight"))
    return Graph(spark.range(1, headers[0].n + 1), arcs)


def write_arcs(graph: Graph, path: str, tag: str = "sp") -> None:
    """What ``read_arcs`` reads; ids should be 1 to N."""
    spark = graph.edges.sparkSession
    n, m = graph.vertices.count(), graph.edges.count()
    header = spark.range(1).select(F.lit(f"p {tag} {n} {m}").alias("value"))
    weight = F.col("weight") if "weight" in graph.edges.columns else F.lit(1)
    arcs = graph.edges.select(F.concat_ws(" ", F.lit("a"), "src", "dst", weight).alias("value"))
    header.union(arcs).write.mode("overwrite").text(path)


def read_values(spark: SparkSession, path: str, name: str, vertices: int | None = None, kinds: int | None = None) -> DataFrame:
    """(id, name): the i-th whole number belongs to vertex i, from 1 (parts, or sides of a bipartite graph).

    Of several files the one of the lesser name comes first. With ``vertices`` there must be as many numbers, with ``kinds`` they
    must be 0 to ``kinds`` - 1, the last one among them. A line is two bytes, and Spark takes the rows for as few: the hint keeps
    it from sending all vertices through the driver.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
        F.posexplode(F.split(F.trim("value"), r"\s+")).alias("at", "v"),
    ).where("v <> ''")
    out = numbered(lines, [F.asc("file"), F.asc("block"), F.asc("line"), F.asc("at")], "i").select((F.col("i") + 1).alias("id"), F.col("v").cast("int").alias(name))
    found = out.agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).first()
    if vertices is not None and found.n != vertices:
        raise ValueError(f"{path} has {found.n} values for {vertices} vertices")
    if kinds is not None and (found.high is None or found.low < 0 or found.high + 1 != kinds):
        raise ValueError(f"{path} has values from {found.low} to {found.high}, not 0 to {kinds - 1}")
    return out.hint("merge")


def write_values(values: DataFrame, path: str, name: str) -> None:
    """What ``read_values`` reads, from (id, name) with ids 1 to N: files in the order of ids."""
    ordered = values.repartitionByRange("id").sortWithinPartitions("id")
    ordered.select(F.col(name).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_bipartite(spark: SparkSession, arcs: str, sides: str) -> Graph:
    """Arcs, each in both directions, and vertices with their ``side``, 0 or 1. An arc within a side is an error."""
    graph = read_arcs(spark, arcs)
    vertices = read_values(spark, sides, "side", graph.vertices.count(), 2)
    end = lambda c: vertices.select(F.col("id").alias(c), F.col("side").alias(f"{c}_side"))
    if not graph.edges.join(end("src"), "src").join(end("dst"), "dst").where("src_side = dst_side").isEmpty():
        raise ValueError(f"{arcs} has an arc within one side of {sides}")
    return Graph(vertices, graph.edges).undirected()


def load_partitioned(spark: SparkSession, arcs: str, parts: str, devices: int, max_hop: int) -> Partitioned:
    """A graph from its arcs and its partition file, checked, with owners, replicas up to ``max_hop``, routes and stored edges.

    With one device the partition file is not looked at: all is part 0's.
    """
    graph = read_arcs(spark, arcs)
    if devices == 1:
        owners = graph.vertices.select("id", F.lit(0).alias("part"))
    else:
        owners = read_values(spark, parts, "part", graph.vertices.count(), devices)
    return partition(graph, owners, max_hop)


def write_adjacency(graph: Graph, path: str) -> None:
    """A line a vertex: its id and where its out-edges end, sorted."""
    lists = graph.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("out"))
    lines = graph.vertices.select("id").join(lists, "id", "left").select(F.concat_ws(" ", F.col("id").cast("string"), F.coalesce(F.transform("out", lambda x: x.cast("string")), F.array().cast("array<string>"))).alias("value"))
    lines.write.mode("overwrite").text(path)
