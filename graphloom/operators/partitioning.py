"""Partitioned graphs: owners, replicas by hop, routing, stored edges, and the refresh of replicas.

``owners`` is (id, part). A replica of hop h in a part is a vertex of another part from which h + 1 edges,
no fewer, lead to one of the part's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.plans.config import cut, scanned


def sizes(owners: DataFrame) -> DataFrame:
    return owners.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def _owned(graph: Graph, owners: DataFrame) -> DataFrame:
    """Distinct edges with the parts of both ends."""
    s, d = owners.select(F.col("id").alias("src"), F.col("part").alias("src_part")), owners.select(F.col("id").alias("dst"), F.col("part").alias("dst_part"))
    return graph.edges.join(s, "src").join(d, "dst")


def replicas(graph: Graph, owners: DataFrame, max_hop: int) -> DataFrame:
    """(part, id, hop): search against the edges' direction from every part at once."""
    edges = _owned(graph, owners).select("src", "dst", "src_part", "dst_part").distinct()
    seen = frontier = cut(edges.where("src_part <> dst_part").select(F.col("dst_part").alias("part"), F.col("src").alias("id")).distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, max_hop):
        back = edges.join(frontier.select("part", F.col("id").alias("dst")), "dst").where("src_part <> part").select("part", F.col("src").alias("id")).distinct()
        frontier = cut(back.join(seen, ["part", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def replica_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("part", "hop").agg(F.count(F.lit(1)).alias("n"))


def replica_edges(graph: Graph, owners: DataFrame, found: DataFrame, max_hop: int) -> DataFrame:
    """(part, hop, n): edges from outside into the part (hop 0), and edges into its replicas of hop - 1."""
    cross = _owned(graph, owners).where("src_part <> dst_part").groupBy(F.col("dst_part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    ends = found.where(F.col("hop") < max_hop - 1).select("part", F.col("id").alias("dst"), (F.col("hop") + 1).alias("hop"))
    further = graph.edges.join(ends, "dst").groupBy("part", "hop").agg(F.count(F.lit(1)).alias("n"))
    return cross.select("part", F.lit(0).alias("hop"), "n").unionByName(further)


def stored_edges(graph: Graph, owners: DataFrame, found: DataFrame, max_hop: int) -> DataFrame:
    """(part, src, dst): an edge lies with its end's owner, and wherever the end is a replica but of the last hop."""
    own = graph.edges.join(owners.select(F.col("id").alias("dst"), "part"), "dst")
    copied = graph.edges.join(found.where(F.col("hop") < max_hop - 1).select(F.col("id").alias("dst"), "part"), "dst")
    return own.select("part", "src", "dst").unionByName(copied.select("part", "src", "dst"))


def routing(owners: DataFrame, found: DataFrame) -> DataFrame:
    """(owner, part, id, hop): where each vertex's state has to go."""
    return found.join(owners.select("id", F.col("part").alias("owner")), "id").select("owner", "part", "id", "hop")


def segments(routes: DataFrame) -> DataFrame:
    """(owner, part, n) and where the segment starts in the owner's gather list and in the part's scatter list."""
    counts = routes.groupBy("owner", "part").agg(F.count(F.lit(1)).alias("n"))  # a row a pair of parts
    before = lambda by, order: F.coalesce(F.sum("n").over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.select("owner", "part", "n", before("owner", "part").alias("gather_start"), before("part", "owner").alias("scatter_start"))


def local_ids(owners: DataFrame) -> DataFrame:
    """(id, part, local): the place of each vertex among its owner's, by id."""
    return scanned(owners.select("part", "id"), ["part", "id"], ["part"], {"local": ("count", F.lit(1))}).select("id", "part", (F.col("local") - 1).alias("local"))


def physical_ids(owners: DataFrame, found: DataFrame) -> DataFrame:
    """(part, id, hop, physical): where a part keeps its replicas, behind its own vertices, by hop and id."""
    placed = scanned(found.select("part", "hop", "id"), ["part", "hop", "id"], ["part"], {"nth": ("count", F.lit(1))})
    placed = placed.join(F.broadcast(sizes(owners)), "part", "left")  # a row a part
    return placed.select("part", "id", "hop", (F.coalesce("n", F.lit(0)) + F.col("nth") - 1).alias("physical"))


def gather_table(owners: DataFrame, routes: DataFrame) -> DataFrame:
    """(owner, place, part, id, hop, local): what each owner sends, by the part it goes to, and there by hop and id."""
    listed = scanned(routes.select("owner", "part", "hop", "id"), ["owner", "part", "hop", "id"], ["owner"], {"nth": ("count", F.lit(1))})
    return listed.join(local_ids(owners).select("id", "local"), "id").select("owner", (F.col("nth") - 1).alias("place"), "part", "id", "hop", "local")


def scatter_table(owners: DataFrame, found: DataFrame, routes: DataFrame) -> DataFrame:
    """(part, place, owner, id, hop, physical): what each part gets, by the owner it comes from, in the order in which that sends it."""
    listed = scanned(routes.select("part", "owner", "hop", "id"), ["part", "owner", "hop", "id"], ["part"], {"nth": ("count", F.lit(1))})
    return listed.join(physical_ids(owners, found).drop("hop"), ["part", "id"]).select("part", (F.col("nth") - 1).alias("place"), "owner", "id", "hop", "physical")


def hop_index(counts: DataFrame) -> DataFrame:
    """(part, hop, n) and ``start``: what lies in the part's earlier hops. For replicas and for their edges; a row a part and hop."""
    before = F.sum("n").over(W.partitionBy("part").orderBy("hop").rowsBetween(W.unboundedPreceding, -1))
    return counts.select("part", "hop", "n", F.coalesce(before, F.lit(0)).cast("bigint").alias("start"))


@dataclass(frozen=True)
class Partitioned:
    """A graph with its owners (id, part), replicas (part, id, hop), routes (owner, part, id, hop) and stored edges (part, src, dst)."""

    graph: Graph
    owners: DataFrame
    replicas: DataFrame
    routes: DataFrame
    edges: DataFrame


def partition(graph: Graph, owners: DataFrame, max_hop: int) -> Partitioned:
    found = replicas(graph, owners, max_hop)
    return Partitioned(graph, owners, found, routing(owners, found), stored_edges(graph, owners, found, max_hop))


def refresh(copies: DataFrame, routes: DataFrame, state: DataFrame, value: str) -> DataFrame:
    """``copies`` (part, id, value) with the owners' values where a route has one, and their own where not."""
    sent = routes.select("part", "id").join(state.select("id", F.col(value).alias("_new")), "id")
    return copies.join(sent, ["part", "id"], "left").select("part", "id", F.coalesce("_new", value).alias(value))
