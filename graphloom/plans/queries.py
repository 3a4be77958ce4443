"""The catalogue: every operator as a query over the star schema's graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import generators
from graphloom.operators import algorithms, emv, layouts, partitioning, render, stats
from graphloom.operators.graph import Graph
from graphloom.plans.config import RunConfig, cut
from graphloom.sources import text
from graphloom.sources.star import order_chain, part_chain, part_supp

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

UNREACHED_LEVEL, UNREACHED_DISTANCE = -1, 1e9
PARTS, HOPS = 4, 2


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _root(graph: Graph) -> int:
    row = graph.largest().first()
    return row["id"] if row else -1


def _state(graph: Graph) -> DataFrame:
    return graph.out_degrees()


def _owners(graph: Graph) -> DataFrame:
    return graph.vertices.select("id", (F.col("id") % PARTS).cast("int").alias("part"))


def _positions(graph: Graph) -> DataFrame:
    return graph.vertices.select("id", generators.draw(F.col("id"), 1000).alias("x"), generators.draw(F.col("id") + 7, 1000).alias("y"), F.lit(5).alias("radius"))


# ---- degrees and views


@query
def out_degree(spark, sf_dir):
    return part_chain(spark, sf_dir).out_degrees()


@query
def in_degree(spark, sf_dir):
    return part_chain(spark, sf_dir).in_degrees()


@query
def max_degree_vertex(spark, sf_dir):
    return part_chain(spark, sf_dir).largest()


@query
def degree_stats(spark, sf_dir):
    out = stats.degree_stats(order_chain(spark, sf_dir))
    return out.select("max_degree", "min_degree", F.round("avg_degree", 6).alias("avg_degree"), F.round("stddev_degree", 6).alias("stddev_degree"))


@query
def sink_vertices(spark, sf_dir):
    return order_chain(spark, sf_dir).sinks().agg(F.count(F.lit(1)).alias("n"))


@query
def triplets_src(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    return g.triplets(_state(g), both=False).select("src", "dst", "weight", "src_degree")


@query
def triplets(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    return g.triplets(_state(g)).select("src", "dst", "weight", "src_degree", "dst_degree")


@query
def reverse_graph(spark, sf_dir):
    return part_supp(spark, sf_dir).reverse().edges.select("src", "dst", "weight")


@query
def bipartite_undirected(spark, sf_dir):
    return part_supp(spark, sf_dir).edges.select("src", "dst", "weight")


# ---- edge, message and vertex maps


@query
def emv_edge(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    return emv.edge_map(g, _state(g), send=lambda e: e.src_degree + e.weight, active=lambda v: v.degree >= 20)


@query
def emv_vertex(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    largest = emv.combine(g.edges.select(F.col("dst").alias("id"), F.col("weight").alias("val")), "max")
    return emv.vertex_map(_state(g), largest, lambda v: {"score": v.degree * 2 + F.coalesce(v.val, F.lit(0))})


@query
def emv_message(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    sent = emv.edge_map(g, _state(g), send=lambda e: e.weight.cast("bigint"))
    return emv.message_map(sent, lambda m: F.when(m.val > 25, m.val * 2).otherwise(m.val))


@query
def emv_edgelist(spark, sf_dir):
    return emv.edgelist_map(part_chain(spark, sf_dir), _fold)


def _fold(out):
    return F.aggregate(F.transform(out, lambda e, i: (i + 1) * e["weight"].cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)


@query
def emv_edgelist_all(spark, sf_dir):
    """Vertices without out-edges have an empty list."""
    g = order_chain(spark, sf_dir)
    return emv.edgelist_map(g, lambda out: _fold(out) * 10 + F.size(out))


@query
def emv_edgelist_stored(spark, sf_dir):
    return emv.edgelist_map(part_chain(spark, sf_dir, with_eid=True), _fold)


def _weights(g: Graph) -> DataFrame:
    return g.edges.select(F.col("dst").alias("id"), F.col("weight").cast("bigint").alias("val"))


@query
def combine_min(spark, sf_dir):
    g = order_chain(spark, sf_dir)
    return emv.combine(_weights(g), "min", g.vertices, 1_000_000_000)


@query
def combine_max(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    return emv.combine(_weights(g), "max", g.vertices, -1)


@query
def combine_sum(spark, sf_dir):
    g = order_chain(spark, sf_dir)
    return emv.combine(_weights(g), "sum", g.vertices, 0)


@query
def combine_count(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    return emv.combine(_weights(g), "count", g.vertices, 0)


@query
def combine_product(spark, sf_dir):
    g = order_chain(spark, sf_dir)
    return emv.combine(_weights(g), "product", g.vertices, 1.0)


@query
def message_list(spark, sf_dir):
    lists = emv.combine(_weights(part_chain(spark, sf_dir)), "list")
    return lists.select("id", F.size("val").cast("bigint").alias("n"), F.array_join(F.transform("val", lambda x: x.cast("string")), ",").alias("vals"))


def _scan(spark, sf_dir, op):
    g = part_chain(spark, sf_dir, with_eid=True)
    weights = g.edges.select("eid", F.col("weight").cast("bigint").alias("val"))
    messages = layouts.csr(g).join(weights, "eid").select(F.col("dst").alias("id"), "slot", "val")
    return emv.segmented_scan(messages, op, ["slot"]).select(F.col("id").alias("dst"), "slot", "val")


@query
def segmented_scan_min(spark, sf_dir):
    return _scan(spark, sf_dir, "min")


@query
def segmented_scan_sum(spark, sf_dir):
    return _scan(spark, sf_dir, "sum")


@query
def frontier_v2e(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    return emv.edges_of(g, g.vertices.where("id % 100 = 7")).select("src", "dst")


@query
def frontier_e2v(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    return emv.ends_of(emv.edges_of(g, g.vertices.where("id % 100 = 7")))


@query
def frontier_v2e_all(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    return emv.edges_of(g, g.vertices).select("src", "dst")


@query
def frontier_e2v_all(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    return emv.ends_of(emv.edges_of(g, g.vertices))


# ---- breadth-first search


def _bfs(spark, sf_dir, source=part_chain):
    g = source(spark, sf_dir)
    levels, steps = algorithms.bfs(g, _root(g))
    return g, levels, steps


def _levels(spark, sf_dir, source):
    return _bfs(spark, sf_dir, source)[1].select("id", F.coalesce("level", F.lit(UNREACHED_LEVEL)).alias("level"))


@query
def bfs_levels(spark, sf_dir):
    return _levels(spark, sf_dir, part_chain)


@query
def bfs_levels_bipartite(spark, sf_dir):
    return _levels(spark, sf_dir, part_supp)


@query
def bfs_reached(spark, sf_dir):
    return _bfs(spark, sf_dir)[1].agg(F.count("level").alias("n"))


@query
def bfs_steps(spark, sf_dir):
    return spark.range(1).select(F.lit(_bfs(spark, sf_dir)[2]).cast("bigint").alias("steps"))


@query
def bfs_frontier(spark, sf_dir):
    g, levels, _ = _bfs(spark, sf_dir)
    return stats.frontier_sizes(g, levels)


@query
def bfs_edges_traversed(spark, sf_dir):
    g, levels, _ = _bfs(spark, sf_dir)
    return stats.edges_traversed(g, levels)


# ---- shortest paths


def _kept(g: Graph) -> Graph:
    """The graph with its edges kept, for those who read them more than once: the root's choice and each search."""
    return Graph(cut(g.vertices), g.edges.persist())


def _distances(g: Graph, *dense: bool) -> list[tuple[DataFrame, int]]:
    """A search for each of ``dense``, from the same root over edges that are made once."""
    g = _kept(g)
    root = _root(g)
    found = [algorithms.sssp(g, root, d) for d in dense or (False,)]
    g.edges.unpersist()
    return [(f.select("id", F.coalesce("distance", F.lit(UNREACHED_DISTANCE)).alias("distance")), steps) for f, steps in found]


@query
def sssp_dist(spark, sf_dir):
    return _distances(part_chain(spark, sf_dir))[0][0]


@query
def sssp_dist_dense(spark, sf_dir):
    return _distances(part_chain(spark, sf_dir), True)[0][0]


@query
def sssp_lcg(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    return _distances(Graph(g.vertices, g.edges.withColumn("weight", generators.edge_weight(F.col("src"), F.col("dst")))))[0][0]


@query
def sssp_total(spark, sf_dir):
    found = _distances(part_chain(spark, sf_dir))[0][0]
    return found.where(F.col("distance") < UNREACHED_DISTANCE).agg(F.sum("distance").alias("total"), F.count(F.lit(1)).alias("reached"))


@query
def sssp_steps(spark, sf_dir):
    return spark.range(1).select(F.lit(_distances(part_chain(spark, sf_dir))[0][1]).cast("bigint").alias("steps"))


@query
def sssp_selfcheck(spark, sf_dir):
    (a, _), (b, _) = _distances(part_chain(spark, sf_dir), False, True)
    return stats.differing(a, b, "distance").agg(F.count(F.lit(1)).alias("differing"))


# ---- PageRank


def _ranks(g: Graph, steps: int) -> DataFrame:
    return algorithms.pagerank(g, steps).select("id", F.round("rank", 6).alias("rank"))


@query
def pagerank_10(spark, sf_dir):
    return _ranks(part_chain(spark, sf_dir), 10)


@query
def pagerank_10_sinks(spark, sf_dir):
    return _ranks(order_chain(spark, sf_dir), 10)


@query
def pagerank_100(spark, sf_dir):
    return _ranks(part_chain(spark, sf_dir), 100)


@query
def pagerank_total(spark, sf_dir):
    return algorithms.pagerank(order_chain(spark, sf_dir), 100).agg(F.round(F.sum("rank"), 4).alias("total"))


# ---- layouts


def _layout(make):
    return lambda spark, sf_dir: make(part_chain(spark, sf_dir, with_eid=True))


QUERIES["layout_csr"] = _layout(layouts.csr)
QUERIES["layout_meg"] = _layout(layouts.meg)
QUERIES["layout_ell"] = _layout(layouts.ell)
QUERIES["layout_hy"] = _layout(layouts.hybrid)
QUERIES["layout_msgslot"] = _layout(layouts.message_slots)
QUERIES["relabel_by_degree"] = _layout(lambda g: layouts.relabel_by_degree(g).edges.select("eid", "src", "dst"))


# ---- partitions and replicas


def _replicated(spark, sf_dir):
    g = order_chain(spark, sf_dir)
    owners = _owners(g)
    return g, owners, partitioning.replicas(g, owners, HOPS)


@query
def partition_sizes(spark, sf_dir):
    return partitioning.sizes(_owners(order_chain(spark, sf_dir)))


@query
def replica_counts(spark, sf_dir):
    return partitioning.replica_counts(_replicated(spark, sf_dir)[2])


@query
def replica_edges(spark, sf_dir):
    return partitioning.replica_edges(*_replicated(spark, sf_dir), HOPS)


@query
def stored_edges(spark, sf_dir):
    return partitioning.sizes(partitioning.stored_edges(*_replicated(spark, sf_dir), HOPS))


@query
def routing_table(spark, sf_dir):
    _, owners, found = _replicated(spark, sf_dir)
    return partitioning.routing(owners, found)


@query
def replica_segments(spark, sf_dir):
    _, owners, found = _replicated(spark, sf_dir)
    return partitioning.segments(partitioning.routing(owners, found))


@query
def replica_gather(spark, sf_dir):
    g, owners, found = _replicated(spark, sf_dir)
    routes = partitioning.routing(owners, found).where("hop = 0")  # the copies of later hops keep what they have
    copies = found.select("part", "id", F.lit(-1).cast("bigint").alias("degree"))
    return partitioning.refresh(copies, routes, g.in_degrees(), "degree")


@query
def gather_table(spark, sf_dir):
    _, owners, found = _replicated(spark, sf_dir)
    return partitioning.gather_table(owners, partitioning.routing(owners, found))


@query
def scatter_table(spark, sf_dir):
    _, owners, found = _replicated(spark, sf_dir)
    return partitioning.scatter_table(owners, found, partitioning.routing(owners, found))


@query
def replica_index(spark, sf_dir):
    return partitioning.hop_index(partitioning.replica_counts(_replicated(spark, sf_dir)[2]))


@query
def replica_edge_index(spark, sf_dir):
    return partitioning.hop_index(partitioning.replica_edges(*_replicated(spark, sf_dir), HOPS))


def _written(spark, graph: Graph, values: DataFrame, name: str, folder: str) -> tuple[str, str]:
    """The graph and its vertices' values as text files, ids shifted to begin with 1."""
    up = lambda df, *c: df.withColumns({x: F.col(x) + 1 for x in c})
    cut(spark.range(1))  # so that there is a shared folder
    path = f"{spark.sparkContext.getCheckpointDir()}/{folder}"
    text.write_arcs(Graph(up(graph.vertices, "id"), up(graph.edges, "src", "dst")), f"{path}/arcs")
    text.write_values(up(values, "id"), f"{path}/{name}", name)
    return f"{path}/arcs", f"{path}/{name}"


@query
def partition_file(spark, sf_dir):
    """Parts as a partition file gives them: written, read again and checked."""
    g = order_chain(spark, sf_dir)
    _, parts = _written(spark, g, _owners(g), "part", "partition_file")
    return text.read_values(spark, parts, "part", g.vertices.count(), PARTS)


@query
def load_partitioned(spark, sf_dir):
    """Vertices, replicas and stored edges of every part of a graph loaded from its files."""
    g = order_chain(spark, sf_dir)
    got = text.load_partitioned(spark, *_written(spark, g, _owners(g), "part", "load_partitioned"), PARTS, HOPS)
    count = lambda df, name: partitioning.sizes(df).withColumnRenamed("n", name)
    out = count(got.owners, "vertices").join(count(got.replicas, "replicas"), "part", "left").join(count(got.edges, "edges"), "part", "left")
    return out.select("part", "vertices", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("replicas", "edges")])


# ---- generators, text and drawing


@query
def bipartite_file(spark, sf_dir):
    """Arcs one way and a file of sides, read as a graph with arcs both ways."""
    g = generators.bipartite_graph(spark, 1000, 3000)
    one_way = g.edges.join(g.vertices.where("side = 0").select(F.col("id").alias("src")), "src", "left_semi")
    return text.read_bipartite(spark, *_written(spark, Graph(g.vertices.select("id"), one_way), g.vertices, "side", "bipartite_file")).edges


@query
def gen_random(spark, sf_dir):
    return generators.random_graph(spark, 1000, 8).edges


@query
def gen_bipartite(spark, sf_dir):
    return generators.bipartite_graph(spark, 1000, 3000).edges


@query
def gen_zipf_degrees(spark, sf_dir):
    return generators.zipf_degrees(spark, 1000, 20000, 1.1)


@query
def gen_zipf(spark, sf_dir):
    return generators.zipf_graph(spark, 1000, 20000, 1.1).edges


@query
def gt_read(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    shifted = Graph(g.vertices.select((F.col("id") + 1).alias("id")), g.edges.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), "weight"))
    cut(spark.range(1))  # so that there is a shared folder
    path = f"{spark.sparkContext.getCheckpointDir()}/arcs"
    text.write_arcs(shifted, path)
    return text.read_arcs(spark, path).edges


@query
def render_quads(spark, sf_dir):
    return render.quads(_positions(part_chain(spark, sf_dir)))


@query
def render_segments(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    return render.segments(g, _positions(g))


__all__ = ["QUERIES", "RunConfig"]
