"""Graphs small enough to check by hand, and laws that hold for any."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import generators
from graphloom.operators import algorithms, emv, layouts, partitioning, stats
from graphloom.operators.graph import Graph
from graphloom.plans import queries
from graphloom.plans.config import RunConfig, blocks, numbered


def graph(spark, ids, edges):
    v = spark.createDataFrame([(i,) for i in ids], "id long")
    return Graph(v, spark.createDataFrame([(n, *e) for n, e in enumerate(edges)], "eid long, src long, dst long, weight double"))


def values(df, *columns):
    return {r[0]: r[1] if len(columns) == 2 else tuple(r)[1:] for r in df.select(*columns).collect()}


@pytest.fixture(scope="module")
def diamond(spark):
    return graph(spark, range(1, 6), [(1, 2, 1.0), (1, 3, 4.0), (2, 3, 1.0), (3, 4, 1.0)])


def test_bfs_on_diamond(diamond):
    levels, steps = algorithms.bfs(diamond, 1)
    assert values(levels, "id", "level") == {1: 0, 2: 1, 3: 1, 4: 2, 5: None}
    assert steps == 3


@pytest.mark.parametrize("dense", [False, True])
def test_sssp_on_diamond(diamond, dense):
    found, steps = algorithms.sssp(diamond, 1, dense)
    assert values(found, "id", "distance") == {1: 0, 2: 1, 3: 2, 4: 3, 5: None}
    assert steps == 4


def test_beyond_the_broadcast_bound_results_are_the_same(diamond):
    config = RunConfig(broadcast_rows=0)
    assert values(algorithms.bfs(diamond, 1, config)[0], "id", "level")[4] == 2
    assert values(algorithms.sssp(diamond, 1, config=config)[0], "id", "distance")[4] == 3
    a, b = (values(algorithms.pagerank(diamond, 7, config=c), "id", "rank") for c in (config, None))
    assert a == pytest.approx(b)


def test_unknown_root_reaches_nothing(diamond):
    assert set(values(algorithms.bfs(diamond, 99)[0], "id", "level").values()) == {None}


def test_parallel_edges_and_loops(spark):
    g = graph(spark, [1, 2], [(1, 2, 5.0), (1, 2, 3.0), (2, 2, 0.0)])
    assert values(algorithms.sssp(g, 1)[0], "id", "distance")[2] == 3
    assert values(g.out_degrees(), "id", "degree") == {1: 2, 2: 1}
    assert values(algorithms.pagerank(g, 1), "id", "rank") == pytest.approx({1: 0.15, 2: 0.15 + 0.85 * 2})


def test_pagerank_with_a_sink(spark):
    g = graph(spark, range(1, 5), [(2, 1, 1.0), (3, 1, 1.0), (4, 1, 1.0)])
    assert values(algorithms.pagerank(g, 5), "id", "rank") == pytest.approx({1: 0.5325, 2: 0.15, 3: 0.15, 4: 0.15})
    assert [r.id for r in g.sinks().collect()] == [1]


def test_negative_weights_are_refused(spark):
    g = graph(spark, [1, 2], [(1, 2, -1.0)])
    with pytest.raises(ValueError):
        algorithms.sssp(g, 1)
    with pytest.raises(ValueError):
        g.check()


def test_check_finds_loose_ends(spark):
    with pytest.raises(ValueError):
        graph(spark, [1], [(1, 2, 1.0)]).check()
    with pytest.raises(ValueError):
        graph(spark, [1, 1], []).check()


def test_halo(spark):
    g = graph(spark, range(1, 5), [(1, 3, 1.0), (2, 1, 1.0), (3, 4, 1.0)])
    owners = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "id long, part int")
    found = partitioning.replicas(g, owners, 2)
    assert sorted(map(tuple, found.select("part", "id", "hop").collect())) == [(1, 1, 0), (1, 2, 1)]
    assert partitioning.replicas(g, owners, 1).count() == 1


def _random(spark, n=60, m=300, seed=5):
    r = random.Random(seed)
    return graph(spark, range(n), [(r.randrange(n), r.randrange(n), float(r.randrange(9))) for _ in range(m)])


def test_bfs_is_sssp_with_unit_weights(spark):
    g = _random(spark)
    levels = values(algorithms.bfs(g, 0)[0], "id", "level")
    unit = Graph(g.vertices, g.edges.withColumn("weight", F.lit(1.0)))
    assert levels == values(algorithms.sssp(unit, 0)[0], "id", "distance")
    assert stats.differing(algorithms.sssp(g, 0)[0], algorithms.sssp(g, 0, True)[0], "distance").isEmpty()


def test_ranks_sum_to_vertices_without_sinks(spark):
    g = _random(spark, 20, 400)
    assert g.sinks().isEmpty()
    assert sum(values(algorithms.pagerank(g, 30), "id", "rank").values()) == pytest.approx(20)


def test_layouts_are_permutations_or_injective(spark):
    g = _random(spark)
    n, m = g.vertices.count(), g.edges.count()
    for make in (layouts.csr, layouts.meg):
        assert sorted(r.slot for r in make(g).collect()) == list(range(m))
    for make in (layouts.ell, lambda g: layouts.hybrid(g, 3)):
        slots = [r.slot for r in make(g).collect()]
        assert len(set(slots)) == len(slots) == m
    assert sorted(r.message_slot for r in layouts.message_slots(g).collect()) == list(range(m))
    relabelled = layouts.relabel_by_degree(g).out_degrees().orderBy("id").collect()
    assert [r.degree for r in relabelled] == sorted((r.degree for r in g.out_degrees().collect()), reverse=True) and len(relabelled) == n


def test_user_functions(spark, diamond):
    sent = emv.edge_map(diamond, diamond.out_degrees(), send=lambda e: e.src_degree * 10, active=lambda v: v.degree > 1)
    assert sorted(map(tuple, sent.collect())) == [(2, 20), (3, 20)]
    got = emv.combine(sent, "sum", diamond.vertices, -1)
    assert values(got, "id", "val") == {1: -1, 2: 20, 3: 20, 4: -1, 5: -1}
    anyone = emv.combine(sent.select("id", (F.col("val") > 5).alias("val")), "any")
    assert values(anyone, "id", "val") == {2: True, 3: True}


def test_numbered_adds_up_over_partitions(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(100)], "k int, v int")
    got = numbered(rows, ["k", "v"], "i", {"before": F.col("v")}).orderBy("i").collect()
    want = sorted((i % 7, i) for i in range(100))
    assert [(r.k, r.v) for r in got] == want and [r.i for r in got] == list(range(100))
    assert [r.before for r in got] == [sum(v for _, v in want[:i]) for i in range(100)]
    assert numbered(rows.limit(0), ["k"], "i").isEmpty()


def test_generators_stay_in_bounds(spark):
    g = generators.random_graph(spark, 50, 4).check()
    assert g.out_degrees().agg(F.min("degree"), F.max("degree")).first()[0:2] == (1, 4)
    b = generators.bipartite_graph(spark, 50, 80)
    side = values(b.vertices, "id", "side")
    assert b.edges.count() == 160 and all(side[r.src] != side[r.dst] for r in b.edges.collect())
    z = generators.zipf_graph(spark, 20, 25_000, 1.5).check()
    assert values(z.out_degrees(), "id", "degree") == values(generators.zipf_degrees(spark, 20, 25_000, 1.5), "id", "degree")


@pytest.mark.parametrize("op", ["sum", "min", "max", "product", "any"])
def test_scans_cross_partitions_and_batches(spark, op):
    """One hub with most messages, beside vertices with few; against a loop."""
    r = random.Random(3)
    rows = [(7 if r.random() < 0.7 else r.randrange(20), i, r.randrange(1, 3)) for i in range(3000)]
    messages = spark.createDataFrame(rows, "id long, slot long, val long").repartition(7)
    if op in ("product", "any"):
        messages = messages.withColumn("val", F.col("val").cast("double") / 1.5 if op == "product" else F.col("slot") % 97 == 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {(x.id, x.slot): x.val for x in emv.segmented_scan(messages, op, ["slot"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    join = {"sum": lambda a, b: a + b, "min": min, "max": max, "product": lambda a, b: a * b, "any": lambda a, b: a or b}[op]
    so_far = {}
    for x in messages.orderBy("slot").collect():
        so_far[x.id] = join(so_far[x.id], x.val) if x.id in so_far else x.val
        assert got[x.id, x.slot] == (pytest.approx(so_far[x.id]) if op == "product" else so_far[x.id])
    assert len(got) == len(rows) and emv.segmented_scan(messages.limit(0), op, ["slot"]).isEmpty()


def test_numbering_shuffles_once(spark):
    g = _random(spark)
    plan = layouts.csr(g)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the ranges are materialised; nothing moves after


def test_beyond_the_broadcast_bound_edges_stay(spark, monkeypatch):
    """With edges kept by source, only state, frontier and partial results are shuffled."""
    g, plans = _random(spark), []
    real = algorithms.superstep.cut
    monkeypatch.setattr(algorithms.superstep, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        algorithms.sssp(g, 0, config=RunConfig(broadcast_rows=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plans = [p.splitlines() for p in plans if "InMemoryTableScan" in p]
    assert len(plans) > 2
    for plan in plans:
        scan = next(i for i, x in enumerate(plan) if "InMemoryTableScan" in x)
        join = max(i for i, x in enumerate(plan[:scan]) if "Join" in x)
        assert not any("Exchange" in x for x in plan[join:scan])


def test_a_deep_search_ends(spark):
    n = 70
    g = graph(spark, range(n), [(i, i + 1, 1.0) for i in range(n - 1)])
    levels, steps = algorithms.bfs(g, 0)
    assert values(levels, "id", "level") == {i: i for i in range(n)} and steps == n


def test_edge_lists_of_every_vertex_as_stored(spark):
    g = graph(spark, [1, 2, 3], [(1, 3, 2.0), (1, 2, 7.0), (1, 3, 1.0)])
    ends = lambda out: F.transform(out, lambda e: e["dst"] * 10 + e["weight"].cast("long"))
    assert values(emv.edgelist_map(g, ends), "id", "val") == {1: [31, 27, 32], 2: [], 3: []}
    assert values(emv.edgelist_map(Graph(g.vertices, g.edges.drop("eid")), ends), "id", "val") == {1: [27, 31, 32], 2: [], 3: []}


def _ranks_by_loop(edges, n, steps):
    out = {i: [d for s, d in edges if s == i] for i in range(n)}
    rank = dict.fromkeys(range(n), 1.0)
    for _ in range(steps):
        got = dict.fromkeys(range(n), 0.0)
        for s, ends in out.items():
            for d in ends:
                got[d] += rank[s] / len(ends)
        rank = {i: 0.15 + 0.85 * v for i, v in got.items()}
    return rank


@pytest.mark.parametrize("bound", [0, 15, 1000])
def test_pagerank_against_a_loop(spark, bound):
    r = random.Random(8)
    edges = [(r.randrange(30), r.randrange(40)) for _ in range(90)]  # with sinks, loops, parallel edges and a vertex or two by itself
    g = graph(spark, range(40), [(*e, 1.0) for e in edges])
    for steps in (0, 1, 2, 3, 14):
        got = values(algorithms.pagerank(g, steps, config=RunConfig(broadcast_rows=bound, checkpoint_every=4)), "id", "rank")
        assert got == pytest.approx(_ranks_by_loop(edges, 40, steps), abs=1e-13)


@pytest.fixture
def rows_kept(monkeypatch):
    """The rows of whatever is materialised by a search or PageRank."""
    sizes, real = [], algorithms.cut

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(algorithms, "cut", counted)
    monkeypatch.setattr(algorithms.superstep, "cut", counted)
    return sizes


def test_pagerank_moves_changes_only(spark, rows_kept):
    """Along a path a change wanders from the first vertex to the last; there the supersteps end."""
    n = 8
    edges = [(i, i + 1) for i in range(n - 1)]
    got = values(algorithms.pagerank(graph(spark, range(n), [(*e, 1.0) for e in edges]), 100), "id", "rank")
    assert got == pytest.approx(_ranks_by_loop(edges, n, 100), abs=1e-13)
    assert sum(rows_kept) <= 5 * n


@pytest.mark.parametrize("dense", [False, True])
def test_searches_keep_what_is_reached(spark, rows_kept, dense):
    g = graph(spark, range(60), [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (40, 41, 1.0)])
    found, steps = algorithms.sssp(g, 1, dense, RunConfig(broadcast_rows=2))  # few senders are broadcast whatever the graph's size
    assert {k: v for k, v in values(found, "id", "distance").items() if v is not None} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert steps == 4 and sum(rows_kept) <= 60 + 4 * 5


def test_blocks_are_ranges_with_a_partition_each(spark):
    ids = spark.range(0, 4000, 4)
    placed = ids.withColumn("block", blocks(ids, 5)("id")).repartition(5, "block")
    got = placed.groupBy(F.spark_partition_id().alias("p"), "block").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("low").collect()
    assert len(got) == len({r.p for r in got}) == 5 and all(150 < r.n < 250 for r in got)
    assert all(a.high < b.low for a, b in zip(got, got[1:]))
    assert [r.b for r in spark.range(3).select(blocks(ids.limit(0), 3)("id").alias("b")).distinct().collect()] != []


def test_both_searches_of_the_selfcheck_share_edges_and_root(spark, sf_dir, monkeypatch):
    roots, real = [], queries._root
    monkeypatch.setattr(queries, "_root", lambda g: (roots.append(g.edges.is_cached), real(g))[1])
    assert queries.sssp_selfcheck(spark, sf_dir).first()[0] == 0
    assert roots == [True]
