"""Graphs from a linear congruential generator, the same on every engine and for every partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.plans.config import cut, numbered

# Fixed values of the generator.
FACTOR, ADD, MODULUS = 1103515245, 12345, 2147483648


def lcg(x: Column) -> Column:
    """The next state after x, for x from 0 to 2**32."""
    return (x * F.lit(FACTOR) + F.lit(ADD)) % F.lit(MODULUS)


def draw(x: Column, below: Column | int) -> Column:
    """A number from 0 to ``below`` - 1, from the upper half of the state that follows the next of x."""
    return F.shiftright(lcg(lcg(x % F.lit(MODULUS))), 8) % (F.lit(below) if isinstance(below, int) else below)


def edge_weight(src: Column, dst: Column, below: int = 1000) -> Column:
    """A weight that depends on the edge's ends only."""
    return (src * F.lit(FACTOR) + dst * F.lit(ADD) + F.lit(528)) % F.lit(below)


def random_graph(spark: SparkSession, n: int, max_degree: int) -> Graph:
    """Vertices 0 to n - 1, each with 1 to ``max_degree`` out-edges to any of them."""
    vertices = spark.range(n)
    degree = F.lit(1) + draw(F.col("id"), max_degree)
    edges = vertices.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1).cast("bigint"), degree)).alias("k"))
    return Graph(vertices, edges.select("src", draw(F.col("src") * (max_degree + 1) + F.col("k"), n).alias("dst")))


def bipartite_graph(spark: SparkSession, n: int, m: int) -> Graph:
    """n vertices with a side 0 or 1 each, and m edges between the sides, in both directions."""
    vertices = spark.range(n).withColumn("side", draw(F.col("id"), 2).cast("int"))
    ends, counts = [], []
    for side in (0, 1):
        ranked = cut(numbered(vertices.where(F.col("side") == side), [F.asc("id")], "r").select("r", "id"))
        ends.append(ranked)
        counts.append(ranked.count())
    if not all(counts):
        return Graph(vertices, spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst")))
    pairs = spark.range(m).select(draw(F.col("id") * 2 + 1, counts[0]).alias("a"), draw(F.col("id") * 2 + 2, counts[1]).alias("b"))
    pairs = pairs.join(ends[0].select(F.col("r").alias("a"), F.col("id").alias("src")), "a").join(ends[1].select(F.col("r").alias("b"), F.col("id").alias("dst")), "b")
    return Graph(vertices, pairs.select("src", "dst")).undirected()


def zipf_degrees(spark: SparkSession, n: int, m: int, skew: float) -> DataFrame:
    """(id, degree): vertex i has the share 1 / (i + 1)**skew of m out-edges, rounded."""
    share = spark.range(n).select("id", F.pow(F.col("id") + 1, F.lit(-float(skew))).alias("p"))
    total = share.agg(F.sum("p")).first()[0] or 1.0
    return share.select("id", F.floor(F.lit(float(m)) * F.col("p") / F.lit(total) + 0.5).cast("bigint").alias("degree"))


def zipf_graph(spark: SparkSession, n: int, m: int, skew: float) -> Graph:
    """Out-degrees by ``zipf_degrees``, ends anywhere. A hub's edges are made in blocks, by many tasks."""
    block = 10_000
    degrees = zipf_degrees(spark, n, m, skew).where("degree > 0")
    blocks = degrees.select(F.col("id").alias("src"), "degree", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(degree - 1) div {block}"))).alias("b")).repartition("src", "b")
    k = F.explode(F.sequence(F.col("b") * block, F.least(F.col("degree"), (F.col("b") + 1) * block) - 1))
    edges = blocks.select("src", k.alias("k"))
    return Graph(spark.range(n), edges.select("src", draw(F.col("src") * 31 + F.col("k"), n).alias("dst")))
