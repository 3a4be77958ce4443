"""Graphs made of the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.generators import edge_weight
from graphloom.operators.graph import Graph
from graphloom.plans.config import numbered

_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_chain(spark: SparkSession, sf_dir: str, with_eid: bool = False) -> Graph:
    """From each part of an order to the next line's part; weight: the next line's quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE)
    before = F.lag("l_partkey").over(W.partitionBy("l_orderkey").orderBy(*_LINE))
    edges = lines.withColumn("src", before).where("src IS NOT NULL").withColumn("dst", F.col("l_partkey"))
    vertices = lines.select(F.col("l_partkey").alias("id")).distinct()
    weight = F.col("l_quantity").cast("int").alias("weight")
    if not with_eid:
        return Graph(vertices, edges.select("src", "dst", weight))
    return Graph(vertices, numbered(edges, ["l_orderkey", *_LINE, "src"], "eid").select("eid", "src", "dst", weight))


def part_supp(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts (even ids) and suppliers (odd ids), an edge each way for every line; weight: its quantity."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), F.col("l_quantity").cast("int").alias("weight"))
    vertices = lines.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(vertices, lines).undirected()


def order_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """From each order of a customer to the next one; all orders are vertices, linked or not."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = orders.select(before.alias("src"), F.col("o_orderkey").alias("dst")).where("src IS NOT NULL")
    return Graph(orders.select(F.col("o_orderkey").alias("id")), edges.withColumn("weight", edge_weight(F.col("src"), F.col("dst"))))
