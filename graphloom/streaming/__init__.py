"""Edges that keep arriving: running degrees, and graphs grown from files of arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_arc_stream(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) of the ``a src dst weight`` lines of files as they appear under ``path``."""
    f = spark.readStream.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.col("f")[0] == "a")
    return f.select(F.col("f")[1].cast("bigint").alias("src"), F.col("f")[2].cast("bigint").alias("dst"), F.col("f")[3].cast("double").alias("weight"))


def running_degrees(edges: DataFrame, end: str = "src") -> DataFrame:
    """(id, degree) so far; for the output modes update and complete."""
    return edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def grow(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the edges to the Parquet table under ``path``, each once, whatever is restarted."""
    return edges.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
