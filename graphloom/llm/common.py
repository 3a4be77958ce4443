"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a folder of our own in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
        current = sc.getCheckpointDir()
    return named or current


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = files(spark, path)
    fs.delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, rows_a_part: int = 100_000) -> tuple[DataFrame, int]:
    """``df`` as of ``cut``, in no more partitions than its rows are worth, and the number of its rows."""
    df = cut(df)
    n = df.count()
    return df.coalesce(max(1, -(-n // rows_a_part))), n


def small(df: DataFrame, n: int, most: int = 1_000_000) -> DataFrame:
    """``df``, of n rows of a few numbers each, marked for broadcast if these are at most so many."""
    return F.broadcast(df) if n <= most else df


def one_thread() -> None:
    """In a Python worker: matrix products on the task's own core; more threads than cores would wait for each other, busily."""
    try:
        with open("/proc/self/maps") as f:
            libraries = set(re.findall(r"/\S*openblas\S*\.so\S*", f.read()))
    except OSError:
        return
    for path in libraries:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def slices(parts: Iterator[pa.RecordBatch], at_text: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """In a Python worker: the rows of the batches, in order, in pieces of about ``size`` bytes of text, so that what is made of
    a piece stays small whatever a batch holds. A longer text is in a piece with at most that much before it."""
    for b in parts:
        length = pc.fill_null(pc.binary_length(b.column(at_text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        starts = np.flatnonzero(np.diff((np.cumsum(length) - length) // size, prepend=-1)).tolist()
        for i, j in zip(starts, [*starts[1:], b.num_rows], strict=False):
            yield b.slice(i, j - i)


def fresh(df: DataFrame, *wanted: str) -> dict[str, str]:
    """Names for working columns that do not clash with those ``df`` has, whatever their case."""
    have = {c.lower() for c in df.columns}
    out = {}
    for w in wanted:
        name = f"__{w}"
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out[w] = name
    return out
