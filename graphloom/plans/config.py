"""How iterative plans run, and how their lineage is cut."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class RunConfig:
    """``max_supersteps``: a bound on every loop (None: until nothing changes).

    ``checkpoint_every``: supersteps chained in one plan before it is materialised.
    ``broadcast_rows``: vertex state of at most so many rows (16 bytes each) is sent to all tasks, which
    leaves the edges where they are; beyond, edges and state are joined by a shuffle of the state.
    """

    max_supersteps: int | None = None
    checkpoint_every: int = 10
    broadcast_rows: int = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the folder that spark.checkpoint.dir names; our own only where that is unset, in local mode."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return df.checkpoint(eager=True)


@contextmanager
def blocks_kept(spark: SparkSession) -> Iterator[None]:
    """Lets a join by (block, id) take what is partitioned by ``block`` as it lies.

    The setting is the session's: a thread that shares the session should not plan meanwhile, and what is made inside should be
    materialised inside.
    """
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(vertices: DataFrame, n: int) -> Callable[[str], Column]:
    """The block of an id: n ranges of ids with about as many vertices each, labelled so that by their hash each has a partition of its own.

    Edges between ids that lie close together stay in a block, and what is sent along them is combined there.
    """
    ends = vertices.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    ends = sorted(set(ends or []))
    label = vertices.sparkSession.range(32 * n).select(F.col("id").cast("int").alias("label"))
    label = label.groupBy(F.pmod(F.hash("label"), F.lit(n)).alias("at")).agg(F.min("label").alias("label")).collect()  # a row a partition
    labels = [r.label for r in label] + list(range(32 * n, 33 * n - len(label)))

    def of(id: str, low: int = 0, high: int = len(ends)) -> Column:
        if low == high:
            return F.lit(labels[low])
        middle = (low + high) // 2
        return F.when(F.col(id) <= ends[middle], of(id, low, middle)).otherwise(of(id, middle + 1, high))

    return of


def _by_part(values: list, kind: str) -> Column:
    """values[_part], from a text that the optimizer folds into an array: a value a partition, empty for none."""
    at = F.get(F.split(F.lit(";".join("" if v is None else str(v) for v in values)), ";"), F.col("_part"))
    return F.when(at != "", at).cast(kind)


def _sorted_parts(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` in sorted ranges, with the number of each row's range and the row's place in it. Nothing is shuffled after that."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranges.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))


def _starts(parts: DataFrame, sums: list[str]) -> tuple[list[int], dict[str, list[int]]]:
    """Per range its first number, and the sums over all ranges before it. A row a range passes the driver."""
    totals = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).cast("bigint").alias(c) for c in sums]).orderBy("_part").collect()
    size = totals[-1]["_part"] + 1 if totals else 0
    begin, out = dict.fromkeys(["_n", *sums], 0), {k: [0] * size for k in ["_n", *sums]}
    for t in totals:
        for k in begin:
            out[k][t["_part"]] = begin[k]
            begin[k] += t[k] or 0
    return out.pop("_n"), out


def numbered(df: DataFrame, order: list[Column | str], index: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with the place of each row in ``order`` (from 0) and, for each of ``sums``, the sum over the rows before it.

    Rows are range-partitioned and sorted, and numbered where they then lie; one row a partition goes to the driver, which adds
    up where each partition begins. No task sees more than its range, and no row moves twice.
    """
    if not sums:
        rows = cut(_sorted_parts(df, order))
        first, _ = _starts(rows, [])
        return rows.withColumn(index, F.col("_row") + _by_part(first, "bigint")).drop("_part", "_row")
    found = scanned(df, order, [], {k: ("sum", c) for k, c in sums.items()}, index=index)
    return found.withColumns({k: (F.col(k) - F.coalesce(c, F.lit(0))).cast("bigint") for k, c in sums.items()})


#: What a running operation does with the value before and the next one.
JOINED: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: a + b,
    "count": lambda a, b: a + b,
    "product": lambda a, b: a * b,
    "min": F.least,
    "max": F.greatest,
    "any": lambda a, b: a | b,
}
_RUNNING = {"sum": "cumsum", "count": "cumsum", "product": "cumprod", "min": "cummin", "max": "cummax", "any": "cummax"}


def scanned(df: DataFrame, order: list[Column | str], group: list[str], runs: dict[str, tuple[str, Column]], index: str | None = None) -> DataFrame:
    """``df`` with inclusive running operations along ``order``, which begins with ``group``: per group, or over all rows.

    Also ``index``, each row's place in the whole order. Values must not be null (in sums null is 0). A group as long as may be is cut by the ranges
    like all else: every range is scanned by itself, in Arrow batches, and what its first group had before comes from one row a range.
    """
    values = {k: F.lit(1).cast("bigint") if op == "count" else F.coalesce(c, F.lit(0)) if op == "sum" else c for k, (op, c) in runs.items()}
    parts = _sorted_parts(df.withColumns({f"_v_{k}": v for k, v in values.items()}), order).withColumn("_group", F.struct(*group) if group else F.lit(0))
    kind = {k: parts.schema[f"_v_{k}"].dataType.simpleString() for k in runs}
    kind |= {k: "bigint" for k, (op, _) in runs.items() if op == "sum" and kind[k] in ("int", "smallint", "tinyint")}
    kept = [c for c in parts.columns if not c.startswith("_v_") and c not in ("_group", "_part", "_row")]
    wide = parts.select(*kept, "_part", "_row", "_group", *[F.col(f"_v_{k}").cast(kind[k]).alias(f"_v_{k}") for k in runs])
    ops = [_RUNNING[op] for op, _ in runs.values()]
    names, grouped, first_value, n_group = list(runs), bool(group), len(kept) + 3, len(group)  # plain values: the function below goes to the executors

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the group of the row before, and its running values
        carried: list = []
        head = True
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(first_value - 1)
            columns = [keys.field(i).to_numpy(zero_copy_only=False) for i in range(n_group)] if grouped else [np.zeros(b.num_rows, np.int64)]
            new = np.zeros(b.num_rows, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            goes_on = last is not None and last == tuple(c[0] for c in columns)
            segment = np.cumsum(new)
            out = []
            for i, op in enumerate(ops):
                v = b.column(first_value + i).to_pandas()
                if goes_on:  # the value before joins the first one
                    pair = pd.Series([carried[i], v.iloc[0]], dtype=v.dtype)
                    v = v.copy()
                    v.iloc[0] = getattr(pair, op)().iloc[1]
                out.append(getattr(v.groupby(segment), op)())
            in_head = (segment == 0) & (head and (goes_on or last is None))
            head = bool(in_head[-1])
            last, carried = tuple(c[-1] for c in columns), [v.iloc[-1] for v in out]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:first_value], *(pa.array(v, type=b.column(first_value + i).type, from_pandas=True) for i, v in enumerate(out)), pa.array(in_head)],
                names=[*b.schema.names[:first_value], *names, "_head"],
            )

    schema = T.StructType([*wide.schema.fields[:first_value], *(T.StructField(k, wide.schema[f"_v_{k}"].dataType) for k in runs), T.StructField("_head", T.BooleanType())])
    rows = cut(wide.mapInArrow(scan, schema))
    tails = rows.groupBy("_part").agg(F.min_by("_group", "_row").alias("low"), F.max_by("_group", "_row").alias("high"), F.count(F.lit(1)).alias("n"), *[F.max_by(k, "_row").alias(k) for k in runs])
    tails = tails.orderBy("_part").collect()  # a row a range
    size = tails[-1]["_part"] + 1 if tails else 0
    first, before, total = [0] * size, {k: [None] * size for k in runs}, 0
    held, so_far = None, {}
    for t in tails:
        first[t["_part"]], total = total, total + t["n"]
        goes_on = bool(so_far) and held == t["low"]
        if goes_on:
            for k in runs:
                before[k][t["_part"]] = so_far[k]
        whole = goes_on and t["low"] == t["high"]
        so_far = {k: _join(op, so_far[k], t[k]) if whole else t[k] for k, (op, _) in runs.items()}
        held = t["high"]
    out = {k: F.when(F.col("_head") & (have := _by_part(before[k], kind[k])).isNotNull(), JOINED[op](have, F.col(k))).otherwise(F.col(k)) for k, (op, _) in runs.items()}
    if index:
        out[index] = F.col("_row") + _by_part(first, "bigint")
    return rows.withColumns(out).drop("_part", "_row", "_group", "_head")


def _join(op: str, a, b):
    return {"min": min, "max": max, "any": lambda x, y: x or y, "product": lambda x, y: x * y}.get(op, lambda x, y: x + y)(a, b)
