"""Hashed text features, for operators 1 and 7, and bounded learning samples, for operators 1, 7 and 8."""

from __future__ import annotations

import copy
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices
from graphloom.llm.words import Hasher, Letters, batches, mix, owners, spaced

BITS = 18


class Features:
    """Texts -> sparse rows. Presence of words and of their first six bytes; the shares of token
    shapes, of tokens that repeat the one before, and of repeated runs of three tokens."""

    def __init__(self) -> None:
        self.hasher, self.letters = Hasher(), Letters()
        # shapes: upper, lower and digits are classes; all other bytes stand for themselves
        self.shape = np.arange(256, dtype=np.uint8)
        self.shape[65:91], self.shape[97:123], self.shape[48:58], self.shape[128:] = 1, 2, 3, 2
        self.twins, self.runs = (int(x) for x in mix(np.array([11, 12], np.uint64)) >> np.uint64(64 - BITS))

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rows, buckets, values, sorted by row and bucket; a text without a token has none."""
        parts = []
        for first, data, begins in batches(texts):
            row, at, value = self._part(data, begins, [t or "" for t in texts[first : first + len(begins)]])
            parts.append((row + first, at, value))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _keys(self, owner: np.ndarray, h: np.ndarray, kind: int) -> np.ndarray:
        return (owner.astype(np.int64) << BITS) | (mix(h + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)

    def _part(self, data: np.ndarray, begins: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lower = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        low = np.frombuffer(b"\n" + b"\n".join(lower), np.uint8)
        low_begins = np.cumsum([0, *(len(t) + 1 for t in lower[:-1])]) + 1
        # words and their beginnings
        s, e = self.letters.runs(low)
        owner = owners(low_begins, s)
        found = [self._keys(owner, self.hasher.spans(low, s, e), 1)]
        long = e - s > 6
        found.append(self._keys(owner[long], self.hasher.spans(low, s[long], s[long] + 6), 2))
        present = np.unique(np.concatenate(found))
        # tokens: shapes, without repeats of a class
        s, e = spaced(data)
        owner = owners(begins, s)
        n = np.bincount(owner, minlength=len(begins))
        kinds = self.shape[data]
        kept = np.concatenate([[True], kinds[1:] != kinds[:-1]])
        kept[s] = True
        number = np.concatenate([[0], np.cumsum(kept)])
        shapes, times = np.unique(self._keys(owner, self.hasher.spans(kinds[kept], number[s], number[e]), 3), return_counts=True)
        # repeats
        word = self.hasher.spans(data, s, e)
        twin = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        three = mix((word[:-2] * np.uint64(3) + word[1:-1]) * np.uint64(5) + word[2:])
        same = owner[2:] == owner[:-2]
        distinct = np.bincount(self._distinct(owner[2:][same], three[same]), minlength=len(begins))
        some = np.flatnonzero(n)
        per = np.maximum(n[some], 1)
        again = np.where(n[some] > 2, 1 - distinct[some] / np.maximum(n[some] - 2, 1), 0)
        repeats = np.bincount(owner[1:][twin], minlength=len(begins))[some]
        key = np.concatenate([present, shapes, (some << BITS) | self.twins, (some << BITS) | self.runs])
        value = np.concatenate([np.ones(len(present)), 3 * times / n[shapes >> BITS], 3 * repeats / per, 3 * again]).astype(np.float32)
        order = np.argsort(key, kind="stable")
        return key[order] >> BITS, key[order] & ((1 << BITS) - 1), value[order]

    @staticmethod
    def _distinct(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The owner of every distinct (owner, h)."""
        order = np.lexsort((h, owner))
        o, x = owner[order], h[order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
        return o[new]


def bounded_sample(rows: DataFrame, class_col: str, key: Sequence[str], per_class: int) -> tuple[DataFrame, dict]:
    """At most ``per_class`` rows of each non-null class, by smallest hash of the ``key``, and the classes' full counts.

    Rows with one class and key are one row, so they should agree in all else that is used. A class never loses a row while
    it has no more than the bound: the hash below which rows are looked at is raised until it has enough, or all. No more
    than about ten times the bound of hashes a class is ever gathered. Added is ``sample_hash``.
    """
    rows = rows.where(F.col(class_col).isNotNull()).withColumn("sample_hash", F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *key), 1))
    counts = {r[0]: r[1] for r in rows.groupBy(class_col).count().collect()}  # a row a class
    top = (1 << 63) - 1
    bound = {k: min(1.0, 2 * per_class / n) for k, n in counts.items()}
    below: dict = {}

    def under(limits: dict) -> Column:
        return F.col("sample_hash") <= F.element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]), F.col(class_col))

    while todo := [k for k in counts if k not in below]:
        some = rows.where(F.col(class_col).isin(todo)).select(class_col, "sample_hash").where(under({k: min(top, int(bound[k] * top)) for k in todo})).distinct()
        found = some.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"), F.get(F.sort_array(F.collect_list("sample_hash")), F.lit(per_class - 1)).alias("last"))
        for k, _, last in found.collect():  # a row a class
            if last is not None:
                below[k] = last
        for k in todo:
            if k not in below and bound[k] == 1.0:
                below[k] = top
            bound[k] = min(1.0, 8 * bound[k])
    if not counts:
        return rows.limit(0), {}
    return rows.where(under(below)).dropDuplicates([class_col, "sample_hash"]), counts


def collect_features(rows: DataFrame, class_col: str, text_col: str) -> tuple[list, list[np.ndarray], list[np.ndarray]]:
    """Classes, buckets and values of a bounded sample, in an order that does not depend on the partitions."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in slices(parts, 1):
            row, at, value = features(b.column(1).to_pylist())
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            at, value = at.astype(np.int32), value.astype(np.float32)
            cut = lambda x: pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), cut(at), cut(value)], names=["k", "at", "value"])

    chosen = rows.select(F.col(class_col).alias("k"), F.col(text_col).alias("t"))
    got = chosen.mapInArrow(read, chosen.select("k").schema.add("at", "binary").add("value", "binary")).collect()
    got = sorted((r for r in got if r.at), key=lambda r: (r.k, bytes(r.at), bytes(r.value)))
    return [r.k for r in got], [np.frombuffer(r.at, np.int32) for r in got], [np.frombuffer(r.value, np.float32) for r in got]


class Design:
    """A sparse matrix of the features that at least ``least`` rows have."""

    def __init__(self, at: list[np.ndarray], value: list[np.ndarray], least: int) -> None:
        lengths = np.array([len(a) for a in at])
        flat, row = np.concatenate(at), np.repeat(np.arange(len(at)), lengths)
        often = np.bincount(flat, minlength=1 << BITS) >= least
        self.names = np.flatnonzero(often)
        keep = often[flat]
        number = np.cumsum(often) - 1
        self.col, self.row, self.val = number[flat[keep]], row[keep], np.concatenate(value)[keep].astype(np.float64)
        self.n, self.m = len(at), len(self.names)

    def only(self, chosen: np.ndarray) -> Design:
        """The same rows with the chosen features."""
        out, keep, number = copy.copy(self), chosen[self.col], np.cumsum(chosen) - 1
        out.col, out.row, out.val = number[self.col[keep]], self.row[keep], self.val[keep]
        out.names = self.names[chosen]
        out.m = len(out.names)
        return out

    def dot(self, w: np.ndarray, size: bool = False) -> np.ndarray:
        return np.bincount(self.row, (np.abs(self.val) if size else self.val) * w[self.col], self.n)

    def back(self, g: np.ndarray, size: bool = False) -> np.ndarray:
        return np.bincount(self.col, (np.abs(self.val) if size else self.val) * g[self.row], self.m)
