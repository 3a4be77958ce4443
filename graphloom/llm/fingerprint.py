"""Operator 4: document fingerprints by content-defined chunking.

A gear hash over the UTF-8 bytes (each value depends on the last 32 bytes) marks boundaries; as in
normalised chunking the mark is rare before the normal length and frequent after it. The fingerprint
is the set of the chunks' digests, each weighted by the bytes it covers. As boundaries depend on
content only, an insertion changes the chunks around it and no others. ``containment`` is the share
of a text's bytes whose chunks the other text has too.

Defined cases: a null text is empty; an empty text has the empty fingerprint; nothing is contained
in an empty text, but empty texts are contained in each other; a chunk that recurs adds its length
each time; equal texts have equal fingerprints; rows are taken by descending id (null last), ties by
the text's hash; a single row is its own successor; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

MIN, NORMAL, MAX = 16, 64, 256
#: Bits that must be zero before and after the normal length.
STRICT, LOOSE = 7, 5


def _gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def rolling(data: bytes) -> np.ndarray:
    """At each byte the sum of GEAR[byte k before] << k, modulo 2**32, by five doublings."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            more = h.copy()
            more[s:] += h[:-s] << np.uint32(s)
            h = more
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= MIN:
        return [n] if n else []
    h = rolling(data)
    loose = (np.flatnonzero(h < np.uint32(1 << (32 - LOOSE))) + 1).tolist()
    strict = (np.flatnonzero(h < np.uint32(1 << (32 - STRICT))) + 1).tolist()
    n_loose, n_strict, ends, start = len(loose), len(strict), [], 0
    while n - start > MIN:
        i = bisect_left(strict, start + MIN)
        end = strict[i] if i < n_strict else n
        if end > start + NORMAL:
            i = bisect_left(loose, start + NORMAL)
            end = min(loose[i] if i < n_loose else n, start + MAX)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunks(text: str) -> dict[int, int]:
    """Digest of each distinct chunk and the bytes that it covers."""
    data, start = text.encode("utf-8", "surrogatepass"), 0
    view, out, digest = memoryview(data), {}, xxhash.xxh3_64_intdigest
    for end in cuts(data):
        d = digest(view[start:end])
        out[d] = out.get(d, 0) + end - start
        start = end
    return out


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's bytes that lie in chunks of b, with as many repeats as b has."""
    if not a:
        return 0.0 if b else 1.0
    if not b:
        return 0.0
    return sum(min(w, b[d]) for d, w in a.items() if d in b) / sum(a.values())


def render(fp: dict[int, int]) -> str:
    return " ".join(f"{d:016x}:{fp[d]}" for d in sorted(fp))


def parse(fingerprint: str) -> dict[int, int]:
    return {int(d, 16): int(w) for d, w in (x.split(":") for x in fingerprint.split())}


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``fingerprint``: digest:bytes of each distinct chunk."""
    kept = [c for c in docs.columns if c.lower() != "fingerprint"]
    at = kept.index(text_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([render(chunks(x.as_py() or "")) for x in b.column(at)], pa.string())], names=[*kept, "fingerprint"])

    return docs.select(*kept).mapInArrow(read, docs.select(*kept).schema.add("fingerprint", "string"))


def _search(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` are below ``value``, by binary search."""
    steps = max(1, len(bounds).bit_length())
    padded = F.split(F.lit(",".join(map(str, bounds + [2**63 - 1] * (2**steps - len(bounds))))), ",").cast("array<bigint>")
    jumps = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.aggregate(jumps, F.lit(0), lambda lo, j: F.when(F.element_at(padded, lo + j) < value, lo + j).otherwise(lo))


def with_next(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text and in ``bucket``, ``tail`` where to read: sorted runs in which each row's successor follows it.

    Runs are ranges of ids. The first row of a run is also added, as its tail, to the run of the
    larger ids, and that of the first run to the last one. So the texts are shuffled once, and no
    window has to see all rows.
    """
    h = F.xxhash64("text")
    bounds = sorted({int(x) for x in docs.where(F.col("doc_id").isNotNull()).stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(F.col("doc_id").isNull(), -1).otherwise(_search(bounds, F.col("doc_id"))).alias("run"))
    firsts = {r.run: r.top for r in rows.groupBy("run").agg(F.max(F.struct("doc_id", "h")).alias("top")).collect()}  # a row a run
    runs = sorted(firsts)
    larger = {run: runs[(i + 1) % len(runs)] for i, run in enumerate(runs)}
    pick = lambda f: F.element_at(F.split(F.lit(",".join(str(f(r)) for r in range(-1, len(bounds) + 1))), ",").cast("array<bigint>"), F.col("run") + 2)
    top = F.col("h") == pick(lambda r: firsts[r].h if r in firsts else 0)
    top &= F.col("doc_id").eqNullSafe(F.when(F.col("run") >= 0, pick(lambda r: firsts[r].doc_id if r >= 0 and r in firsts else 0)))
    own = F.struct(F.col("run").cast("bigint").alias("bucket"), F.lit(0).alias("tail"))
    also = F.struct(pick(lambda r: larger.get(r, r)).alias("bucket"), F.lit(1).alias("tail"))
    out = rows.select("doc_id", "text", "h", F.explode(F.when(top, F.array(own, also)).otherwise(F.array(own))).alias("at"))
    return out.select("doc_id", "text", "h", "at.bucket", "at.tail")


def edited_pairs(docs: DataFrame, runs_per_task: int = 4) -> DataFrame:
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs.select("doc_id", "text"), n * runs_per_task)
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), F.desc("h"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str]]:
        run, last, done = None, None, True
        for b in batches:
            ids, texts, buckets, tails = (b.column(i) for i in range(4))
            for i in range(b.num_rows):
                doc, text, bucket, tail = ids[i].as_py(), texts[i].as_py() or "", buckets[i].as_py(), tails[i].as_py()
                if bucket != run:
                    run, last, done = bucket, None, False
                if last is not None and not done:
                    yield *last, text
                    done = bool(tail)
                last = (doc, text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out: list[list] = [[] for _ in names]
        size, ahead = 0, ("", {})
        for doc, text, after in pairs(batches):
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            # the successor's chunks are those that the next row needs as its own
            fp = ahead[1] if ahead[0] == text else chunks(text)
            ahead = (after, chunks(after))
            fp_edited = chunks(edited)
            row = (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), render(fp), render(fp_edited), containment(fp, fp_edited), containment(fp, ahead[1]))
            for column, value in zip(out, row, strict=True):
                column.append(value)
            size += len(text) + 200
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                out, size = [[] for _ in names], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("doc_id", "text", "bucket", "tail").mapInArrow(read, schema)


def op4_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
