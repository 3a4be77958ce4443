"""Operator 5: near-duplicates by DartMinHash.

Each text is the weighted set of its shingles (five words, lower-cased, split at white space; a shorter text is
one shingle); a shingle's weight is how often it occurs. Two texts' likeness is the weighted Jaccard similarity: the
sum of the lesser weights over that of the greater. Darts are thrown, by hashing, into the region of the
(weight, rank) plane that each element's weight opens: about
k ln k + 2k darts fall below the weights in all, however many elements a text has. Of each of the k
coordinates the earliest dart is kept. Bands of coordinates are joined, and every pair so found
that could change the classes is checked against the exact similarity. For that a shingle of weight w is w
elements, the hashes (64 bits) of the shingle and of each number below w: the Jaccard similarity of such sets is the weighted one.

Texts with equal sets are one node from the start. In each bucket of a band the first node is compared
with the others. Where nodes of different classes remain in a bucket, their candidates come from an exact
prefix filter: of sets ordered by rarity, two that are similar enough share one of the rarest fifth of
either, so many texts around one common passage meet in no bucket. There, ever more leaders are compared
until each pair of a bucket was compared or lies in one class. So no link is lost between texts that
share a bucket of a band, and neither a group of copies nor a common passage costs its square. With 24
bands of 4 rows a pair of similarity 0.8 shares no bucket in 3 of a million cases.

Defined cases: a text without a word (or null) is a class by itself; equal rows are copies of one
another; class_id is the smallest doc_id of the class (null ids come last); rows with one id and
different texts are different documents; extra columns are ignored by ``classes`` and kept by
``deduplicate``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import cut, fresh, settle, slices, small, table
from graphloom.llm.components import components
from graphloom.llm.words import Hasher, batches, mix, owners, spaced

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
#: Sets whose sizes differ by less than this factor are of one size class or of neighbouring ones.
SIZE_CLASS = 1.03
#: Up to so many nodes (16 bytes each) are sent to the executors as a filter; more are joined.
SENT_NODES = 4_000_000
#: Among so many tasks the nodes of one class are dealt when they get their class's first document.
SALTS = 32


class Shingles:
    """Texts -> (owner, hash, weight) of the distinct shingles, sorted by the first two."""

    def __init__(self, words: int = SHINGLE) -> None:
        self.hasher, self.words = Hasher(), words

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, number of texts, owners, hashes, weights), part by part."""
        for first, data, begins in batches([t.lower() for t in texts]):
            s, e = spaced(data)
            owner, word = owners(begins, s), self.hasher.spans(data, s, e)
            k, n = self.words, len(begins)
            h = word[: max(0, len(word) - k + 1)].copy()
            for i in range(1, k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + word[i : len(word) - k + 1 + i]
            whole = owner[: len(h)] == owner[k - 1 :][: len(h)] if len(h) else np.zeros(0, bool)
            own, h = owner[: len(h)][whole], h[whole]
            count = np.bincount(owner, minlength=n)
            few = np.flatnonzero((count > 0) & (count < k))
            if len(few):
                at = np.searchsorted(owner, few)
                short = [int(np.bitwise_xor.reduce(mix(word[a : a + count[d]] + np.arange(1, count[d] + 1, dtype=np.uint64)))) for a, d in zip(at, few, strict=True)]
                own, h = np.concatenate([own, few]), np.concatenate([h, np.array(short, np.uint64)])
            h = mix(h)
            order = np.lexsort((h, own))
            own, h = own[order], h[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
            at = np.flatnonzero(new)
            yield first, n, own[at], h[at], np.diff(np.append(at, len(own)))


def elements(owner: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A weighted set as a plain one, (owner, hash): as many elements of each shingle as it weighs. The first is the shingle's own hash."""
    if not len(h) or weight.max() == 1:
        return owner, h
    e = np.repeat(np.arange(len(h)), weight)
    number = (np.arange(len(e)) - np.repeat(np.cumsum(weight) - weight, weight)).astype(np.uint64)
    return owner[e], np.where(number > 0, mix(h[e] + number * np.uint64(0xC2B2AE3D27D4EB4F)), h[e])


class Darts:
    """DartMinHash signatures of weighted sets."""

    def __init__(self, k: int = BANDS * ROWS, seed: int = 1) -> None:
        self.k, self.seed = k, mix(np.array([seed], np.uint64))[0]
        self.darts = k * (math.log(k) + 2)
        # of a region of area 1: the chance of at most 0, 1, 2 ... darts
        self.cdf = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])

    def _throw(self, h: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(element, rank, dart) of the darts below the weights with low <= rank < high."""
        r0 = np.floor(low).astype(np.int64)
        ranks, weights = np.ceil(high).astype(np.int64) - r0, np.maximum(np.ceil(weight).astype(np.int64), 1)
        cells = ranks * weights
        e = np.repeat(np.arange(len(h)), cells)
        number = np.arange(len(e)) - np.repeat(np.cumsum(cells) - cells, cells)
        w, r = number // ranks[e], r0[e] + number % ranks[e]
        c = mix(h[e] ^ mix(w.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + r.astype(np.uint64) * np.uint64(0x165667B19E3779F9) + self.seed))
        darts = np.searchsorted(self.cdf, (c >> np.uint64(11)).astype(np.float64) / (1 << 53), "right")
        cell = np.repeat(np.arange(len(e)), darts)
        j = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(c[cell] + (j + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rank = r[cell] + (dart >> np.uint64(32)).astype(np.float64) / (1 << 32)
        e = e[cell]
        kept = (rank >= low[e]) & (rank < high[e])
        if (weights > 1).any() or (weight < 1).any():
            kept &= w[cell] + (mix(dart) >> np.uint64(32)).astype(np.float64) / (1 << 32) < weight[e]
        return e[kept], rank[kept], dart[kept]

    def __call__(self, n: int, owner: np.ndarray, h: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """n x k signatures; ``owner`` is sorted. A text without an element has zeros."""
        weight = np.ones(len(h)) if weight is None else weight
        out = np.zeros((n, self.k), np.uint64)
        at = np.searchsorted(owner, np.arange(0, n + 256, 256))  # bounds the darts in memory
        for i in range(0, n, 256):
            part = slice(at[i // 256], at[i // 256 + 1])
            self._some(out[i : i + 256], owner[part] - i, h[part], weight[part])
        return out

    def _some(self, out: np.ndarray, owner: np.ndarray, h: np.ndarray, weight: np.ndarray) -> None:
        n, k = out.shape
        total = np.bincount(owner, weight, n)
        first = np.full(n * k, np.inf)
        flat = out.reshape(-1)
        low, high = np.zeros(n), self.darts / np.maximum(total, 1e-300)
        todo = total > 0
        while todo.any():
            on = todo[owner]
            own = owner[on]
            e, rank, dart = self._throw(h[on], weight[on], low[own], high[own])
            place = own[e] * k + ((dart & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
            before = first.copy()
            np.minimum.at(first, place, rank)
            earliest = (rank == first[place]) & np.isinf(before[place])
            flat[place[earliest]] = dart[earliest]
            todo &= np.isinf(first).reshape(n, k).any(1)
            low, high = high, high * 2


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, k = signatures.shape
    s = signatures.reshape(n, bands, k // bands)
    h = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(k // bands):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, i])
    return h.astype(np.int64)


def _node(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each whole set: equal for equal sets, else different but for one pair in 2**64."""
    if not len(h):
        return np.zeros(n, np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(7)))])
    at = np.searchsorted(owner, np.arange(n + 1))
    return mix(sums[at[1:]] - sums[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64)).astype(np.int64)


def signatures(rows: DataFrame) -> DataFrame:
    """row, doc_id, text -> row, doc_id, node, n (the shingles' weight), bands."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, darts = Shingles(), Darts()
        for b in slices(parts, 2):
            texts = [t or "" for t in b.column(2).to_pylist()]
            nodes, sizes, bands = [], [], []
            for _, n, owner, h, weight in shingles(texts):
                nodes.append(_node(*elements(owner, h, weight), n))
                sizes.append(np.bincount(owner, weight, n).astype(np.int64))
                bands.append(band_keys(darts(n, owner, h, weight.astype(np.float64))))
            if nodes:
                keys = np.concatenate(bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), lists], names=["row", "doc_id", "node", "n", "bands"])

    return rows.select("row", "doc_id", "text").mapInArrow(read, "row long, doc_id long, node long, n long, bands array<long>")


def shingle_sets(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of the n ``wanted`` (row): sorted 64-bit hashes of the elements, as bytes."""
    spark = rows.sparkSession
    chosen = spark.sparkContext.broadcast(np.sort(wanted.toPandas()["row"].to_numpy(np.int64))) if n <= SENT_NODES else None

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()

        def pick(b: pa.RecordBatch) -> pa.RecordBatch:
            if chosen is None:
                return b
            row = b.column(0).to_numpy()
            at = np.minimum(np.searchsorted(chosen.value, row), max(0, len(chosen.value) - 1))
            return b.filter(pa.array(chosen.value[at] == row if len(chosen.value) else np.zeros(len(row), bool)))

        for b in slices(map(pick, parts), 1):
            texts = [t or "" for t in b.column(1).to_pylist()]
            nodes, sets = [], []
            for _, n, *weighted in shingles(texts):
                owner, h = elements(*weighted)
                nodes.append(_node(owner, h, n))
                ends = np.searchsorted(owner, np.arange(n + 1))
                sets += [np.unique(h[ends[i] : ends[i + 1]]).tobytes() for i in range(n)]
            if nodes:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(nodes)), pa.array(sets, pa.binary())], names=["row", "node", "shingles"])

    made = rows.select("row", "text").mapInArrow(read, "row long, node long, shingles binary")
    if chosen is None:
        made = made.join(wanted, "row", "left_semi")
    return settle(made.select("node", "shingles").dropDuplicates(["node"]), 10_000)[0]


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(bucket, node, size, partner): where sets meet of which enough of the rarest shingles may be shared.

    Two sets of n and m shingles are similar only if they share o = t / (1 + t) * (n + m). Then, in any
    order, one of the first n - o + 1 of the one is among the first m - o + 1 of the other. Shingles
    are ordered by rarity over ``sets``, and a bucket is a shingle and a pair of size classes, so
    that o is known well: texts that have only a common passage, or only a common original, don't meet.
    Of sets in different classes (``size`` and ``partner``) only those of unlike ``size`` are a pair.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(0, b.num_rows, 500):
                got = [np.frombuffer(x, np.int64) for x in b.column(1)[i : i + 500].to_pylist()]
                length = np.array([len(x) for x in got])
                node = np.repeat(b.column(0)[i : i + 500].to_numpy(), length)
                size = np.repeat(length, length)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(got)), pa.array(size)], names=["node", "bucket", "size"])

    each = sets.mapInArrow(read, "node long, bucket long, size long")
    often = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = each.join(often, "bucket")
    alone = F.col("size") - F.count(F.lit(1)).over(W.partitionBy("node"))
    place = alone + F.row_number().over(W.partitionBy("node").orderBy("df", "bucket"))
    size_class = lambda n: F.floor(F.log(n) / F.lit(math.log(SIZE_CLASS)) + 1e-9)
    n = F.col("size").cast("double")
    common = common.withColumn("place", place).where(F.col("place") <= n * (1 - threshold) + 1 + 1e-6)
    low, high = size_class(F.greatest(F.lit(1.0), F.ceil(n * threshold - 1e-9))), size_class(F.floor(n / threshold + 1e-9))
    # of larger partners more must be shared, so this place serves those up to a size
    largest = (n + 1 - F.col("place")) * ((1 + threshold) / threshold) - n
    high = F.least(high, size_class(F.greatest(F.lit(1.0), largest)) + 1)
    partners = F.when(high >= low, F.sequence(low, F.greatest(low, high)))
    spread = common.withColumns({"own": size_class(n), "partner": F.explode(partners)})
    least = F.ceil(F.pow(F.lit(SIZE_CLASS), F.col("partner").cast("double")) - 1e-6)  # the smallest partner of that class
    spread = spread.where(F.col("place") <= F.floor(n - threshold / (1 + threshold) * (n + least) + 1e-6) + 1)
    bucket = F.xxhash64("bucket", F.least("own", "partner"), F.greatest("own", "partner"))
    return spread.select(bucket.alias("bucket"), "node", F.col("own").alias("size"), "partner")


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose sets have at least this Jaccard similarity."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(parts, 2):
            left, right = (b.column(i).to_pylist() for i in (2, 3))
            keep = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(read, "u long, v long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """row (a hash of id and text), doc_id, class_id, class_size, keep: one row for each of ``docs``."""
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(signatures(rows))
    # nodes: distinct sets, each with its first document
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes = cut(signed.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), first, F.count(F.lit(1)).alias("copies")))
    member = nodes.select(F.explode("bands").alias("bucket"), "node", "n", "first")
    buckets = member.groupBy("bucket").agg(F.min(F.struct("first", "node", "n")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    member, _ = settle(member.join(buckets, "bucket").select("bucket", "node", "n", "first", F.col("lead.node").alias("leader"), F.col("lead.n").alias("leader_n")))
    close = lambda a, b: F.least(a, b) >= F.greatest(a, b) * (threshold - 1e-9)  # noqa: E731  sets of other sizes can't be so similar
    wanted, n = settle(member.groupBy("node").agg(F.first("first.row").alias("row")).select("row"))
    sets = shingle_sets(rows, wanted, n)
    pairs = member.where((F.col("node") != F.col("leader")) & close("n", "leader_n"))
    tested, _ = settle(pairs.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct(), 5_000)
    links, _ = settle(similar(tested, sets, threshold))
    root, many = components(links)

    def mixed(rows: DataFrame) -> DataFrame:
        """Buckets in which nodes of more than one class are left."""
        return rows.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket")

    def classed(rows: DataFrame) -> DataFrame:
        return rows.join(small(root, many), "node", "left").withColumn("root", F.coalesce("root", "node"))

    left = classed(member.select("bucket", "node", "leader"))
    open_nodes, n = settle(left.join(mixed(left.where("node <> leader")), "bucket", "left_semi").select("node").distinct())
    if n:
        of_open = nodes.select("node", "n", "first").join(small(open_nodes, n), "node", "left_semi")
        spots, _ = settle(prefixes(sets.join(small(open_nodes, n), "node", "left_semi"), threshold).join(of_open, "node"))
        ranked, done, leaders = None, 0, 1
        while True:
            left = classed(spots if ranked is None else ranked)
            left = left.join(mixed(left.where(F.col("rank") > done) if ranked is not None else left), "bucket", "left_semi")
            if ranked is None:
                left = left.withColumn("rank", F.row_number().over(W.partitionBy("bucket").orderBy("first", "node")))
            left, n = settle(left)
            if not n:
                break
            ranked, before, done, leaders = left.drop("root"), done, done + leaders, leaders * 8
            heads = left.where((F.col("rank") > before) & (F.col("rank") <= done)).select("bucket", F.col("node").alias("head"), F.col("n").alias("head_n"), F.col("root").alias("head_root"), F.col("rank").alias("head_rank"), F.col("size").alias("head_size"))
            met = left.where(F.col("rank") > before).join(heads, "bucket").where((F.col("rank") > F.col("head_rank")) & (F.col("root") != F.col("head_root")) & close("n", "head_n"))
            met = met.where((F.col("size") == F.col("partner")) | (F.col("size") != F.col("head_size")))
            new = met.select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
            new, n = settle(new, 5_000)
            if n:
                tested = tested.unionByName(new)
                more, n = settle(similar(new, sets, threshold))
                if n:
                    links = links.union(more)
                    root, many = components(links)
    of = nodes.select("node", "first", "copies").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = of.groupBy("root").agg(F.min("first").alias("class"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("nodes"))
    # a class of many nodes is dealt over SALTS tasks; one of a single node needs nothing of the others
    per = per.where("nodes > 1").drop("nodes").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of = of.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(per, ["root", "salt"], "left")
    of = of.select("node", F.coalesce("class", "first").alias("class"), F.coalesce("class_size", "copies").alias("class_size"))
    out = signed.join(of, "node", "left")
    alone = F.col("class").isNull()
    return out.select(
        "row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), (alone | (F.col("row") == F.col("class.row"))).alias("keep"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without all but the first document of each class."""
    n = fresh(docs, "row")
    found = cut(classes(docs, id_col, text_col, threshold))
    rows = docs.withColumn(n["row"], F.xxhash64(id_col, text_col))
    # rows that are equal in all share their hash: of those that stay, one is taken
    again = found.where("keep AND class_size > 1").groupBy("row").count().where("count > 1").select(F.col("row").alias(n["row"]))
    gone = found.where("NOT keep").select(F.col("row").alias(n["row"]))
    stay = rows.join(gone.union(again), n["row"], "left_anti")
    one = rows.join(again, n["row"], "left_semi").dropDuplicates([n["row"]])
    return stay.unionByName(one).select(*docs.columns)


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", "keep")
