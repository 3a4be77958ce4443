"""Operator 2: benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of 32 words. Passages of the corpus and of the benchmark, as TF-IDF
vectors over hashed words, form one matrix A, whose right singular vectors are found by a distributed
randomised SVD: every task adds up its share of A'(A Omega), for one Omega of rank and oversampling
columns, and the driver decomposes the sum, of a fixed size. The benchmark's rows weigh as much as all the
corpus's, so that its own directions are in the latent space beside the corpus's main ones. Every window of two passages is compared by cosine with every benchmark
item, and with every such window of an item that is longer; a hit on any makes the item a candidate. Candidates are checked by the longest common subsequence of words, of the whole item and of
its answer (its last sentence), so edited and reordered-in-part copies are found too.

Counts, SVD and search go over all texts, whole; the benchmark is read in passes of about
``ITEMS`` windows of items, the only thing whose size decides what is broadcast.

Defined cases: null texts and texts without a letter (a character of category L) match nothing, nor do such
items; equal rows of the benchmark are one item; repeated documents are each found; rows of ``find`` are one for each document
row and item; extra columns are ignored by ``find`` and kept by ``decontaminate``; with an empty
benchmark nothing is found; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import one_thread, table
from graphloom.llm.words import Hasher, Letters, batches

BUCKETS, PASSAGE = 1 << 13, 32
#: Rank of the latent space, and random probes.
RANK, PROBES = 208, 224
#: Passages multiplied at once, and buckets in one part of a sum of sketches.
BLOCK, PART = 32, 64
#: Passages held until their products are added to a sketch, and passages of one bucket added at once.
HELD, ADDED = 1 << 14, 256
#: Least cosine with an item's window of two passages, and least share of the latent length of an item's window along it, of a
#: candidate. With a shorter item it is less by the root of the item's share of a window: the window has other words beside it,
#: and a large benchmark's latent space holds those as well.
COSINE, COVERAGE = 0.5, 0.35
#: Least share of the item's words in common order: with its answer, and if the answer is cut off.
LCS, ANSWER, LCS_ALONE = 0.6, 0.5, 0.8
#: Least number of an item's words in common order; all of an item with fewer.
LEAST = 4
#: Windows of benchmark items read in one pass; an item of up to two passages is one.
ITEMS = 50_000


class Passages:
    """Texts -> words with their passages."""

    def __init__(self) -> None:
        self.hasher, self.letters = Hasher(), Letters()

    def words(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, hash of every word, its text's number in the part, its place in the text)."""
        for first, data, begins in batches([(t or "").lower() for t in texts], 1 << 17):
            s, e = self.letters.runs(data)
            start = np.searchsorted(s, begins)
            times = np.diff(start, append=len(s))
            yield first, self.hasher.spans(data, s, e), np.repeat(np.arange(len(start)), times), np.arange(len(s)) - np.repeat(start, times)

    @staticmethod
    def tf(word: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted (passage, bucket) with root of the count; and the first word of every passage."""
        new = place % PASSAGE == 0
        passage = np.cumsum(new) - 1
        key, times = np.unique(passage * BUCKETS + (word >> np.uint64(64 - 13)).astype(np.int64), return_counts=True)
        return key // BUCKETS, key % BUCKETS, np.sqrt(times), np.flatnonzero(new)


def project(matrix: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The sparse n x BUCKETS matrix, of at most PASSAGE values a row, times ``matrix``; only rows of ``matrix`` that count are read."""
    ends = np.searchsorted(row, np.arange(n + 1))
    width, place = int(np.diff(ends).max(initial=1)), np.arange(len(row)) - ends[row]
    out, rows = np.empty((n, 1, matrix.shape[1]), np.float32), np.empty((BLOCK, width, matrix.shape[1]), np.float32)
    for first in range(0, n, HELD):
        size, part = min(HELD, n - first), slice(ends[first], ends[min(first + HELD, n)])
        number, times = np.zeros((size, width), np.int64), np.zeros((size, 1, width), np.float32)
        number[row[part] - first, place[part]], times[row[part] - first, 0, place[part]] = at[part], value[part]
        for i in range(0, size, BLOCK):
            some = rows[: size - i]
            np.take(matrix, number[i : i + BLOCK], 0, some, "clip")
            np.matmul(times[i : i + BLOCK], some, out[first + i : first + i + BLOCK])
    return out[:, 0]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of every bucket the passages that have it, and the number of passages; over all of ``texts`` (text)."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, df, n = Passages(), np.zeros(BUCKETS, np.int64), 0
        for b in parts:
            for _, word, owner, place in passages.words(b.column(0).to_pylist()):
                _, at, _, first = passages.tf(word, owner, place)
                df += np.bincount(at, minlength=BUCKETS)
                n += len(first)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["bucket", "n"])

    rows = texts.mapInArrow(read, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        out[r.bucket] += r.n
    return out[:-1], int(out[-1])


def sketch(texts: DataFrame, idf: np.ndarray, probes: int = PROBES, seed: int = 3) -> np.ndarray:
    """A'(A Omega) over the passages of ``texts``, rows of A at length 1; Omega is drawn alike in every task.

    A task's share is cut into parts of PART buckets, which are dealt to the reducers and added up there as they stream by.
    """
    held = texts.sparkSession.sparkContext.broadcast(idf)  # a number a bucket

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        passages, share = Passages(), Share(held.value, _omega(probes, seed))
        for b in parts:
            for _, word, owner, place in passages.words(b.column(0).to_pylist()):
                share.add(*passages.tf(word, owner, place))
        total = share.sum()
        if total.any():
            some = [k for k in range(BUCKETS // PART) if total[k * PART : (k + 1) * PART].any()]
            sums = [total[k * PART : (k + 1) * PART].tobytes() for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums, pa.binary())], names=["part", "y"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in parts:
            for k, y in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums.setdefault(k, np.zeros(PART * probes))
                sums[k] += np.frombuffer(y.as_buffer(), np.float32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "y"])

    shares = texts.mapInArrow(read, "part long, y binary")
    out = np.zeros((BUCKETS, probes), np.float64)
    for r in shares.repartition("part").mapInArrow(add, "part long, y binary").collect():  # BUCKETS rows of fixed width in all
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.y, np.float64).reshape(PART, probes)
    return out


def _omega(probes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, probes), dtype=np.float32)


class Share:
    """The sum of A'(A Omega) over the passages that are added, rows of A at length 1.

    Passages are held until they are many, so that a bucket's row of the sum is written once for all of its passages.
    """

    def __init__(self, idf: np.ndarray, omega: np.ndarray) -> None:
        self.idf, self.omega, self.total = idf, omega, np.zeros((BUCKETS, omega.shape[1]), np.float32)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, first: np.ndarray) -> None:
        value = (value * self.idf[at]).astype(np.float32)
        length = np.sqrt(np.bincount(row, value.astype(np.float64) ** 2, len(first)))
        self.parts.append((row + self.n, at, value / np.maximum(length, 1e-12)[row].astype(np.float32)))
        self.n += len(first)
        if self.n >= HELD:
            self._settle()

    def sum(self) -> np.ndarray:
        if self.n:
            self._settle()
        return self.total

    def _settle(self) -> None:
        row, at, value = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        for i in range(0, self.n, 2 * HELD):  # more than one turn only for a very long text
            part = slice(*np.searchsorted(row, [i, i + 2 * HELD]))
            self._put(row[part] - i, at[part], value[part], min(2 * HELD, self.n - i))
        self.parts, self.n = [], 0

    def _put(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> None:
        z = project(self.omega, row, at, value, n)
        order = np.argsort(at.astype(np.int16), kind="stable")
        row, value, ends = row[order], value[order], np.cumsum(np.bincount(at, minlength=BUCKETS)).tolist()
        some = np.empty((ADDED, z.shape[1]), np.float32)
        for k, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
            for i in range(start, end, ADDED):
                j = min(i + ADDED, end)
                self.total[k] += value[i:j] @ z.take(row[i:j], 0, some[: j - i], "clip")


def lcs(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence; ``masks`` has the places of each word, bit by bit."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def answer_of(text: str) -> str:
    """The last line or sentence that has a letter."""
    part = text
    for i in range(len(text) - 1, -1, -1):
        if text[i] in ".!?\n" and any(c.isalpha() for c in text[i + 1 :]):
            return text[i + 1 :]
    return part


@dataclass
class Index:
    """The latent space and the benchmark in it."""

    idf: np.ndarray  # BUCKETS
    space: np.ndarray  # BUCKETS x rank, idf included
    items: list[int]
    latent: np.ndarray  # windows of items x rank, at length 1
    length: np.ndarray
    owner: np.ndarray  # the place in ``items`` of each window's item
    least: np.ndarray  # the least cosine with each window
    words: list[list[int]]
    answers: list[list[int]]

    def parts(self) -> tuple:
        return self.idf, self.space, self.items, self.latent, self.length, self.owner, self.least, self.words, self.answers


def build(texts: DataFrame, items: list[tuple[int, str]], df: np.ndarray, n: int, corpus: np.ndarray, seed: int = 3) -> Index | None:
    """``items`` are those of one pass; ``corpus`` is the sketch of all texts."""
    passages = Passages()
    found = {i: word for i, word in _all_words(passages, [t for _, t in items])}
    kept = [i for i in range(len(items)) if len(found.get(i, ()))]
    if not kept:
        return None
    idf = np.log((n + 1.0) / (df + 1.0)).astype(np.float32) + np.float32(1e-3)
    share, rows = Share(idf, _omega(corpus.shape[1], seed)), 0
    for _, word, owner, place in passages.words([items[i][1] for i in kept]):
        got = passages.tf(word, owner, place)
        rows += len(got[3])
        share.add(*got)
    y = corpus + share.sum().astype(np.float64) * max(n, 1) / max(rows, 1)  # of one matrix: the corpus's rows and the weighted ones of the benchmark
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    rank = min(RANK, int((s > 1e-9 * s[0]).sum()))
    space = np.ascontiguousarray(u[:, :rank] * idf[:, None], np.float32)
    windows = [(k, part) for k, i in enumerate(kept) for part in item_windows(found[i])]
    latent, owner = np.stack([_latent(space, part) for _, part in windows]), np.array([k for k, _ in windows])
    length = np.sqrt((latent**2).sum(1))
    good = length > 1e-9
    least = COSINE * np.sqrt(np.array([len(part) for _, part in windows]) / (2 * PASSAGE))
    latent, length, owner, least = latent[good], length[good], owner[good], least[good].astype(np.float32)
    answers = {i: word for i, word in _all_words(passages, [answer_of(items[k][1]) for k in kept])}
    return Index(idf, space, [items[k][0] for k in kept], latent / length[:, None], length, owner, least, [found[k].tolist() for k in kept], [answers.get(i, np.zeros(0)).tolist() for i in range(len(kept))])


def _all_words(passages: Passages, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    for first, word, owner, _ in passages.words(texts):
        ends = np.searchsorted(owner, np.arange(owner.max(initial=-1) + 2))
        for i in range(len(ends) - 1):
            yield first + i, word[ends[i] : ends[i + 1]]


def item_windows(word: np.ndarray) -> list[np.ndarray]:
    """An item's windows of two passages, one passage apart; the whole item, if it is no longer than that."""
    return [word[i : i + 2 * PASSAGE] for i in range(0, max(len(word) - PASSAGE, 1), PASSAGE)]


def _latent(space: np.ndarray, word: np.ndarray) -> np.ndarray:
    at, times = np.unique((word >> np.uint64(64 - 13)).astype(np.int64), return_counts=True)
    return np.sqrt(times).astype(np.float32) @ space[at]


class Search:
    """Texts -> matches of benchmark items."""

    def __init__(self, index: Index) -> None:
        self.index, self.passages = index, Passages()
        self.size = np.array([len(w) for w in index.words])
        self.known, ids = np.unique(np.concatenate([np.array(w, np.uint64) for w in index.words]), return_inverse=True)
        self.ids, self.here = np.split(ids, np.cumsum(self.size)[:-1]), np.zeros(len(self.known) + 1, bool)
        self.masks = lru_cache(4096)(self._masks)
        # where the known words of every first bits begin, and the most of them with the same
        self.shift = np.uint64(64 - max(16, len(self.known).bit_length() + 2))
        self.begin = np.searchsorted(self.known >> self.shift, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64))
        self.most = int(np.diff(self.begin, append=len(self.known)).max())

    def _masks(self, item: int) -> tuple[dict[int, int], dict[int, int]]:
        return places(self.index.words[item]), places(self.index.answers[item])

    def numbers(self, word: np.ndarray) -> np.ndarray:
        """The number of each word among those of items, or one beyond."""
        n = len(self.known)
        at = self.begin[word >> self.shift]
        out = np.where(self.known[np.minimum(at, n - 1)] == word, at, n)
        for k in range(1, self.most):
            left = np.flatnonzero(out == n)
            next_at = np.minimum(at[left] + k, n - 1)
            same = self.known[next_at] == word[left]
            out[left[same]] = next_at[same]
        return out

    def _possible(self, part: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Whether so many words of each item are in ``part``, in any order, that the common subsequence can be long enough."""
        self.here[part] = True
        self.here[-1] = False
        ends = np.cumsum(self.size[items])
        shared = np.add.reduceat(self.here[np.concatenate([self.ids[i] for i in items])], np.append(0, ends[:-1]), dtype=np.int64)
        self.here[part] = False
        return shared >= LCS * self.size[items]

    def compared(self, item: int, word: np.ndarray, known: np.ndarray) -> tuple[float, float]:
        """The share of the item that its longest common subsequence with the words has, and of its answer; 0 if the share is below LCS.

        An item shorter than a passage is sought in stretches of twice its length, so that its words don't match
        by chance here and there, and at least LEAST of them must be in common. A stretch with fewer than LCS of the item's words,
        in any order, has no longer subsequence.
        """
        masks, answer = self.masks(item)
        size, answer_size, best = int(self.size[item]), len(self.index.answers[item]), (0.0, 0.0)
        reach, step = (2 * size, max(1, size // 2)) if size < PASSAGE else (len(word), len(word) + 1)
        self.here[self.ids[item]] = True
        shared = np.append(0, np.cumsum(self.here[known]))
        self.here[self.ids[item]] = False
        begins = np.arange(0, max(len(word) - size, 1), step)
        enough = (shared[np.minimum(begins + reach, len(word))] - shared[begins]) / size >= LCS
        for i in begins[enough].tolist():
            part = word[i : i + reach].tolist()
            common = lcs(masks, size, part)
            if common >= min(LEAST, size) and common / size >= best[0]:
                best = max(best, (common / size, lcs(answer, answer_size, part) / answer_size if answer_size else 1.0))
        return best

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(text, number of the item, cosine, share of the item, share of its answer, first word), by text and item."""
        x = self.index
        for first, word, owner, place in self.passages.words(texts):
            if not len(word):
                continue
            row, at, value, start = self.passages.tf(word, owner, place)
            z = project(x.space, row, at, value, len(start))
            own = owner[start]
            z[:-1][own[:-1] == own[1:]] += z[1:][own[:-1] == own[1:]]  # a window: a passage and the next of its text
            length = np.sqrt((z**2).sum(1)) + 1e-9
            ends = np.searchsorted(owner, np.arange(owner[-1] + 2))
            known = self.numbers(word)

            def around(w: int, last: int, size: int, ends=ends, own=own, start=start) -> slice:
                # a passage more on either side, and as many words again as a long item has
                text = own[w]
                return slice(max(int(ends[text]), int(start[w]) - PASSAGE - size), min(int(ends[text + 1]), int(start[last]) + 3 * PASSAGE + size))

            hits: dict[tuple[int, int], list[tuple[int, float]]] = {}
            for block in range(0, len(x.owner), 1024):
                dot = z @ x.latent[block : block + 1024].T
                windows, pieces = np.divmod(np.flatnonzero(dot >= COVERAGE * x.length[block : block + 1024]), dot.shape[1])
                near = dot[windows, pieces] >= x.least[pieces + block] * length[windows]
                windows, pieces = windows[near], pieces[near]
                cosine, items = dot[windows, pieces] / length[windows], x.owner[pieces + block]
                kept = self.size[items] > 2 * PASSAGE  # these are looked at below, with their neighbours
                for some in np.split(np.arange(len(windows)), np.flatnonzero(np.diff(windows)) + 1):
                    some = some[~kept[some]]
                    if len(some):
                        kept[some] = self._possible(known[around(windows[some[0]], windows[some[0]], 2 * PASSAGE)], items[some])
                for w, k, c in zip(windows[kept].tolist(), items[kept].tolist(), cosine[kept].tolist(), strict=True):
                    hits.setdefault((int(own[w]), k), []).append((w, c))
            for (text, item), found in sorted(hits.items()):
                found.sort()
                size, best = int(self.size[item]), (0.0, 0.0, 0.0, 0)
                reach = size // 2 if size > 2 * PASSAGE else 0  # windows of a long item's copy are checked together
                while found:
                    w = found[0][0]
                    n = sum(start[v] <= start[w] + reach for v, _ in found)
                    group, found = found[:n], found[n:]
                    part = around(w, group[-1][0], size)
                    if reach and not self._possible(known[part], np.array([item]))[0]:
                        continue
                    share, told = self.compared(item, word[part], known[part])
                    if share >= LCS_ALONE or share >= LCS and told >= ANSWER:
                        best = max(best, *((share, c, told, -int(place[start[v]])) for v, c in group))
                if best[0]:
                    share, cosine, told, at_word = best
                    yield first + text, item, cosine, share, told, -at_word


def indexes(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> Iterator[Index]:
    texts = docs.select(F.col(text_col).alias("text"))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    n_words = F.size(F.split(F.lower("text"), r"[\x00-\x60\x7b-\x7f]+"))
    total = asked.agg(F.sum(F.greatest(F.lit(1), F.ceil(n_words / PASSAGE) - 1))).first()[0] or 0
    passes = -(-total // ITEMS)
    if not passes:
        return
    df, n = document_frequencies(texts)
    idf = np.log((n + 1.0) / (df + 1.0)).astype(np.float32) + np.float32(1e-3)
    corpus = sketch(texts, idf)
    for p in range(passes):
        items = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()  # about ITEMS windows
        index = build(texts, sorted((r.item_id if r.item_id is not None else -1, r.text) for r in items), df, n, corpus)
        if index:
            yield index


FOUND = "item_id long, cosine double, lcs double, answer double, word long"


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, word: a row for each document and benchmark item that it holds."""
    rows, out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), None
    for index in indexes(docs, benchmark, text_col):
        held = docs.sparkSession.sparkContext.broadcast(index.parts())

        def read(parts: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            one_thread()
            search = Search(Index(*held.value))
            for b in parts:
                got = list(search(b.column(1).to_pylist()))
                columns = list(zip(*got, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(columns[0], pa.int64())), pa.array([search.index.items[i] for i in columns[1]], pa.int64()),
                     *(pa.array(c, pa.float64()) for c in columns[2:5]), pa.array(columns[5], pa.int64())],
                    names=["doc_id", "item_id", "cosine", "lcs", "answer", "word"],
                )

        found = rows.mapInArrow(read, f"doc_id long, {FOUND}")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.select("doc_id").limit(0).selectExpr("doc_id", *(f"CAST(NULL AS {t}) AS {c}" for c, t in (x.split() for x in FOUND.split(", "))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    at_text, out = docs.columns.index(text_col), docs
    for index in indexes(docs, benchmark, text_col):
        held = docs.sparkSession.sparkContext.broadcast(index.parts())

        def read(parts: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            one_thread()
            search = Search(Index(*held.value))
            for b in parts:
                clean = np.ones(b.num_rows, bool)
                clean[[i for i, *_ in search(b.column(at_text).to_pylist())]] = False
                yield b.filter(pa.array(clean))

        out = out.mapInArrow(read, docs.schema)
    return out


def op2_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
