import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate as decontaminate_
from graphloom.llm.decontaminate import Passages, answer_of, decontaminate, find, lcs, op2_latent_leaks, places


def _plain(t):
    return " ".join(re.findall(r"[^\W\d_]+", (t or "").lower()))


def test_query_finds_every_copy_and_nothing_else(spark, sf_dir):
    docs = [(r.doc_id, _plain(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, _plain(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, q in items if q in t}
    assert {(r.doc_id, r.item_id) for r in op2_latent_leaks(spark, sf_dir).collect()} == want


def _word(r):
    return "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 5)))


def _setting(seed=0):
    r = random.Random(seed)
    common = [_word(r) for _ in range(30)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.5 else _word(r) for _ in range(n))
    items = [(i, text(30) + ". " + text(6) + ".") for i in range(12)]
    docs = [(i, text(r.randrange(5, 400))) for i in range(80)]
    return r, text, items, docs


def _frames(spark, docs_of, docs, items):
    return docs_of(docs), spark.createDataFrame(items, "item_id long, text string")


def test_paraphrases(spark, docs_of):
    r, text, items, docs = _setting()
    planted = set()
    for i, q in items:
        w = q.split()
        for k in r.sample(range(len(w) - 7), 5):  # a few words replaced, and one dropped
            w[k] = _word(r)
        del w[3]
        docs.append((1000 + i, f"{text(70)} {' '.join(w).upper()} {text(50)}"))
        planted.add((1000 + i, i))
    d, b = _frames(spark, docs_of, docs, items)
    got = find(d, b).collect()
    assert {(x.doc_id, x.item_id) for x in got} == planted and all(0.6 <= x.lcs < 1 for x in got)
    assert {x.doc_id for x in decontaminate(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in planted}


def test_long_items(spark, docs_of):
    """Items of 100 to 1000 words, as they are and with every sixth word replaced, in longer texts."""
    r, text, items, docs = _setting(3)
    long = [(100 + i, text(n) + ". " + text(8) + ".") for i, n in enumerate([60, 100, 150, 200, 250, 400, 600, 1000] * 2)]
    planted = set()
    for i, q in long:
        edited = " ".join(_word(r) if k % 6 == 2 else w for k, w in enumerate(q.split()))
        docs += [(1000 + i, f"{text(r.randrange(90, 110))} {q} {text(100)}"), (2000 + i, f"{text(r.randrange(90, 110))} {edited} {text(100)}")]
        planted |= {(1000 + i, i), (2000 + i, i)}
    docs += [(3000 + i, text(40) + " " + " ".join(q.split()[: len(q.split()) // 2]) + " " + text(40)) for i, q in long]
    d, b = _frames(spark, docs_of, docs, items + long)
    got = find(d, b).collect()
    assert {(x.doc_id, x.item_id) for x in got} == planted and len(got) == len(planted)
    assert all(x.lcs == 1 for x in got if x.doc_id < 2000)


@pytest.mark.parametrize("size", [5, 8, 12, 20, 40, 64, 100, 240, 500, 2000])
def test_recall_by_length(spark, docs_of, size):
    """Items of one length, as they are and with every eighth word replaced: at least 0.9 of either are found."""
    r, text, _, docs = _setting(size)
    items = [(i, text(size)) for i in range(20)]
    for i, q in items:
        edited = " ".join(_word(r) if k % 8 == 3 else w for k, w in enumerate(q.split()))
        docs += [(1000 + i, f"{text(90)} {q} {text(90)}"), (2000 + i, f"{text(90)} {edited} {text(90)}")]
    d, b = _frames(spark, docs_of, docs, items)
    got = {(x.doc_id, x.item_id) for x in find(d, b).collect()}
    assert len(got & {(1000 + i, i) for i in range(20)}) >= 18 and len(got & {(2000 + i, i) for i in range(20)}) >= 18
    assert size < 8 or all(x % 1000 == i for x, i in got)  # shorter ones stand in other texts by chance


def test_the_sketch_is_of_one_matrix(spark, docs_of):
    """A'(A Omega) from the dense matrix of all passages."""
    from graphloom.llm.decontaminate import BUCKETS, PASSAGE, _omega, document_frequencies, sketch

    _, _, _, docs = _setting(9)
    texts = docs_of(docs).select("text").repartition(5)
    df, n = document_frequencies(texts)
    idf = np.log((n + 1.0) / (df + 1.0)).astype(np.float32) + np.float32(1e-3)
    rows, p = [], Passages()
    for _, t in docs:
        for _, word, _, _ in p.words([t]):
            for i in range(0, len(word), PASSAGE):
                at, times = np.unique((word[i : i + PASSAGE] >> np.uint64(51)).astype(np.int64), return_counts=True)
                row = np.zeros(BUCKETS)
                row[at] = np.sqrt(times) * idf[at]
                rows.append(row / np.linalg.norm(row))
    a = np.array(rows)
    assert len(a) == n and np.allclose(sketch(texts, idf, 20), a.T @ (a @ _omega(20, 3)), atol=1e-3)


def _products(texts):
    """(row, bucket, value, n) of the passages of texts."""
    p = Passages()
    for _, word, owner, place in p.words(texts):
        row, at, value, first = p.tf(word, owner, place)
        yield row, at, value, len(first)


def test_products_against_dense_ones(spark, sf_dir):
    """Of one part, and of a sum over more passages than are held or added at once."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    omega, idf = decontaminate_._omega(20, 3), np.linspace(0.1, 5, decontaminate_.BUCKETS, dtype=np.float32)
    share, want, n_all = decontaminate_.Share(idf, omega), 0, 0
    for row, at, value, n in _products(texts):
        a = np.zeros((n, decontaminate_.BUCKETS))
        a[row, at] = value
        assert np.allclose(decontaminate_.project(omega, row, at, value, n), a @ omega, atol=1e-3)
        a *= idf
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        times = -(-2 * decontaminate_.HELD // n)
        for _ in range(times):
            share.add(row, at, value, np.zeros(n))
        want, n_all = want + times * (a.T @ (a @ omega)), n_all + n * times
    assert n_all > 2 * decontaminate_.HELD and np.allclose(share.sum(), want, rtol=1e-3, atol=1e-4 * np.abs(want).max())
    times = -(-5 * decontaminate_.HELD // n)  # the last part as one very long text
    long = np.concatenate([row + i * n for i in range(times)]), np.tile(at, times), np.tile(value, times)
    assert np.allclose(decontaminate_.project(omega, *long, times * n), np.tile(decontaminate_.project(omega, row, at, value, n), (times, 1)))
    share, want = decontaminate_.Share(idf, omega), times * (a.T @ (a @ omega))
    share.add(*long, np.zeros(times * n))
    assert np.allclose(share.sum(), want, rtol=1e-3, atol=1e-4 * np.abs(want).max())
    assert decontaminate_.project(omega, np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0).shape == (0, 20)


def test_products_cost_what_their_words_do(spark, sf_dir):
    """At most 0.75 of the CPU seconds of products in dense blocks of 32 passages, over all buckets that occur in a block."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    parts = list(_products(texts))

    def measure(_):
        import time

        decontaminate_.one_thread()
        matrix = np.random.default_rng(1).standard_normal((decontaminate_.BUCKETS, 208), dtype=np.float32)

        def dense(row, at, value, n):
            out, ends = np.empty((n, matrix.shape[1]), np.float32), np.searchsorted(row, np.arange(0, n + 32, 32))
            number = np.zeros(decontaminate_.BUCKETS, np.int64)
            for i in range(0, n, 32):
                part, mark = slice(ends[i // 32], ends[i // 32 + 1]), np.zeros(decontaminate_.BUCKETS, bool)
                mark[at[part]] = True
                some = np.flatnonzero(mark)
                number[some] = np.arange(len(some))
                block = np.zeros((min(32, n - i), len(some)), np.float32)
                block[row[part] - i, number[at[part]]] = value[part]
                out[i : i + 32] = block @ matrix[some]

        def seconds(f):
            begin = time.process_time()
            for x in parts * 10:
                f(*x)
            return time.process_time() - begin

        both = [(seconds(lambda *x: decontaminate_.project(matrix, *x)), seconds(dense)) for _ in range(6)]
        return tuple(min(x) for x in zip(*both, strict=True))

    mine, dense = spark.sparkContext.parallelize([0], 1).map(measure).collect()[0]
    assert mine <= 0.75 * dense, (mine, dense)


def test_only_stretches_with_enough_words_are_compared(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # without sentences an item is its own answer
    items = [(r.item_id, _plain(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    shares, plain = [], decontaminate_.lcs

    def counted(masks, size, words):
        shares.append(sum(w in masks for w in words) / size)
        return plain(masks, size, words)

    monkeypatch.setattr(decontaminate_, "lcs", counted)
    (index,) = decontaminate_.indexes(docs, spark.createDataFrame(items, "item_id long, text string"))
    texts = [r.text for r in docs.collect()]
    got = {(texts[x[0]], index.items[x[1]]) for x in decontaminate_.Search(index)(texts)}
    assert got == {(t, i) for t in texts for i, q in items if q in _plain(t)}
    assert shares and min(shares) >= decontaminate_.LCS


def test_numbers_of_words(spark, docs_of):
    """By a table of first bits, words with the same ones too, as by a plain search."""
    _, text, items, docs = _setting(6)
    d, b = _frames(spark, docs_of, docs, items)
    (index,) = decontaminate_.indexes(d, b)
    r = random.Random(7)
    index.words = [[w ^ r.randrange(1 << 40) for w in words for _ in range(4)] for words in index.words]
    search = decontaminate_.Search(index)
    known = {w: k for k, w in enumerate(search.known.tolist())}
    some = [w ^ x for w in known for x in (0, 1, 1 << 30)] + [0, 2**64 - 1]
    assert search.most > 1 and search.numbers(np.array(some, np.uint64)).tolist() == [known.get(w, len(known)) for w in some]


def test_short_items_of_a_large_benchmark(spark, sf_dir, docs_of):
    """20,000 items, many more than the latent space has directions; those of 15 to 19 words are planted as they are."""
    r = random.Random(4)
    texts = [r_.text.split() for r_ in spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").collect()]
    texts = [w for w in texts if len(w) >= 70]
    items = []
    for i in range(20_000):
        w, n = r.choice(texts[100:]), r.randint(15, 19) if i < 100 else r.randint(15, 59)
        a = r.randrange(len(w) - n + 1)
        items.append((i, " ".join(w[a : a + n])))
    docs = []
    for i, w in enumerate(texts[:100]):
        a = r.randrange(len(w) + 1)
        docs.append((i, " ".join([*w[:a], items[i][1], *w[a:]])))
    got = find(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(i, i) for i in range(100)} <= {(x.doc_id, x.item_id) for x in got}


def test_half_an_item_is_no_leak(spark, docs_of):
    _, text, items, docs = _setting(1)
    docs += [(1000 + i, text(40) + " " + " ".join(q.split()[:15]) + " " + text(40)) for i, q in items]
    d, b = _frames(spark, docs_of, docs, items)
    assert find(d, b).isEmpty()


def test_edge_cases(spark, docs_of):
    _, text, items, docs = _setting(2)
    leak = items[0][1]
    docs += [(None, leak), (500, leak), (500, leak), (501, None), (502, ""), (503, "12 !"), (504, text(60_000) + " " + leak), (505, leak + " " + items[1][1])]
    docs += [(506, "— – … ² ½ " * 20)]
    items += [(50, None), (51, ""), (52, "77 %"), (53, "— … —"), (None, items[2][1]), (0, leak)]
    d, b = _frames(spark, docs_of, docs, items)
    d = d.withColumn("word", F.lit("mine"))
    got = [(x.doc_id, x.item_id) for x in find(d, b).collect()]
    assert got.count((500, 0)) == 2 and got.count((504, 0)) == 1 and (505, 1) in got and (None, 0) in got
    assert {x for x, _ in got} == {None, 500, 504, 505}
    clean = decontaminate(d, b)
    assert clean.count() == len(docs) - 5 and clean.columns == d.columns
    assert find(d, b.limit(0)).isEmpty() and decontaminate(d, b.limit(0)).count() == len(docs)
    assert find(d.limit(0), b).isEmpty() and decontaminate(d.limit(0), b).isEmpty()


def test_lcs_against_the_table():
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(1, 14))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs(places(a), len(a), b) == t[-1][-1]


def test_answers():
    assert answer_of("Is it so? Yes, it is.").strip() == "Yes, it is." and answer_of("one line") == "one line" and answer_of("a\nb\n") == "b\n"
