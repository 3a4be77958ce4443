import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.minhash import Darts, band_keys, classes, deduplicate, op5_dart_minhash


def _shingles(text):
    """How often each occurs."""
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _want(rows):
    """Class of each row's position by comparing all pairs."""
    sets, root = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total() - 1e-12:
            root[find(b)] = find(a)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted(g) for g in groups.values())


def _got(rows, found):
    groups = {}
    for r in found:
        groups.setdefault(r.class_id, []).append(r.doc_id)
    return sorted(sorted(g) for g in groups.values())


def _text(r, n):
    return [f"w{r.randrange(400)}" for _ in range(n)]


def _corpus(seed=1):
    r, rows = random.Random(seed), []
    for _ in range(25):
        base = _text(r, r.randrange(3, 160))
        rows.append(base)
        for _ in range(r.randrange(4)):
            near = list(base)
            for _ in range(r.randrange(1 + len(base) // 40)):
                near[r.randrange(len(near))] = f"w{r.randrange(400)}"
            rows.append(near)
    chain = _text(r, 120)
    for _ in range(8):  # each like the one before, the ends unlike
        rows.append(list(chain))
        at = r.randrange(100)
        chain[at : at + 6] = _text(r, 6)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_all_pairs(docs_of, seed):
    rows = _corpus(seed)
    found = classes(docs_of(rows)).collect()
    assert _got(rows, found) == _want(rows)
    assert all((r.doc_id == r.class_id) == r.keep for r in found)


def test_repeated_shingles_weigh_more(docs_of):
    """Texts of equal shingle sets that occur unequally often, and long runs of one line."""
    r = random.Random(8)
    line, rest = " ".join(_text(r, 6)), " ".join(_text(r, 60))
    rows = [(i, f"{line} " * k + rest) for i, k in enumerate([1, 2, 3, 10, 11, 12, 40, 80])] + [(20, f"{line} " * 4000), (21, f"{line} " * 4100), (22, f"{line} " * 6000)]
    found = classes(docs_of(rows)).collect()
    assert _got(rows, found) == _want(rows) and len(_want(rows)) > 4


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert _got(rows, op5_dart_minhash(spark, sf_dir).collect()) == _want(rows)


def test_a_large_group_of_near_copies(docs_of):
    """Edits of one base that are unlike each other, with the base among them."""
    r = random.Random(4)
    base = _text(r, 200)
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        near = list(base)
        at = r.randrange(170)
        near[at : at + 14] = [f"x{i}_{k}" for k in range(14)]
        rows.append((i, " ".join(near)))
    found = classes(docs_of(rows)).collect()
    assert _got(rows, found) == _want(rows)


def test_many_texts_around_one_passage(docs_of):
    """They share buckets, but few are alike; those that are must be found."""
    r = random.Random(6)
    passage = _text(r, 150)
    rows = [(i, " ".join(passage + [f"y{i}_{k}" for k in range(60)])) for i in range(120)]
    rows += [(200 + i, " ".join(passage + [f"y{i}_{k}" for k in range(50)] + ["z"] * (i % 3) + [f"y{i}_{k}" for k in range(52, 60)])) for i in range(0, 120, 7)]
    found = classes(docs_of(rows)).collect()
    assert _got(rows, found) == _want(rows)


def test_edge_cases(docs_of):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text), (3, text), (1, text.upper()), (2, None), (4, ""), (5, " \n"), (6, "few words"), (7, "Few  words"), (8, "few"), (None, "few"), (9, "z " * 300_000), (10, "z " * 300_000)]
    docs = docs_of(rows).withColumns({"row": F.lit("mine"), "node": F.lit(1)})
    found = classes(docs).collect()
    of = {r.doc_id: r.class_id for r in found}
    assert len(found) == len(rows)
    assert (of[3], of[1], of[2], of[4], of[5], of[6], of[7], of[9], of[10]) == (1, 1, 2, 4, 5, 6, 6, 9, 9) and of[None] == of[8] == 8
    left = deduplicate(docs)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 4, 5, 6, 8, 9] and left.columns == docs.columns
    again = deduplicate(docs_of([(1, text), (1, text), (1, text), (2, None), (2, None)]))
    assert sorted(r.doc_id for r in again.collect()) == [1, 2, 2]
    assert classes(docs.limit(0)).isEmpty() and deduplicate(docs.limit(0)).isEmpty()


def test_darts_estimate_weighted_similarity():
    r = np.random.default_rng(0)
    h = r.integers(0, 2**63, 300).astype(np.uint64)
    a = r.random(300) * 4
    b = a * r.uniform(0.5, 1.5, 300)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = [np.equal(*Darts(96, seed)(2, np.repeat([0, 1], 300), np.tile(h, 2), np.concatenate([a, b]))).mean() for seed in range(20)]
    assert np.mean(got) == pytest.approx(want, abs=0.03)


def test_signatures_do_not_depend_on_neighbours():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 3, 40, 700)]
    d = Darts(96)
    together = d(5, np.repeat([0, 1, 2, 4], [len(s) for s in sets]), np.concatenate(sets))
    for i, s in zip((0, 1, 2, 4), sets, strict=True):
        assert (together[i] == d(1, np.zeros(len(s), np.int64), s)[0]).all() and (together[i] != 0).all()
    assert not together[3].any() and band_keys(together).shape == (5, 24)


def test_components(spark):
    r = random.Random(0)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long"))[0].collect()}
    assert got == {x: find(x) for x in root if any(a != b and x in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "u long, v long"))[1] == 0
