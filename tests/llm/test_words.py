import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from graphloom.llm import mixing, quality
from graphloom.llm.common import slices
from graphloom.llm.textfeat import BITS, Features, bounded_sample
from graphloom.llm.words import REACH, Hasher, Letters, batches, letters, owners, runs, spaced

HASHER, LETTERS = Hasher(), Letters()


def _hashes(text):
    return [h for _, data, _ in batches([text]) for h in HASHER.spans(data, *spaced(data)).tolist()]


@given(st.lists(st.text(alphabet="abcé ", max_size=30), max_size=6))
def test_words_hash_by_content_wherever_they_stand(texts):
    one = {}
    for t in texts:
        words = t.split(" ")
        for w, h in zip([w for w in words if w], _hashes(t), strict=True):
            assert one.setdefault(w, h) == h
    assert len(set(one.values())) == len(one)
    seen = []
    for first, data, begins in batches(texts):
        s, e = spaced(data)
        seen += [(first + o, h) for o, h in zip(owners(begins, s).tolist(), HASHER.spans(data, s, e).tolist(), strict=True)]
    assert seen == [(i, h) for i, t in enumerate(texts) for h in _hashes(t)]


def test_words_beyond_the_reach():
    long = "x" * (REACH + 5)
    a, b = _hashes("a " + long + " b"), _hashes(long + " " + "y " * REACH + "b")
    assert a[1] == b[0] and a[2] == b[-1] and len(b) == REACH + 2


def test_runs():
    assert [x.tolist() for x in runs(np.array([True, False, True, True]))] == [[0, 2], [1, 4]]


def test_features_do_not_depend_on_neighbours():
    f = Features()
    texts = ["The cat!! SAT on the the mat", None, "", "Été 123 bon", "w " * 300_000]
    row, at, value = f(texts)
    for i, t in enumerate(texts):
        _, a, v = f([t])
        assert at[row == i].tolist() == a.tolist() and value[row == i].tolist() == v.tolist()
    assert not (row == 1).any() and f([])[0].size == 0


def test_letters_are_those_of_unicode():
    table = letters()
    for c in [*range(0x3000), 0x4E00, 0xD800, 0x1D7CE, 0x1F600, 0x20000]:
        kind = unicodedata.category(chr(c))
        assert kind == "Cn" or table[c] == {"L": 2, "M": 1}.get(kind[0], 0)  # Cn: not yet assigned in this version


@given(st.text(alphabet="ab z0-é—ß²½①Ⅷ中あ𠀀😀\u0301\n", max_size=30))
def test_lettered(text):
    data = np.frombuffer(("\n" + text.lower()).encode(), np.uint8)
    s, e = LETTERS.runs(data)
    want = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split()
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)] == want


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_samples_keep_every_class(spark, n):
    """Ids that are all equal or null, equal rows, and a class of one row beside a large one."""
    rows = spark.range(20_000).selectExpr("'a' AS k", "id", "concat('t', id) AS text")
    rows = rows.union(spark.range(n).selectExpr("'b'", "7L", "concat('t', id)")).union(spark.range(n).selectExpr("'c'", "CAST(NULL AS LONG)", "concat('t', id)"))
    rows = rows.union(spark.range(3000).selectExpr("'d'", "5L", "'same'")).union(spark.range(1).selectExpr("'e'", "id", "'one'")).union(spark.range(9).selectExpr("CAST(NULL AS STRING)", "id", "'x'"))
    found, counts = bounded_sample(rows.repartition(5), "k", ["id", "text"], 50)
    got = found.collect()
    assert counts == {"a": 20_000, "b": n, "c": n, "d": 3000, "e": 1}
    per = {k: sum(r.k == k for r in got) for k in counts}
    assert per == {"a": 50, "b": min(n, 50), "c": min(n, 50), "d": 1, "e": 1}
    every = rows.where("k = 'a'").selectExpr("id", "shiftrightunsigned(xxhash64('sample', id, text), 1) AS h").orderBy("h").limit(50).collect()
    assert {r.id for r in got if r.k == "a"} == {r.id for r in every}
    assert bounded_sample(rows.limit(0), "k", ["id", "text"], 50)[0].isEmpty()


class _Table:
    """Stands for a DataFrame and its session, and holds the function that a worker would run."""

    columns, schema = ["doc_id", "text"], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def __init__(self):
        self.sparkSession = self.sparkContext = self

    def broadcast(self, value):
        self.value = value
        return self

    def select(self, *_):
        return self

    def mapInArrow(self, read, _):  # noqa: N802
        self.read = read


@pytest.mark.parametrize("stage", ["keep", "grade", "posterior"])
def test_a_worker_holds_little_of_a_large_batch(stage):
    """The memory that judging texts takes does not follow the number of a batch's rows."""
    table, weights = _Table(), np.ones(1 << BITS, np.float32)
    ordinal = quality.Ordinal(weights, np.array([-1e9, -1e9]), [0, 1, 2])
    if stage == "keep":
        quality.select_quality(table, ordinal)
    elif stage == "grade":
        quality.score(table, ordinal)
    else:
        mixing.with_posteriors(table, mixing.Posterior(["a", "b"], np.stack([weights, -weights], 1), np.zeros(2)), "text", "n", "p")
    texts = [" ".join(f"{chr(97 + k % 26) * (1 + k % 9)}{chr(97 + i % 23)}" for k in range(300)) for i in range(8000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000), pa.int64()), pa.array(texts)], names=table.columns)
    tracemalloc.start()
    try:
        ids = [i for b in table.read(iter([batch])) for i in b.column(0).to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert ids == list(range(8000)) and peak < 40e6


def test_slices_keep_rows_and_bound_bytes():
    texts = [None, "", "é" * 30, "x" * 500, *["ab"] * 200, "y" * 90, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["i", "t"])
    got = list(slices(iter([batch.slice(0, 0), batch, batch.slice(3, 9)]), 1, 100))
    assert [r for b in got for r in b.to_pylist()] == batch.to_pylist() + batch.slice(3, 9).to_pylist()
    assert all(sum(len((t or "").encode()) + 1 for t in b.column(1).to_pylist()[:-1]) <= 100 for b in got) and len(got) > 8
    assert not list(slices(iter([batch.slice(0, 0)]), 1))
