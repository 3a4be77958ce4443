import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm.minhash import classes
from graphloom.llm.mixing import TARGETS

STAGES = dict(corpus_pipeline.STAGES)


def test_the_stages_and_their_order():
    assert list(STAGES) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def _plain(t):
    return " ".join(re.findall(r"[^\W\d_]+", (t or "").lower()))


def _shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _first_of_each_class(rows):
    """Ids that stay when all pairs are compared."""
    sets, root = {r.doc_id: _shingles(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total() - 1e-12:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x for x in root if find(x) == x}


def test_every_stage_against_brute_force(spark, sf_dir):
    """Each stage's decisions on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    rated = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [_plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    every = {r.doc_id: r for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).checkpoint()
        before, rows = rows, docs.collect()
        had, got = {r.doc_id for r in before}, Counter(r.doc_id for r in rows)
        if name != "sharding":
            assert docs.columns == columns and all(r == every[r.doc_id] for r in rows)
        if name == "quality":
            good = [i in got for i, x in rated.items() if x == (1, 0)]
            other = [i in got for i, x in rated.items() if i in every and x != (1, 0)]
            assert sum(good) >= 0.97 * len(good) and sum(other) <= 0.1 * len(other)
        elif name == "near_duplicates":
            assert set(got) == _first_of_each_class(before) and max(got.values()) == 1 and len(got) < len(had)
        elif name == "decontamination":
            assert set(got) == {r.doc_id for r in before if not any(q in _plain(r.text) for q in items)}
        elif name == "mixing":
            tokens = Counter()
            for r in rows:
                tokens[r.lang] += len(r.text.split())
            assert set(got) == had and sum(abs(tokens[k] / tokens.total() - w) for k, w in TARGETS.items()) < 0.3
        else:
            loads, slots, places = Counter(), Counter(), {}
            for r in rows:
                loads[r.shard] += r.size
                slots[r.virtual_slot] += r.size
                places.setdefault(r.shard, []).append(r.slot)
            assert got == Counter(r.doc_id for r in before) and set(loads) == set(range(16))
            # a shard above the mean by more than the rest differ is one heavy slot: the copies of one document
            whole = {max(s for v, s in slots.items() if any(r.virtual_slot == v and r.shard == k for r in rows)) for k in loads}
            light = [x for x in loads.values() if x not in whole]
            assert max(light) < 1.1 * min(light) and max(light) <= 1.1 * loads.total() / 16
            assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.select("doc_id").distinct().count() > 100 and got.agg({"shard": "max"}).first()[0] == 15


@pytest.mark.parametrize("name", list(STAGES))
def test_edge_cases(spark, sf_dir, name):
    """Null, empty, very long and repeated rows, clashing columns, and an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = docs.orderBy("doc_id").limit(40)
    odd = [(None, None), (900_001, None), (900_001, None), (900_002, ""), (900_003, " \n"), (900_004, "word " * 150_000), (900_005, "a quiet note of one line"), (900_005, "a quiet note of one line"), (None, "a quiet note without an id")]
    odd = spark.createDataFrame(odd, "doc_id long, text string")
    for c in base.columns:
        if c not in odd.columns:
            odd = odd.withColumn(c, F.lit(None).cast(base.schema[c].dataType))
    clash = {"row": F.lit("mine"), "keep": F.lit(7), "__copy": F.lit("x"), "tokens": F.lit(1.5), "Word": F.lit("w"), "shard": F.lit("s")}
    docs = base.unionByName(odd).withColumns(clash)
    out = STAGES[name](spark, docs, sf_dir)
    rows = out.collect()
    assert out.columns == docs.columns if name != "sharding" else set(docs.columns) <= set(out.columns) | {"shard"}
    assert all(r.row == "mine" and r["__copy"] == "x" for r in rows)
    per = Counter((r.doc_id, r.text) for r in rows)
    had = Counter((r.doc_id, r.text) for r in docs.collect())
    if name == "quality":
        assert set(per) <= set(had) and not any(k in per for k in had if not (k[1] or "").strip()) and all(per[k] == had[k] for k in per)
    elif name == "near_duplicates":
        assert max(per.values()) == 1 or per[(900_001, None)] == 2
        assert {(None, None), (900_001, None), (900_002, ""), (900_003, " \n"), (900_005, "a quiet note of one line")} <= set(per)
        assert classes(out).where("NOT keep").isEmpty()
    elif name == "decontamination":
        assert set(per) <= set(had) and all(per[k] == had[k] for k in per) and all(k in per for k in had if k[0] is None or k[0] > 900_000)
    elif name == "mixing":
        assert set(per) == set(had) and all(per[k] >= had[k] for k in had)
    else:
        assert per == had
    assert STAGES[name](spark, docs.limit(0), sf_dir).isEmpty()
