import zlib

from pyspark.sql import functions as F

from graphloom.llm.sharding import SlotMap, op3_virtual_slots, shard_by_slots


def test_contract(spark, sf_dir):
    rows = op3_virtual_slots(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    loads, places = {}, {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data) and r.law == "bytes" and r.grown_shard is None
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert set(loads) == set(range(16)) and max(loads.values()) < 1.02 * min(loads.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_nulls_repeats_and_clashing_columns(spark, docs_of):
    docs = docs_of([(1, None), (1, None), (None, "a"), (2, "é"), (2, "é")]).withColumns({"Shard": F.lit("x"), "__size": F.lit(9)})
    out, _ = shard_by_slots(docs, 2, 8)
    rows = out.collect()
    assert len(rows) == 5 and sorted(r.size for r in rows) == [1, 1, 2, 3, 3]
    assert len({r.virtual_slot for r in rows if r.doc_id == 2}) == 1 and all(r["__size"] == 9 for r in rows)
    assert shard_by_slots(docs.limit(0))[0].isEmpty()


def _load(m, weight):
    load = [0] * m.n_shards
    for slot, shard in enumerate(m.owner):
        load[shard] += weight.get(slot, 0)
    return load


def test_rebalancing_moves_little_and_is_kept(spark, tmp_path):
    path, weight = str(tmp_path / "map"), {s: 10 + s % 3 for s in range(64)}
    assert SlotMap.load(spark, path) is None
    first = SlotMap(64, 4).rebalance(weight)
    first.save(spark, path)
    second = first.rebalance(weight | {7: 16})
    assert first.rebalance(weight) is first and first.version < second.version
    assert sum(a != b for a, b in zip(first.owner, second.owner, strict=True)) < 10
    second.save(spark, path)
    third = second.rebalance({s: 10 for s in range(64)}, 5)
    load = _load(third, {s: 10 for s in range(64)})
    assert len(load) == 5 and max(load) - min(load) <= 10 and sum(a != b for a, b in zip(second.owner, third.owner, strict=True)) < 24
    third.save(spark, path)
    assert SlotMap.load(spark, path) == third and SlotMap.load(spark, path, first.version) == first and SlotMap.load(spark, path, second.version) == second


def test_a_slot_heavier_than_a_shard_leaves_the_others_balanced():
    weight = {s: 10 + s % 3 for s in range(64)} | {0: 5000, 1: 2000}
    load = sorted(_load(SlotMap(64, 8).rebalance(weight), weight))
    assert load[-1] == 5000 and load[-2] == 2000 and load[5] - load[0] <= 12


def test_a_broken_write_loses_no_version(spark, tmp_path):
    path, m = str(tmp_path / "map"), SlotMap(8, 3, (0, 0, 0, 0, 1, 1, 1, 1))  # the last shard is empty
    m.save(spark, path)
    (tmp_path / "map/version=1").mkdir()  # as a writer leaves it that was lost
    assert SlotMap.load(spark, path) == m and SlotMap.load(spark, path).n_shards == 3
    more = m.rebalance({s: 1 for s in range(8)})
    more.save(spark, path)
    assert SlotMap.load(spark, path) == more and more.version == 1


def test_a_stored_map_is_edited(spark, docs_of, tmp_path):
    """Another table with the stored map: few rows move; the map's own numbers of slots and shards hold."""
    store = str(tmp_path / "maps")
    rows = [(i, "x" * (i * 7 % 50)) for i in range(600)]
    out, m = shard_by_slots(docs_of(rows), 5, 64, store=store)
    before = {r.doc_id: r.shard for r in out.collect()}
    again, same = shard_by_slots(docs_of(rows), store=store)
    assert same == m and {r.doc_id: r.shard for r in again.collect()} == before
    rows[3] = (3, "y" * 400)
    out, new = shard_by_slots(docs_of(rows), store=store)
    assert (new.n_slots, new.n_shards, new.version) == (64, 5, m.version + 1) and SlotMap.load(spark, store) == new
    moved = sum(before[r.doc_id] != r.shard for r in out.collect() if r.doc_id != 3)
    assert 0 < moved < 200
    given, used = shard_by_slots(docs_of(rows), 7, slot_map=m)
    assert used.n_shards == 7 and {r.shard for r in given.collect()} == set(range(7)) and m.n_shards == 5


def test_a_very_long_text(docs_of):
    rows = [(i, "a") for i in range(200)] + [(1000, "é" * 500_000)]
    got, _ = shard_by_slots(docs_of(rows), 4, 32)
    got = got.collect()
    assert {r.size for r in got} == {2, 1_000_001} and len(got) == 201
    long = next(r.shard for r in got if r.doc_id == 1000)
    assert len([r for r in got if r.shard == long]) < 50
