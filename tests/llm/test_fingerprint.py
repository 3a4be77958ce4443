import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm.fingerprint import GEAR, MAX, MIN, chunks, containment, cuts, edited_pairs, fingerprints, op4_content_chunks, parse, render, rolling


def _want(rows):
    """doc -> edited text, by brute force; ids differ."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[doc] = (text, text[: len(text) - half] + after[:half], after)
    return out


def test_contract(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, rows = _want(docs), op4_content_chunks(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    by_text = {}
    for r in rows:
        text, edited, after = want[r.doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (render(chunks(text)), render(chunks(edited)))
        assert r.near_edited == pytest.approx(containment(chunks(text), chunks(edited))) and r.near_next == pytest.approx(containment(chunks(text), chunks(after)))
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    long = [r for r in rows if r.n_chars > 1000]
    assert sum(r.near_edited for r in long) / len(long) > 0.4 and sum(r.near_next for r in long) / len(long) < 0.1


def test_gear_by_definition():
    data = random.Random(1).randbytes(300)
    h = 0
    want = []
    for b in data:
        h = ((h << 1) + int(GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert rolling(data).tolist() == want


@given(st.binary(max_size=2000))
def test_chunks_cover_the_text(data):
    ends = cuts(data)
    assert (ends[-1] if ends else 0) == len(data) and all(0 < b - a <= MAX for a, b in zip([0, *ends], ends, strict=False))
    assert all(b - a >= MIN for a, b in zip([0, *ends], ends[:-1], strict=False))


def test_an_insertion_changes_little():
    r = random.Random(2)
    text = " ".join(r.choice("lorem ipsum dolor sit amet consectetur elit sed".split()) + str(r.randrange(999)) for _ in range(3000))
    edited = text[:5000] + "something new" + text[5000:]
    assert containment(chunks(text), chunks(edited)) > 0.97 and containment(chunks(text), chunks(text[::-1])) < 0.05
    assert parse(render(chunks(text))) == chunks(text)


def test_containment_cases():
    a, b = chunks("x" * 500), chunks("y" * 500)
    assert containment(a, a) == 1 and containment(a, b) == 0 and containment({}, {}) == 1 and containment({}, a) == 0 and containment(a, {}) == 0


@pytest.mark.parametrize("rows", [[], [(5, "only one, alone")], [(1, None), (2, ""), (3, "abc"), (4, "é" * 9)], [(i, f"{i} " * (i % 40)) for i in range(300)], [(1, "a b c d " * 100_000), (2, "z")]])
def test_against_brute_force(docs_of, rows):
    got = {r.doc_id: r for r in edited_pairs(docs_of(rows)).collect()}
    assert {k: r.edited_sha256 for k, r in got.items()} == {k: hashlib.sha256(e.encode()).hexdigest() for k, (_, e, _) in _want(rows).items()}


def test_null_and_repeated_ids(docs_of):
    got = edited_pairs(docs_of([(7, "seven " * 9), (7, "seven " * 9), (7, "other"), (None, "none of them"), (None, None), (1, "one")])).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((i is None, i) for i in (7, 7, 7, None, None, 1))


def test_general_interface(docs_of):
    got = fingerprints(docs_of([(1, "some text"), (2, None)])).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {1: render(chunks("some text")), 2: ""}
