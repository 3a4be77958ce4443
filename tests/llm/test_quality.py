import numpy as np
from pyspark.sql import functions as F

from graphloom.llm.quality import fit, learn, op7_ordinal_quality, score, select_quality

LABELS = "doc_id long, quality int, toxic int"


def _corpus(n=240):
    """Good texts, texts with a bad word, and junk; the words are otherwise alike."""
    r = np.random.default_rng(0)
    words = [a + b for a in ("ba", "di", "ko", "lu", "me") for b in ("ra", "to", "ni", "sel", "vam", "pur")]
    rows, labels = [], []
    for i in range(n):
        t = r.choice(words, 30).tolist()
        kind = i % 3
        if kind == 1:
            t[r.integers(30)] = "scoundrel"
        if kind == 0:
            t = [w.upper() + "!!" for w in t]
        rows.append((i, " ".join(t)))
        labels.append((i, int(kind > 0), int(kind == 1)))
    return rows, labels


def test_held_out_texts(spark, docs_of):
    rows, labels = _corpus()
    docs, rated = docs_of(rows), spark.createDataFrame([x for x in labels if x[0] % 2], LABELS)
    got = {r.doc_id: r for r in score(docs, learn(docs, rated)).collect()}
    held = [x for x in labels if x[0] % 2 == 0]
    assert np.mean([got[i].keep == (q == 1 and t == 0) for i, q, t in held]) > 0.95
    grade = [np.mean([got[i].expected_grade for i, q, t in held if (q, t) == k]) for k in ((0, 0), (1, 1), (1, 0))]
    assert grade[0] < grade[1] < grade[2]
    assert {r.doc_id for r in select_quality(docs, learn(docs, rated)).collect()} == {i for i, r in got.items() if r.keep}


def test_likelihood_at_the_optimum_beats_its_neighbours():
    r = np.random.default_rng(1)
    at = [np.sort(r.choice(40, 8, replace=False)).astype(np.int32) for _ in range(300)]
    value = [np.ones(8, np.float32) for _ in at]
    y = [int((a < 10).sum() + r.normal() * 0.5 > 2) + int((a < 10).sum() + r.normal() * 0.5 > 3) for a in at]
    counts = {g: y.count(g) for g in set(y)}
    m = fit(y, at, value, counts, l1=1e-4, steps=400)
    p = np.array([counts[g] for g in sorted(counts)]) / len(y)
    p = np.sqrt(p) / np.sqrt(p).sum()

    def loss(w, th):
        out = 1e-4 * np.abs(w).sum()
        for a, g in zip(at, y, strict=True):
            s = np.concatenate([[1], 1 / (1 + np.exp(th - w[a].sum())), [0]])
            out -= p[g] / counts[g] * np.log(s[g] - s[g + 1])
        return out

    w, th = m.weights.astype(float), m.thetas
    best = loss(w, th)
    assert (np.diff(th) > 0).all()
    for k in np.flatnonzero(w)[:12]:
        for d in (-0.05, 0.05):
            v = w.copy()
            v[k] += d
            assert loss(v, th) > best - 1e-5
    for d in (-0.05, 0.05):
        assert loss(w, th + d) > best - 1e-5


def test_edge_cases(spark, docs_of):
    rows, labels = _corpus(60)
    docs = docs_of([*rows, (None, None), (900, ""), (901, " \n"), (902, rows[2][1]), (903, "di ra " * 200_000)]).withColumn("Keep", F.lit("old"))
    rated = spark.createDataFrame([*labels, (None, 1, 1), (5, None, 0), (12345, 1, 0), labels[0]], LABELS)
    model = learn(docs, rated)
    got = score(docs, model).collect()
    assert len(got) == 65 and all(r.expected_grade == 0 and not r.keep for r in got if not (r.text or "").strip())
    assert len({r.tail_prob for r in got if r.text == rows[2][1]}) == 1
    assert learn(docs, rated.limit(0)) is None
    unknown = score(docs, None).collect()
    assert all(r.tail_prob is None and r.keep == bool((r.text or "").strip()) for r in unknown)
    one = learn(docs, rated.where("quality = 1 AND toxic = 0"))
    assert all(r.expected_grade == 2 for r in score(docs, one).collect() if (r.text or "").strip())
    assert score(docs.limit(0), model).isEmpty() and select_quality(docs, model).columns == docs.columns


def test_query(spark, sf_dir):
    got = op7_ordinal_quality(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got.columns == ["doc_id", "expected_grade", "tail_prob", "keep"]


def test_held_out_labels(spark, sf_dir):
    """Fitted on the documents of odd ids, the query's operator keeps nearly all good ones of even ids, and few others."""
    folder = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(docs, labels.where("doc_id % 2 = 1"))
    held = labels.where("doc_id % 2 = 0 AND quality IS NOT NULL AND toxic IS NOT NULL")
    got = score(docs.select("doc_id", "text"), model).drop("text").join(held, "doc_id").collect()
    good = [r.keep for r in got if r.quality == 1 and r.toxic == 0]
    other = [r.keep for r in got if not (r.quality == 1 and r.toxic == 0)]
    assert len(good) > 1000 and np.mean(good) > 0.97 and np.mean(other) < 0.1
