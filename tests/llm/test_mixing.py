import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm.mixing import TARGETS, copies, fit_mix, fit_rates, learn, mix, op1_soft_mixing


def _posteriors(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>")


@pytest.mark.parametrize("keep_all", [False, True])
def test_rates_meet_the_targets(spark, keep_all):
    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(1, 500)), r.dirichlet([0.3, 0.2, 0.1]).tolist()) for i in range(400)]
    df = _posteriors(spark, rows)
    rates = fit_rates(df, "tokens", "posterior", [1.0, 2.0, 1.0], keep_all)
    got = df.withColumn("r", rates.column(F.col("posterior"), 3)).collect()
    sums = np.sum([np.array(x.posterior) * x.tokens * x.r for x in got], axis=0)
    assert sums / sums.sum() == pytest.approx([0.25, 0.5, 0.25], abs=2e-3)
    assert min(x.r for x in got) >= (1 if keep_all else 0)
    if not keep_all:
        assert sums.sum() == pytest.approx(sum(x[1] for x in rows), rel=2e-3)
    assert np.allclose(sums, rates.totals, rtol=1e-6)


def test_against_exact_least_squares(spark):
    """Where a target can't be met, no other rates come nearer: no descent is left at the result."""
    rows = [(0, 100, [1.0, 0.0]), (1, 100, [0.9, 0.1]), (2, 300, [0.8, 0.2])]
    rates = fit_rates(_posteriors(spark, rows), "tokens", "posterior", [0.0, 1.0], False, most_steps=200, close=0)
    got = [x[0] for x in _posteriors(spark, rows).orderBy("doc_id").select(rates.column(F.col("posterior"), 2)).collect()]
    p, t = np.array([x[2] for x in rows]), np.array([x[1] for x in rows])
    gram = (p * t[:, None]).T @ p
    off = (p * t[:, None]).T @ np.array(got) - np.array(rates.targets)
    slope = p @ np.linalg.pinv(gram) @ off
    assert all(s >= -1e-3 if g < 1e-9 else abs(s) < 5e-2 for s, g in zip(slope, got, strict=True))


def test_copies_follow_the_rate(spark):
    got = spark.range(20_000).select(copies(F.lit(1.3), "id").alias("c")).groupBy("c").count().collect()
    share = {r.c: r["count"] / 20_000 for r in got}
    assert set(share) == {1, 2} and share[2] == pytest.approx(0.3, abs=0.02)


def test_query(spark, sf_dir):
    rows = op1_soft_mixing(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.tokens == len(docs[r.doc_id].text.split()) for r in rows)
    sums = np.sum([np.array(r.posterior) * r.tokens * r.rate for r in rows], axis=0)
    assert sums / sums.sum() == pytest.approx([TARGETS[k] for k in sorted(TARGETS)], abs=0.01)
    assert all(0 <= r.gap <= 0.01 for r in rows)
    assert np.mean([r.domain == docs[r.doc_id].lang for r in rows]) > 0.9


def test_mix_keeps_every_row_and_edge_cases(spark, docs_of):
    rows = [(i, "alpha beta gamma " * (1 + i % 3), "x") for i in range(30)] + [(100 + i, "eins zwei drei vier", "y") for i in range(10)]
    rows += [(None, None, None), (200, "", "x"), (201, "alpha beta", None), (201, "alpha beta", None), (202, "eins zwei " * 150_000, "y")]
    docs = docs_of(rows).withColumn("tokens", F.lit("mine"))
    got = mix(docs, {"x": 1.0, "y": 1.0, "z": 5.0}, "lang")
    assert got.columns == docs.columns
    back = got.collect()
    assert {(r.doc_id, r.text) for r in back} == {(r[0], r[1]) for r in rows} and len(back) > len(rows) and back[0].tokens == "mine"
    assert mix(docs.limit(0), {"x": 1.0}, "lang").isEmpty()
    alone = learn(docs.withColumn("lang", F.lit(None).cast("string")), "lang")
    assert alone.domains == ["all"]
    found, rates = fit_mix(docs.select("doc_id", "text"), alone, {"all": 1.0})
    assert found.count() == len(rows) and rates.steps == []
