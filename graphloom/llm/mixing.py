"""Operator 1: mixing sources to target weights with soft membership.

A softmax classifier, fitted on a labelled table, gives every document its posterior over the domains.
Rates r >= floor are then fitted so that the expected tokens of each domain, sum_i r_i tokens_i p_i, meet
the targets: least squares by projected gradient, in the metric of the Gram matrix sum tokens p p',
in which the step 1 is safe and, where no bound is met, exact. A rate depends on the posterior and the
list of the steps' directions only, so nothing but one vector a step passes the driver. A document
is emitted floor(r) times, and once more if its hash falls below the rest.

The classifier is fitted on at most ``PER_DOMAIN`` distinct labelled rows (id and text) of each domain; totals,
Gram matrix and rates are over all rows. ``Rates.gap`` says how far the totals stay from the targets, and a
warning is given where they are not met.

Defined cases: a null or empty text has 0 tokens, the uniform posterior and no say in the totals; its rate
follows from its posterior all the same. Without labels there is one domain, ``all``. Domains without
a target get weight 0, targets of unknown domains are left out, and the rest are scaled to sum 1.
Equal rows get equal rates; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import cut, fresh, slices, table
from graphloom.llm.textfeat import BITS, Design, Features, bounded_sample, collect_features

PER_DOMAIN = 400
#: The weights that the query aims at, by the documents' language.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


@dataclass
class Posterior:
    domains: list[str]
    weights: np.ndarray  # 2**BITS x domains
    bias: np.ndarray

    def __call__(self, n: int, row: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Of n texts; one without a token has the uniform posterior."""
        size = np.bincount(row, minlength=n)
        z = np.stack([np.bincount(row, self.weights[at, k].astype(np.float64) * value, n) for k in range(len(self.domains))], axis=1)
        z = z / np.sqrt(np.maximum(size, 1))[:, None] + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p = p / p.sum(1, keepdims=True)
        p[size == 0] = 1 / len(self.domains)
        return p


def fit(labels: list[str], at: list[np.ndarray], value: list[np.ndarray], ridge: float = 1e-3, steps: int = 120, rate: float = 0.5) -> Posterior:
    """Softmax regression with an L2 penalty by AdaGrad; rows are scaled by the root of their features' number."""
    domains = sorted(set(labels))
    value = [v / np.sqrt(len(v)) for v in value]
    x = Design(at, value, 2)
    y = np.eye(len(domains))[np.searchsorted(domains, labels)]
    share = y / y.sum(0) / len(domains)  # each domain counts alike
    row = share.sum(1)
    w, b = np.zeros((x.m, len(domains))), np.zeros(len(domains))
    sum_w, sum_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps if len(domains) > 1 else 0):
        z = np.stack([x.dot(w[:, k]) for k in range(len(domains))], axis=1) + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - y) * row[:, None]
        gw = np.stack([x.back(g[:, k]) for k in range(len(domains))], axis=1) + ridge * w / max(1, x.m)
        gb = g.sum(0)
        sum_w += gw * gw
        sum_b += gb * gb
        w -= rate * gw / (np.sqrt(sum_w) + 1e-8)
        b -= rate * gb / (np.sqrt(sum_b) + 1e-8)
    weights = np.zeros((1 << BITS, len(domains)), np.float32)
    weights[x.names] = w
    return Posterior(domains, weights, b)


def learn(labelled: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", per_domain: int = PER_DOMAIN) -> Posterior:
    rows = labelled.where(F.length(F.trim(text_col)) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("domain"))
    sample, counts = bounded_sample(rows, "domain", ["id", "text"], per_domain)
    if counts:
        labels, at, value = collect_features(sample, "domain", "text")
        if labels:
            return fit(labels, at, value)
    return Posterior(["all"], np.zeros((1 << BITS, 1), np.float32), np.zeros(1))


def with_posteriors(docs: DataFrame, model: Posterior, text_col: str, tokens: str, posterior: str) -> DataFrame:
    """All columns of ``docs`` and its number of tokens and its posterior (an array, by ``model.domains``)."""
    at_text, names = docs.columns.index(text_col), [*docs.columns, tokens, posterior]
    held = docs.sparkSession.sparkContext.broadcast((model.domains, model.weights, model.bias))  # 2**BITS numbers a domain

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), Posterior(*held.value)
        for b in slices(batches, at_text):
            texts = b.column(at_text).to_pylist()
            n = [len((t or "").split()) for t in texts]
            post = np.round(m(len(texts), *features(texts)), 9)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(list(post), pa.list_(pa.float64()))], names=names)

    added = [T.StructField(tokens, T.LongType()), T.StructField(posterior, T.ArrayType(T.DoubleType()))]
    return docs.mapInArrow(read, T.StructType([*docs.schema.fields, *added]))


@dataclass
class Rates:
    """What makes a posterior's rate: the first rate, the floor, and the direction of every step."""

    start: float
    floor: float
    steps: list[list[float]] = field(default_factory=list)
    totals: list[float] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)

    @property
    def gap(self) -> float:
        """How far the totals are from the targets, as a share of these: 0 if all are met."""
        return sum(abs(a - b) for a, b in zip(self.totals, self.targets, strict=True)) / max(sum(self.targets), 1e-300)

    def column(self, posterior: Column, n: int) -> Column:
        if not self.steps:
            return F.lit(float(max(self.start, self.floor)))
        flat = F.split(F.lit(";".join(",".join(map(repr, s)) for s in self.steps)), ";")
        steps = F.transform(flat, lambda s: F.split(s, ",").cast("array<double>"))

        def step(r: Column, g: Column) -> Column:
            return F.greatest(F.lit(float(self.floor)), r - sum(posterior[k] * g[k] for k in range(n)))

        return F.aggregate(steps, F.lit(float(max(self.start, self.floor))), step)


def fit_rates(rows: DataFrame, tokens: str, posterior: str, weights: list[float], keep_all: bool, most_steps: int = 20, close: float = 1e-3) -> Rates:
    """``rows`` is read once a step; one number a domain and one a pair of domains come back.

    The Gram matrix of a step is over the rows above the floor, which makes the step nearly exact; after a
    step that gained little it is over all rows, with which no step can lose.
    """
    n, post = len(weights), F.col(posterior)
    tok, floor = F.col(tokens).cast("double"), 1.0 if keep_all else 0.0

    def measure(r: Column) -> tuple[np.ndarray, np.ndarray]:
        part = rows.select(tok.alias("t"), post.alias("p"), r.alias("r"))
        free, p = F.when(F.col("r") > floor, F.col("t")).otherwise(0.0), F.col("p")
        sums = [F.sum(F.col("t") * p[a] * F.col("r")) for a in range(n)] + [F.sum(free * p[a] * p[b]) for a in range(n) for b in range(n)]
        got = [x or 0.0 for x in part.agg(*sums).first()]
        return np.array(got[:n]), np.array(got[n:]).reshape(n, n)

    have, gram = measure(F.lit(1.0 + floor * 1e-9))
    aim, total = np.array(weights) / max(sum(weights), 1e-300), have.sum()
    # to keep every document at least once, the budget must cover the domain that is most above its weight
    grow = max((have[a] / total / aim[a] for a in range(n) if aim[a] > 0), default=1.0) if keep_all and total else 1.0
    goal = aim * total * max(1.0, grow)
    rates = Rates(1.0, floor, targets=[float(t) for t in goal], totals=[float(h) for h in have])
    now, free, last = have, gram, np.inf
    for _ in range(most_steps):
        off = float(np.abs(now - goal).sum()) / max(goal.sum(), 1e-300)
        if off <= close:
            break
        use = free if off < 0.8 * last and free.any() else gram
        last = off
        rates.steps.append([float(g) for g in np.linalg.pinv(use, rcond=1e-10) @ (now - goal)])
        now, free = measure(rates.column(post, n))
        rates.totals = [float(x) for x in now]
    if rates.steps and rates.gap > close:
        warnings.warn(f"the expected tokens are off the targets by {rates.gap:.4f} of them", stacklevel=2)
    return rates


def copies(rate: Column, *key: Column | str) -> Column:
    """Whole copies of a row, whose mean over the keys is its rate."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), *key), F.lit(1 << 30)) / (1 << 30)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def fit_mix(docs: DataFrame, model: Posterior, targets: Mapping[str, float], text_col: str = "text", keep_all: bool = False) -> tuple[DataFrame, Rates]:
    """tokens, posterior and the other columns of ``docs`` but the text, written once; and the rates."""
    rows = cut(with_posteriors(docs, model, text_col, "tokens", "posterior").drop(text_col))
    return rows, fit_rates(rows, "tokens", "posterior", _weights(model, targets), keep_all)


def _weights(model: Posterior, targets: Mapping[str, float]) -> list[float]:
    return [max(0.0, targets.get(d, 0.0)) for d in model.domains]


def mix(docs: DataFrame, targets: Mapping[str, float], label_col: str, id_col: str = "doc_id", text_col: str = "text", keep_all: bool = True) -> DataFrame:
    """``docs``, each row as often as its rate says. With ``keep_all`` every row comes at least once."""
    model = learn(docs, label_col, id_col, text_col)
    n = fresh(docs, "tokens", "posterior", "copy")
    # each text is classified once: the rows are written with their posteriors, and read once a step without the rest
    rows = cut(with_posteriors(docs, model, text_col, n["tokens"], n["posterior"]))
    rates = fit_rates(rows, n["tokens"], n["posterior"], _weights(model, targets), keep_all)
    times = copies(rates.column(F.col(n["posterior"]), len(model.domains)), F.col(id_col), F.xxhash64(text_col))
    return rows.withColumn(n["copy"], F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    model = learn(docs, "lang")
    rows, rates = fit_mix(docs.select("doc_id", "source", F.xxhash64("text").alias("h"), "text"), model, TARGETS)
    best = F.array_position(F.col("posterior"), F.array_max("posterior")).cast("int")
    out = rows.withColumn("rate", F.round(rates.column(F.col("posterior"), len(model.domains)), 6))
    return out.select(
        "doc_id", "source", "tokens", F.element_at(F.array(*map(F.lit, model.domains)), best).alias("domain"),
        "posterior", "rate", copies(F.col("rate"), "doc_id", "h").alias("copies"), F.lit(rates.gap).alias("gap"),
    )
