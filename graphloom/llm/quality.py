"""Operator 7: quality by ordinal cumulative-link regression on graded ratings.

P(grade > j | text) = sigmoid(w . features(text) - theta_j) with shared weights w over hashed text
features and ordered thresholds theta. w is sparse (proximal steps with an L1 penalty), so that the
many harmless words of a long text don't add up. Every text gets its expected grade and the
probability of the highest grade, by which it is kept.

The fit uses at most ``PER_GRADE`` rated ids of each grade (smallest id hash), weighted by the square roots of
the labels' true proportions, that is between these and equal weights; scoring reads each whole text.

Defined cases: a null text or one without a token gets grade 0 and is not kept; labels with a null
rating and those of unknown documents are not learned from; repeated labels are learned from once and each
count in the proportions; of documents with one id the text of the smallest hash is learned from; without
any usable label nothing is known and every text with a token is kept, with null scores; with one
grade only, that grade is expected of all; equal texts get equal scores; extra columns pass through,
but those named like an added one are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import slices, table
from graphloom.llm.textfeat import BITS, Design, Features, bounded_sample, collect_features

PER_GRADE = 2500
#: A text is kept if the highest grade is at least this likely.
KEEP_FROM = 0.5


def grade() -> Column:
    """0: of low quality; 1: good, but toxic; 2: good and clean. From the ratings of ``labels``."""
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") > 0) & (F.col("toxic") > 0), 1).when((F.col("quality") > 0) & (F.col("toxic") == 0), 2)


@dataclass
class Ordinal:
    weights: np.ndarray  # 2**BITS, sparse
    thetas: np.ndarray  # ascending
    grades: list[int]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j but the last."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thetas[None, :], -500, 500)))


def fit(grades: list[int], at: list[np.ndarray], value: list[np.ndarray], counts: dict[int, int], l1: float = 3e-4, steps: int = 250, rounds: int = 6) -> Ordinal:
    """Maximum likelihood with an L1 penalty, by accelerated proximal steps over the whole sample.

    Each round works on the features that have a weight or whose slope exceeds the penalty; others stay
    0 until it does. A feature of a middle grade only shows once the outer ones are told apart.
    """
    levels = sorted(set(grades))
    every = Design(at, value, 4)
    y = np.searchsorted(levels, grades)
    seen = np.bincount(y, minlength=len(levels))
    p = np.array([counts[g] for g in levels]) / sum(counts[g] for g in levels)
    # between the true proportions and equal ones: rare grades count more, the common one most
    p = np.sqrt(p) / np.sqrt(p).sum()
    weight = (p / seen)[y]
    above = np.clip(1 - np.cumsum(p)[:-1], 1e-6, 1 - 1e-6)
    theta, n = -np.log(above / (1 - above)), np.arange(every.n)

    def slopes(x: Design, w: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = 1 / (1 + np.exp(-np.clip(x.dot(w)[:, None] - theta, -500, 500)))  # P(y > j)
        edge = np.concatenate([np.ones((x.n, 1)), s, np.zeros((x.n, 1))], axis=1)
        like = np.maximum(edge[n, y] - edge[n, y + 1], 1e-12)
        slope = edge * (1 - edge)
        by_row = -(slope[n, y] - slope[n, y + 1]) / like * weight
        by_theta = [(((y == j + 1).astype(float) - (y == j)) * slope[:, j + 1] / like * weight).sum() for j in range(len(theta))]
        return x.back(by_row), np.array(by_theta)

    found, active = np.zeros(every.m), np.zeros(every.m, bool)
    for _ in range(rounds if len(levels) > 1 else 0):
        more = active | (np.abs(slopes(every, found, theta)[0]) >= l1)
        if active.any() and not (more & ~active).any():
            break
        active = more
        x, w = every.only(active), found[active]
        # a separable bound on the curvature gives every weight its own step
        row = x.dot(np.ones(x.m), size=True) + 1
        step, step_t = 1 / (0.5 * x.back(weight * row, size=True) + 1e-12), 1 / (0.5 * (weight * row).sum())
        v, v_t, t = w, theta, 1.0
        for _ in range(steps):
            g, g_t = slopes(x, v, v_t)
            to = v - step * g
            to = np.sign(to) * np.maximum(np.abs(to) - step * l1, 0)
            to_t = np.sort(v_t - step_t * g_t)
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            v, v_t = to + (before - 1) / t * (to - w), np.sort(to_t + (before - 1) / t * (to_t - theta))
            w, theta = to, to_t
        found[active] = w
    weights = np.zeros(1 << BITS, np.float32)
    weights[every.names] = found
    return Ordinal(weights, theta, levels)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_grade: int = PER_GRADE) -> Ordinal | None:
    rated = labels.select(F.col(id_col).alias("id"), grade().alias("grade")).where("id IS NOT NULL")
    sample, counts = bounded_sample(rated, "grade", ["id"], per_grade)
    if not counts:
        return None
    # at most per_grade rows a grade: small enough to be sent to every task
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample.select("id", "grade")), "id")
    rows = rows.groupBy("id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    grades, at, value = collect_features(rows, "grade", "text")
    return fit(grades, at, value, counts) if grades else None


def _judge(features: Features, model: Ordinal | None, texts: list[str | None], keep_from: float) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray]:
    """Expected grades, probabilities of the highest grade (None: nothing was learned), and what is kept."""
    n = len(texts)
    row, at, value = features(texts)
    some = np.bincount(row, minlength=n) > 0
    if not model:
        return None, None, some
    tails = model.tails(np.bincount(row, model.weights[at].astype(np.float64) * value, n))
    grade = np.where(some, model.grades[0] + tails @ np.diff(model.grades), 0.0)
    tail = np.where(some, tails[:, -1] if tails.shape[1] else 1.0, 0.0)
    return grade, tail, some & (tail >= keep_from)


def _parts(model: Ordinal | None) -> tuple | None:
    return model and (model.weights, model.thetas, model.grades)  # 2**BITS numbers and a few


def score(docs: DataFrame, model: Ordinal | None, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """All columns of ``docs`` and expected_grade, tail_prob, keep."""
    added = ("expected_grade", "tail_prob", "keep")
    kept = [c for c in docs.columns if c.lower() not in added]
    at_text, held = kept.index(text_col), docs.sparkSession.sparkContext.broadcast(_parts(model))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), held.value and Ordinal(*held.value)
        for b in slices(batches, at_text):
            grade, tail, keep = _judge(features, m, b.column(at_text).to_pylist(), keep_from)
            unknown = pa.nulls(b.num_rows, pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, unknown if grade is None else pa.array(grade), unknown if tail is None else pa.array(tail), pa.array(keep)], names=[*kept, *added])

    schema = docs.select(*kept).schema.add("expected_grade", "double").add("tail_prob", "double").add("keep", "boolean")
    return docs.select(*kept).mapInArrow(read, schema)


def select_quality(docs: DataFrame, model: Ordinal | None, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are."""
    at_text, held = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(_parts(model))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), held.value and Ordinal(*held.value)
        for b in slices(batches, at_text):
            yield b.filter(pa.array(_judge(features, m, b.column(at_text).to_pylist(), keep_from)[2]))

    return docs.mapInArrow(read, docs.schema)


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs, table(spark, sf_dir, "labels"))).drop("text")
