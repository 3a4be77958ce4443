"""Operator 8: language identification with string kernels.

The kernel of two texts is the number of character n-grams (2 to 4 letters, hashed) that both have,
over the root of the product of their numbers: the blended-spectrum presence kernel. Landmarks from
the learning sample give its Nyström approximation, on which one-versus-rest kernel ridge regression is
solved. For scoring, landmarks, Nyström map and regression weights are multiplied once into a matrix
(n-gram bucket x language), by which a batch of presence vectors is multiplied.

The fit uses a bounded sample: at most ``per_lang`` distinct rows (id and text) with a letter of each language, those
of smallest hash among the rows that may be learned from. Prediction reads the whole text and nothing else.

Defined cases: a null text or one without a letter (a character of Unicode's category L) is ``und`` with score 0; with nothing to learn
from every row is; equal texts get equal results; a text shorter than two letters is padded by the
blanks around it; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.textfeat import bounded_sample
from graphloom.llm.words import letters

BITS = 17
PER_LANG, LANDMARKS, RIDGE = 300, 64, 1e-3


class Grams:
    """Sorted buckets of the n-grams that a text has; keeps its scratch space."""

    def __init__(self) -> None:
        self.mark, self.letters = np.zeros(1 << BITS, bool), letters()

    def __call__(self, text: str) -> np.ndarray | None:
        """None for a text without a letter."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.letters[c]
        if not (kind == 2).any():
            return None
        # letters and their marks, with one blank for all between them and at the ends
        inside = kind > 0
        kept = inside.copy()
        kept[1:] |= inside[:-1]
        h = c = np.concatenate([[32], np.where(inside, c, 32)[kept], [32] * int(inside[-1])]).astype(np.uint64)
        for n in (2, 3, 4):
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
            if not len(h):
                break
            self.mark[(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)] = True
        found = np.flatnonzero(self.mark).astype(np.int32)
        self.mark[found] = False
        return found


def fit(sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """The languages and the matrix (bucket x language) that maps presence / sqrt(size) to ridge scores."""
    names = sorted(set(langs))
    y = np.array([[1.0 if a == b else -1.0 for b in names] for a in langs])
    of = {a: [i for i, b in enumerate(langs) if a == b] for a in names}
    chosen = [i for a in names for i in of[a][:landmarks]]

    def dense(ids: list[int]) -> np.ndarray:
        x = np.zeros((len(ids), 1 << BITS), np.float32)
        for row, i in enumerate(ids):
            x[row, sets[i]] = 1 / np.sqrt(max(1, len(sets[i])))
        return x

    marks = dense(chosen)
    k = np.concatenate([dense(list(range(at, min(at + 256, len(sets))))) @ marks.T for at in range(0, len(sets), 256)]).astype(np.float64)
    values, vectors = np.linalg.eigh(marks.astype(np.float64) @ marks.T.astype(np.float64) if len(chosen) <= 64 else (marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # K_mm^(-1/2)
    phi = k @ root
    # each language counts alike, whatever its number of rows
    weight = np.array([1 / len(of[a]) for a in langs]) * len(langs) / len(names)
    beta = np.linalg.solve(phi.T @ (phi * weight[:, None]) + ridge * len(langs) * np.eye(phi.shape[1]), phi.T @ (y * weight[:, None]))
    return names, (marks.T @ (root @ beta).astype(np.float32)).astype(np.float32)


def learn(docs: DataFrame, may_learn: Column, lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray] | None:
    rows = docs.where(may_learn & F.col("text").rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), "text")
    sample, _ = bounded_sample(rows, "lang", ["id", "text"], per_lang)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            sets = [found.tobytes() if (found := grams(t.as_py())) is not None else None for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary()), b.column(2)], names=["lang", "grams", "h"])

    got = sample.select("lang", "text", "sample_hash").mapInArrow(read, "lang string, grams binary, h long").where("grams IS NOT NULL").collect()  # at most per_lang a language
    got.sort(key=lambda r: (r.lang, r.h))
    return fit([np.frombuffer(r.grams, np.int32) for r in got], [r.lang for r in got]) if got else None


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text and lang_pred, score."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in (text_col.lower(), "lang_pred", "score")]
    held = spark.sparkContext.broadcast(model)  # 2**BITS numbers a language

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            pred, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            if held.value:
                names, matrix = held.value
                rows, sets, size = [], [], 0

                def flush() -> None:
                    # a batch of presence vectors times the matrix: gathered rows, summed by text
                    at = np.cumsum([0, *map(len, sets[:-1])])
                    f = np.add.reduceat(matrix[np.concatenate(sets)], at, axis=0) / np.sqrt([[len(s)] for s in sets])
                    best = f.argmax(1)
                    for row, j in zip(rows, best, strict=True):
                        pred[row] = names[j]
                    score[rows] = np.clip((f[np.arange(len(rows)), best] + 1) / 2, 0, 1)

                for i, t in enumerate(b.column(len(kept))):
                    found = grams(t.as_py() or "")
                    if found is not None:
                        sets.append(found)
                        rows.append(i)
                        size += len(sets[-1])
                        if size > 500_000:
                            flush()
                            rows, sets, size = [], [], 0
                if rows:
                    flush()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*kept, text_col).mapInArrow(read, schema)


def op8_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = learn(docs, ~F.coalesce(held_out, F.lit(False)))
    return predict(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model)
