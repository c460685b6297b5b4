"""Document quality by ordinal cumulative-link regression on graded ratings.

Grades run from 0 upwards. One weight vector over hashed features of the text serves all
grades, and ordered thresholds t1 < t2 < ... cut its score: P(grade >= k) = s(w.x - tk)
with the logistic s. So a text has an expected grade and a tail probability, by which
documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexibridge.llm.arrays import code_points, mix64, slices, span_hashes, word_spans
from lexibridge.llm.common import bounded_sample, released

#: Dimensions of the two hashed families and number of plain measures.
SHAPES, WORDS, PLAIN = 2048, 2048, 6
#: Bound of the rated documents that the model is fitted on (documented parameter).
SAMPLE = 4000


def _shape_table() -> np.ndarray:
    """Code points by shape: letters by case, digits, blanks and line feeds fall together, signs stay apart."""
    table = np.arange(128, dtype=np.uint64)
    for c in range(128):
        s = chr(c)
        table[c] = 1 if s.islower() else 2 if s.isupper() else 3 if s.isdigit() else 4 if s == "\n" else 5 if s.isspace() else c
    return table


def features(texts: list[str]) -> np.ndarray:
    """float32 (texts, SHAPES + WORDS + PLAIN): square roots of shares of hashed 4-grams of character
    shapes and of hashed lower-cased words, and measures of repetition and length."""
    out = np.zeros((len(texts), SHAPES + WORDS + PLAIN), np.float32)
    points, offsets = code_points(texts)
    if not len(points):
        return out
    n, row = np.diff(offsets), np.repeat(np.arange(len(texts)), np.diff(offsets))
    shape = _shape_table()[np.minimum(points, 127)]
    wide = np.flatnonzero(points >= 128)
    if len(wide):
        kinds, back = np.unique(points[wide], return_inverse=True)
        shape[wide] = np.array([1 if chr(c).islower() else 2 if chr(c).isupper() else 127 for c in kinds], np.uint64)[back]
    if len(points) > 3:
        gram = mix64(shape[:-3] | shape[1:-2] << np.uint64(8) | shape[2:-1] << np.uint64(16) | shape[3:] << np.uint64(24))
        keep = row[:-3] == row[3:]
        flat = row[:-3] * SHAPES + (gram & np.uint64(SHAPES - 1)).astype(np.int64)
        grams = np.bincount(flat[keep], minlength=len(texts) * SHAPES).reshape(len(texts), SHAPES)
        out[:, :SHAPES] = np.sqrt(grams / np.maximum(grams.sum(1, keepdims=True), 1))
    lower = [t.lower() for t in texts]
    points, offsets = code_points(lower)
    starts, ends, own = word_spans(points, offsets)
    word = span_hashes(points, starts, ends)
    count = np.bincount(own, minlength=len(texts))
    words = np.bincount(own * WORDS + (word & np.uint64(WORDS - 1)).astype(np.int64), minlength=len(texts) * WORDS).reshape(len(texts), WORDS)
    out[:, SHAPES : SHAPES + WORDS] = np.sqrt(words / np.maximum(words.sum(1, keepdims=True), 1))
    plain = out[:, SHAPES + WORDS :]
    many = np.maximum(count, 1)
    if len(word) > 1:
        same = (word[1:] == word[:-1]) & (own[1:] == own[:-1])
        plain[:, 0] = np.bincount(own[1:][same], minlength=len(texts)) / many
        order = np.lexsort((word, own))
        first = np.ones(len(word), bool)
        first[1:] = (word[order][1:] != word[order][:-1]) | (own[order][1:] != own[order][:-1])
        distinct = np.bincount(own[order][first], minlength=len(texts))
        plain[:, 1] = 1 - distinct / many
    plain[:, 2] = np.log1p(count) / 10
    plain[:, 3] = np.bincount(own, weights=ends - starts, minlength=len(texts)) / many / 10
    plain[:, 4] = count == 0
    plain[:, 5] = np.log1p(n) / 10
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[str]) -> np.ndarray:
        """P(grade >= k) for k = 1.. in the columns; rows without text have 0."""
        score = features(texts) @ self.weights
        tails = 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -30, 30)))
        tails[[not t for t in texts]] = 0
        return tails


def fit(x: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 300, penalty: float = 1e-4) -> Model:
    """Maximum likelihood with a small ridge, by Adam on all rows; deterministic."""
    n, d = x.shape
    w, cuts = np.zeros(d), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(grades - 1)
    # Ordered thresholds: the first, and logarithms of the gaps.
    z = np.concatenate((cuts[:1], np.log(np.diff(cuts))))
    theta = np.concatenate((w, z))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1) if n else ():
        w, z = theta[:d], theta[d:]
        cuts = np.cumsum(np.concatenate((z[:1], np.exp(z[1:]))))
        s = x @ w.astype(np.float32)
        tail = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30)))
        bounds = np.concatenate((np.ones((n, 1)), tail, np.zeros((n, 1))), axis=1)
        slope = np.concatenate((np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))), axis=1)
        at = np.arange(n)
        p = np.maximum(bounds[at, grade] - bounds[at, grade + 1], 1e-12)
        upper, lower = slope[at, grade] / p, slope[at, grade + 1] / p
        of_score = -(upper - lower) / n
        of_cut = np.zeros(grades + 1)
        np.add.at(of_cut, grade, upper / n)
        np.add.at(of_cut, grade + 1, -lower / n)
        of_cut = of_cut[1:grades]
        below = np.cumsum(of_cut[::-1])[::-1]
        g = np.concatenate((x.T @ of_score.astype(np.float32) + penalty * w, below[:1], below[1:] * np.exp(z[1:])))
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        theta = theta - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    z = theta[d:]
    return Model(theta[:d], np.cumsum(np.concatenate((z[:1], np.exp(z[1:])))))


def grade(quality: Column, toxic: Column) -> Column:
    """The rating as a grade: 0 poor, 1 good but toxic, 2 good. Null marks count as 0."""
    return F.when(F.coalesce(quality, F.lit(0)) == 0, 0).when(F.coalesce(toxic, F.lit(0)) == 1, 1).otherwise(2)


GRADES = 3


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learn: Column | None = None) -> Model:
    """Fit on about `sample` rated documents, chosen by their hashed ids. learn: a condition on doc_id."""
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.lit(True) if learn is None else learn)).select(F.col("doc_id").cast("long").alias("doc_id"), grade(F.col("quality"), F.col("toxic")).alias("grade"))
    chosen = bounded_sample(rated, sample, "doc_id")
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("text").to_pylist()
            for start, stop in slices([len(t) for t in part]):
                x = features(part[start:stop])
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(start, stop - start), "grade": batch.column("grade").slice(start, stop - start), "x": pa.array([_sparse(v) for v in x], pa.binary())})

    # The chosen ratings are bounded by `sample`, and so is what comes back.
    got = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(released(run), "doc_id long, grade int, x binary").limit(4 * sample).collect()
    got.sort()
    x = np.zeros((len(got), SHAPES + WORDS + PLAIN), np.float32)
    for i, (_, _, v) in enumerate(got):
        at, value = np.frombuffer(v, "<u2", len(v) // 6), np.frombuffer(v, "<f4", offset=len(v) // 3) if len(v) else np.zeros(0)
        x[i, at] = value
    return fit(x, np.array([r[1] for r in got], np.int64), GRADES)


def _sparse(row: np.ndarray) -> bytes:
    at = np.flatnonzero(row)
    return at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes()


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every row of `docs`.

    tail_probability: P(grade >= 1), that the document is not poor; kept: it is at least `least`.
    A null or empty text has grade 0 and is not kept. Reads doc_id and text alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("text").to_pylist()
            for start, stop in slices([len(t) for t in part]):
                tails = model.tails(part[start:stop]).astype(float)
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(start, stop - start), "expected_grade": tails.sum(1), "tail_probability": tails[:, 0], "kept": tails[:, 0] >= least})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(released(run), "doc_id long, expected_grade double, tail_probability double, kept boolean")


def filter_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that a model learned from `labels` keeps."""
    model = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [t or "" for t in batch.column("text").to_pylist()]
            keep = np.zeros(len(part), bool)
            for start, stop in slices([len(t) for t in part]):
                keep[start:stop] = model.tails(part[start:stop])[:, 0] >= least
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(released(run), docs.schema)
