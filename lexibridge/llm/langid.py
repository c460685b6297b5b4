"""Language identification by the nearest of several centroids per language.

A text is the TF-IDF vector of its hashed letter n-grams (one to three lower-cased
characters, damped counts, unit length). Each language owns a few centroids found by
spherical k-means; a text takes the language of the centroid of greatest cosine, and is
rejected where even that one is further away than nearly all training texts of the
language were from theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexibridge.llm.arrays import code_points, slices, word_table
from lexibridge.llm.common import released

DIMENSIONS = 4096
CENTROIDS = 4
#: Bound of the labelled rows that the model is fitted on (documented parameter).
SAMPLE = 4000
#: Rows that a language of as many or more gives to the sample at least.
FLOOR = 40
#: A text is rejected below this share of the least cosine that a language's training texts had.
REJECT = 0.5


def ngram_counts(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of every text: float32 (texts, dimensions)."""
    points, offsets = code_points([t.lower() for t in texts])
    counts = np.zeros((len(texts), dimensions), np.float32)
    if not len(points):
        return counts
    # Letters stand for themselves and everything else for one blank.
    inside = word_table()[points] & ~((points >= 48) & (points <= 57))
    signs = np.where(inside, points, 32).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.uint32), np.diff(offsets))
    shift = np.uint32(32 - int(dimensions).bit_length() + 1)
    hashed = signs * np.uint32(0x9E3779B1)
    for width in (1, 2, 3):
        if width > 1:
            if len(points) < width:
                break
            hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + signs[width - 1 :] * np.uint32(0x9E3779B1)
        own = row[: len(points) - width + 1]
        keep = own == row[width - 1 :]
        cell = ((hashed ^ (hashed >> np.uint32(13))) * np.uint32(0xC2B2AE3D)) >> shift
        flat = own.astype(np.int64) * dimensions + cell
        counts += np.bincount(flat[keep], minlength=len(texts) * dimensions).reshape(counts.shape)
    return counts


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    owner: np.ndarray  # language number of each centroid
    languages: list[str]
    least: np.ndarray  # rejection cosine of each language

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(language number, cosine) of the nearest centroid of each text."""
        cosine = self.vectors(ngram_counts(texts, len(self.idf))) @ self.centroids.T
        best = cosine.argmax(axis=1)
        return self.owner[best], np.clip(cosine[np.arange(len(best)), best], 0, 1)


def fit(texts: list[str], languages: list[str], centroids: int = CENTROIDS, rounds: int = 12) -> Model:
    """Fit on labelled texts. One language or more; a language with few texts gets fewer centroids."""
    counts = np.concatenate([ngram_counts(texts[a:b]) for a, b in slices([len(t) for t in texts])]) if texts else np.zeros((0, DIMENSIONS), np.float32)
    idf = (np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    names = sorted(set(languages))
    model = Model(idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64), names, np.zeros(len(names)))
    x, label = model.vectors(counts), np.array([names.index(n) for n in languages], np.int64)
    rows, owner = [], []
    for k in range(len(names)):
        own = x[label == k]
        # Farthest-first seeds from the mean, then spherical k-means.
        seeds = [int((own @ own.mean(0)).argmax())]
        while len(seeds) < min(centroids, len(own)):
            seeds.append(int((own @ own[seeds].T).max(1).argmin()))
        mid = own[seeds]
        for _ in range(rounds):
            near = (own @ mid.T).argmax(1)
            sums = np.stack([own[near == j].sum(0) if (near == j).any() else mid[j] for j in range(len(mid))])
            mid = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        rows.append(mid)
        owner += [k] * len(mid)
        model.least[k] = REJECT * np.quantile((own @ mid.T).max(1), 0.01)
    if rows:
        model.centroids, model.owner = np.concatenate(rows).astype(np.float32), np.array(owner)
    return model


def sample_level(counts: list[int], sample: int) -> int:
    """Rows of each language that fill about `sample` rows if smaller languages give all of theirs; FLOOR at least."""
    left, level = sample, 0
    for k, n in enumerate(sorted(counts)):
        level = left // (len(counts) - k)
        if n > level:
            break
        left -= n
    return max(level, FLOOR)


def language_sample(rows: DataFrame, sample: int) -> DataFrame:
    """About `sample` of the rows, or about FLOOR of each language if that is more; at most twice as many.

    Languages of few rows are kept whole and the others share what is left evenly, by low hashes of
    id and text, so that no language is lost as the table grows.
    """
    draw = F.xxhash64("doc_id", "text")
    # Repeated rows share a hash, so they count and are drawn once.
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct(draw)).collect()}
    level = sample_level(list(counts.values()), sample)
    large = {g: n for g, n in counts.items() if n > level}
    if not large:
        return rows.distinct()
    bars = F.create_map(*[F.lit(x) for g, n in large.items() for x in (g, int(level / n * 2**63) - 1)])
    low = F.shiftrightunsigned(draw, 1) <= F.element_at(bars, F.col("lang"))
    return rows.where(F.coalesce(low, F.lit(True))).distinct()


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """Fit on about `sample` documents for which `learn` holds, drawn by language."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    got = sorted(tuple(r) for r in language_sample(rows, sample).select("lang", "text").collect())
    return fit([r[1] for r in got], [r[0] for r in got])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's decimal text leaves remainder 0 by 5; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of `docs`, in no order.

    lang_pred: a learned language; `und` with score 0 if the text is null or holds no letter, or
    if no language was learned. score: cosine to the nearest centroid. rejected: `und`, or too
    far from all centroids. Reads doc_id and text alone.
    """
    names, least = np.array([*model.languages, "und"], object), np.append(model.least, 2.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, stop in slices([len(t) for t in texts]):
                part = texts[start:stop]
                if len(model.centroids):
                    best, score = model.predict(part)
                else:
                    best, score = np.full(len(part), len(names) - 1), np.zeros(len(part))
                none = np.array([not letters(t) for t in part], bool)
                best, score = np.where(none, len(names) - 1, best), np.where(none, 0.0, score).astype(float)
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(start, stop - start), "lang_pred": pa.array(names[best], pa.string()), "score": score, "rejected": score < least[best]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(released(run), "doc_id long, lang_pred string, score double, rejected boolean")


def _letters():
    """A test for any letter in a text: categories L*, so no numbers such as superscripts and fractions."""
    import regex

    return regex.compile(r"\p{L}").search


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Languages of all `docs` by a model learned from those that are not held out:
    (doc_id, held_out, lang_pred, score, rejected)."""
    model = train(docs, ~held_out(F.col("doc_id")), sample)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def filter_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` whose text some learned language is near to."""
    model = train(docs, ~held_out(F.col("doc_id")), sample)
    names, least = model.languages, model.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keep = np.zeros(len(texts), bool)
            for start, stop in slices([len(t) for t in texts]):
                if names:
                    best, score = model.predict(texts[start:stop])
                    keep[start:stop] = (score >= least[best]) & np.array([bool(letters(t)) for t in texts[start:stop]])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(released(run), docs.schema)
