"""A vector index: cells around centroids, searched by proven bounds, so that results are exact.

Centroids are fitted on a bounded sample; every entry is indexed. For vectors of length one a cell's farthest entry and the triangle
inequality bound the cosine that any of its entries can reach with a query. A query first looks into its most promising cells, then into every
other cell whose bound is not below the score that its last wanted result has by then. Skipped cells hold nothing better.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexibridge.operators.graphs import cut

#: Vectors that centroids are fitted on at most, for each cell; cells at most; entries that one task meets at once.
SAMPLE, CELLS, BLOCK = 64, 1024, 4096
ROUNDS = 8
#: What rounding may add to a computed distance or cosine.
SLACK = 1e-9


@dataclass
class Index:
    """centroids: at most CELLS rows; entries: (cell, block, entry_id, vector); cells: (cell, blocks, n, radius)."""

    centroids: np.ndarray
    entries: DataFrame
    cells: DataFrame


def _units(rows: DataFrame, key: str) -> DataFrame:
    """(key, vector of length one); vectors that are null, zero, or hold a null or no finite number are left out."""
    vector = F.transform("vector", lambda x: x.cast("double"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # Scaled by the largest component first: squares of extreme numbers overflow or vanish.
    top = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    scaled = rows.select(F.col(key), vector.alias("vector")).where(sound).withColumn("top", top).where("top > 0").select(key, F.transform("vector", lambda x: x / F.col("top")).alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return scaled.withColumn("norm", norm).select(key, F.transform("vector", lambda x: x / F.col("norm")).alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def fit(units: DataFrame, key: str, cells: int) -> np.ndarray:
    """Centroids by spherical k-means on at most SAMPLE * cells vectors, those whose hashed ids are low."""
    rows = units.orderBy(F.xxhash64(key)).limit(SAMPLE * cells).select("vector").collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r.vector for r in rows])
    centres = x[np.random.default_rng(0).permutation(len(x))[: min(cells, len(x))]]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            held = x[own == c].sum(0)
            if np.linalg.norm(held) > SLACK:
                centres[c] = held / np.linalg.norm(held)
    return centres


def build(entries: DataFrame, cells: int | None = None) -> Index:
    """Index all of `entries` (entry_id, vector); cells: by default the root of their number, at most CELLS."""
    units = cut(_units(entries, "entry_id"))
    centres = fit(units, "entry_id", cells or max(1, min(CELLS, int(units.count() ** 0.5))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column("vector")) @ centres.T
                own = near.argmax(1)
                far = np.sqrt(np.maximum(2 - 2 * near[np.arange(len(own)), own], 0)) + SLACK
                yield pa.record_batch([pa.array(own, pa.int64()), batch.column("entry_id"), batch.column("vector"), pa.array(far)], names=["cell", "entry_id", "vector", "far"])

    placed = cut(units.mapInArrow(place, "cell long, entry_id long, vector array<double>, far double"))
    sizes = cut(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("blocks", F.ceil(F.col("n") / BLOCK)))
    # A cell of many entries is several tasks' work.
    dealt = placed.join(sizes.select("cell", "blocks"), "cell").select("cell", F.pmod(F.xxhash64("entry_id"), F.col("blocks")).alias("block"), "entry_id", "vector")
    return Index(centres, cut(dealt), sizes)


def _bounds(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, cell, bound) for every query and cell: the cells are few, and the pairs hold no vectors."""
    centres = index.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                away = np.sqrt(np.maximum(2 - 2 * (_matrix(part.column("vector")) @ centres.T), 0))
                ids = np.repeat(part.column("query_id").to_numpy(), len(centres))
                yield pa.record_batch([pa.array(ids), pa.array(np.tile(np.arange(len(centres)), part.num_rows)), pa.array(away.reshape(-1))], names=["query_id", "cell", "away"])

    away = queries.mapInArrow(run, "query_id long, cell long, away double")
    least = F.greatest(F.col("away") - F.col("radius") - SLACK, F.lit(0.0))
    return away.join(index.cells, "cell").select("query_id", "cell", "blocks", "n", (1 - least * least / 2).alias("bound"))


def _scored(asked: DataFrame, queries: DataFrame, index: Index, floor: float, recall: int) -> DataFrame:
    """The best few entries of each asked block for each query that asks it: (query_id, entry_id, score)."""
    to = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("query_id", "cell", "block")
    seekers = to.join(queries, "query_id").select("cell", "block", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "vector")
    # Only blocks that somebody asks for move.
    held = index.entries.join(to.select("cell", "block").distinct(), ["cell", "block"], "left_semi").select("cell", "block", F.lit(0).alias("kind"), F.col("entry_id").alias("id"), "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, ids, vectors = None, [], None, None
        for batch in batches:
            cell, block, kind = (batch.column(c).to_numpy() for c in ("cell", "block", "kind"))
            edges = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if start == stop:
                    continue
                rows = batch.slice(start, stop - start)
                if (cell[start], block[start]) != key:
                    key, parts, ids = (cell[start], block[start]), [], None
                if kind[start] == 0:
                    parts.append(rows)
                    continue
                if ids is None:
                    ids = np.concatenate([p.column("id").to_numpy() for p in parts])
                    vectors = np.concatenate([_matrix(p.column("vector")) for p in parts])
                yield from _best(rows, ids, vectors, floor, recall)

    both = held.unionByName(seekers).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    return both.mapInArrow(run, "query_id long, entry_id long, score double")


def _best(rows: pa.RecordBatch, ids: np.ndarray, vectors: np.ndarray, floor: float, recall: int) -> Iterator[pa.RecordBatch]:
    asked = rows.column("id").to_numpy()
    for start in range(0, len(asked), 256):
        some = asked[start : start + 256]
        q = _matrix(rows.column("vector").slice(start, len(some)))
        out: tuple[list, list, list] = ([], [], [])
        for k, near in enumerate(q @ vectors.T):
            near[ids == some[k]] = -2
            least = max(floor, np.partition(near, -recall)[-recall] if len(near) > recall else -1.5) - SLACK
            at = np.flatnonzero(near >= least)
            # One sum a row, always in the same order, so that equal vectors score alike wherever they lie.
            score = (vectors[at] * q[k]).sum(1)
            at, score = at[score >= floor], score[score >= floor]
            out[0].extend([int(some[k])] * len(at))
            out[1].extend(ids[at].tolist())
            out[2].extend(score.tolist())
        yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "entry_id", "score"])


def nearest(queries: DataFrame, index: Index, floor: float = 0.45, recall: int = 6, first: int = 3) -> DataFrame:
    """The `recall` nearest entries of each query (query_id, vector) by cosine, from `floor` up: query_id, entry_id, score, rank.

    Exact: equal to meeting all entries. An entry of the query's own id is no result. Equal scores go by entry_id.
    first: cells that a query looks into before the others are judged; it does not change the result.
    """
    units = cut(_units(queries, "query_id"))
    bounds = cut(_bounds(units, index))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
    ranked = bounds.withColumn("place", F.row_number().over(order))
    early = ranked.where((F.col("place") <= first) & (F.col("bound") >= floor))
    found = cut(_top(_scored(early, units, index, floor, recall), recall))
    bar = found.where(F.col("rank") == recall).select("query_id", F.col("score").alias("bar"))
    late = ranked.where(F.col("place") > first).join(bar, "query_id", "left").where(F.col("bound") >= F.coalesce("bar", F.lit(floor)) - SLACK)
    return _top(found.drop("rank").unionByName(_scored(late, units, index, floor, recall)), recall)


def _top(scored: DataFrame, recall: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= recall)
