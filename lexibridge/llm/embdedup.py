"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is turned by random rotations and keeps the signs: a binary code of which
each bit agrees with another vector's with a probability that only the angle decides.
Runs of code bits are bucket keys; their number follows from the wanted recall and their
width from the number of vectors, so that recall is the same at every size. Within a
bucket the code and its stored correction factor (the code's inner product with its own
vector) give an unbiased estimate of the inner product and a confidence bound; only pairs
whose bound reaches the threshold are recomputed exactly, in double precision.

Equal vectors of one label are one class with a count. Buckets larger than a block are
dealt out in pairs of blocks. A pair is emitted by the first bucket that holds both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibridge.llm.common import materialise
from lexibridge.llm.components import components

#: Probability that a pair at the threshold shares no bucket.
MISS = 1e-5
#: Standard deviations of the estimate that the bound allows for.
SIGMAS = 5.0
BLOCK = 2048


@cache
def rotations(dimension: int, count: int) -> np.ndarray:
    """`count` random rotations of the space, always the same: (count * dimension, dimension)."""
    random = np.random.Generator(np.random.PCG64(20240131 + dimension))
    return np.concatenate([np.linalg.qr(random.standard_normal((dimension, dimension)))[0] for _ in range(count)]).astype(np.float32)


def tables_for(bits: int, threshold: float) -> int:
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log1p(-agree))


def _tamed(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near one: no rounding, and squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(1, initial=0.0))
    return np.ldexp(vectors, -exponent[:, None])


class Codes:
    """Codes, correction factors and bucket keys of unit row vectors."""

    def __init__(self, unit: np.ndarray, bits: int, tables: int):
        n, d = unit.shape
        self.turned = unit.astype(np.float32) @ rotations(d, -(-bits * tables // d)).T
        self.signs = np.where(self.turned >= 0, np.float32(1), np.float32(-1))
        self.factor = np.abs(self.turned).sum(1)  # <code, turned vector>
        own = (self.turned[:, : bits * tables] >= 0).reshape(n, tables, bits)
        self.keys = own.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
        # Spread of the estimate about the true product of unit vectors, by the part of the vector
        # that the code misses.
        width = self.turned.shape[1]
        copies = width / d
        quality = self.factor / (math.sqrt(width) * math.sqrt(copies))
        self.error = (np.sqrt(np.maximum(1 - quality**2, 0)) / np.maximum(quality, 1e-6) / math.sqrt(max(width - 1, 1))).astype(np.float32)

    def bound(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Upper confidence bound of the inner products of rows x with rows y, pair by pair."""
        estimate = np.einsum("ij,ij->i", self.signs[x], self.turned[y]) / np.maximum(self.factor[x], 1e-6)
        return estimate + SIGMAS * self.error[x]

    def bounds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The same for all pairs of rows x with rows y."""
        return self.signs[x] @ self.turned[y].T / np.maximum(self.factor[x], 1e-6)[:, None] + SIGMAS * self.error[x][:, None]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _tamed(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _buckets(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pa.compute.list_value_length(whole.column("vector")).to_numpy(zero_copy_only=False)
            for length in np.unique(sizes):
                batch = whole.take(pa.array(np.flatnonzero(sizes == length)))
                keys = Codes(_unit(_matrix(batch.column("vector"))), bits, tables).keys
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables)
                yield pa.record_batch({"id": batch.column("id"), "label": batch.column("label"), "vector": batch.column("vector"), "keys": pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))})

    return run


def _links(bits: int, tables: int, threshold: float):
    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by length first; vectors of one length are one matrix."""
        lengths = t.column("length").to_numpy()
        ends = np.append(np.flatnonzero(np.diff(lengths)) + 1, len(lengths))
        for begin, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            yield from one(t.slice(begin, end - begin))

    def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, table = t.column("id").to_numpy(), t.column("band").to_numpy()
        block, alone = t.column("block").to_numpy(), t.column("i").to_numpy() == t.column("j").to_numpy()
        vectors = _matrix(t.column("vector"))
        vectors = _tamed(vectors)
        norm = np.linalg.norm(vectors, axis=1)
        codes = Codes(vectors / norm[:, None], bits, tables)
        # The keys that rows were dealt by: worked out anew, a sign could turn in the last bit.
        keys = np.array(t.column("keys").to_pylist(), np.int64)
        name = np.stack([t.column(c).to_numpy() for c in ("label", "band", "key", "i", "j")])
        new = np.ones(t.num_rows, bool)
        new[1:] = (name[:, 1:] != name[:, :-1]).any(0)
        group = np.cumsum(new) - 1
        sizes = np.bincount(group)
        begin = np.flatnonzero(new)

        def exact(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            earlier = np.arange(tables) < table[x][:, None]
            fresh = ~((keys[x] == keys[y]) & earlier).any(1) & (alone[x] | (block[x] != block[y]))
            x, y = x[fresh], y[fresh]
            near = np.einsum("ij,ij->i", vectors[x], vectors[y]) / (norm[x] * norm[y]) >= threshold
            if near.any():
                a, b = ids[x[near]], ids[y[near]]
                yield pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

        at = np.flatnonzero(sizes[group] <= 64)
        for d in range(1, 64):
            at = at[sizes[group[at]] > d]
            x = at[at - begin[group[at]] + d < sizes[group[at]]]
            for s in range(0, len(x), 1 << 14):
                p = x[s : s + (1 << 14)]
                p = p[codes.bound(p, p + d) >= threshold]
                yield from exact(p, p + d)
        for g in np.flatnonzero(sizes > 64):
            for s in range(0, sizes[g], 512):
                x = np.arange(begin[g] + s, begin[g] + min(s + 512, sizes[g]))
                y = np.arange(begin[g] + s, begin[g] + sizes[g])
                i, j = np.nonzero(codes.bounds(x, y) >= threshold)
                ahead = x[i] < y[j]
                for p in np.array_split(np.flatnonzero(ahead), ahead.sum() // (1 << 14) + 1):
                    yield from exact(x[i[p]], y[j[p]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        names = ("length", "label", "band", "key", "i", "j")
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
            if not t.num_rows:
                continue
            # The last group may go on in the next batch.
            key = np.stack([t.column(c).to_numpy() for c in names])
            other = np.flatnonzero((key != key[:, -1:]).any(0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from work(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from work(rest)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Vectors of equal, non-null label are linked if their cosine in double precision is at least
    `threshold`. n_links: other vectors linked directly; component_id: least vec_id reachable by
    links; kept: vec_id = component_id. Vectors that are null, zero, or hold null or non-finite
    components, vectors of no label, and vectors of different lengths are linked with nothing.
    Repeated rows count once; rows without a vec_id are left out. Reads vec_id, embedding and label.
    """
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector")).distinct()
    sound = F.col("label").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    marked = materialise(rows.withColumn("sound", F.coalesce(sound, F.lit(False))))
    classes = materialise(marked.where("sound").groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    bits = min(max(math.ceil(math.log2(most + 1)), 8), 40)
    tables = tables_for(bits, threshold)
    own = classes.select("id", "label", "vector")
    keyed = own.mapInArrow(_buckets(bits, tables), "id long, label long, vector array<double>, keys array<long>").withColumn("length", F.size("vector"))
    placed = keyed.select("id", "length", "label", "vector", "keys", F.posexplode("keys").alias("band", "key"))
    bucket = ["length", "label", "band", "key"]
    full = materialise(placed.select(*bucket)).groupBy(*bucket).agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = (
        placed.join(full, bucket)
        .withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(*bucket, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "vector", "keys")
        .repartition(*bucket, "i", "j")
        .sortWithinPartitions(*bucket, "i", "j")
    )
    links = materialise(dealt.mapInArrow(_links(bits, tables, threshold), "a long, b long").distinct())
    groups = components(links)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    count = both.join(classes.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    known = classes.join(groups, "id", "left").join(count, "id", "left").select("label", "vector", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    result = marked.join(known.withColumn("sound", F.lit(True)), ["sound", "label", "vector"], "left")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))
