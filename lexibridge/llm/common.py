"""Session plumbing shared by the operators."""

from __future__ import annotations

import ctypes
import math
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; where none is set, a temporary one, on a local session alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Compute `df` once and cut its lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(run: Run) -> Run:
    """`run`, after which the worker gives the memory of freed arrays back to the system.

    Workers are used again by the tasks and stages that follow; without it each holds what its largest task took.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return whole


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_number(value: Column, cuts: list[Column]) -> Column:
    """How many of the ascending `cuts` (literals) are at most `value`, looked for in two steps of about their root each."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    runs = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda some: F.size(F.filter(some, lambda c: c <= value))
    if len(runs) == 1:
        return below(F.array(*cuts))
    run = below(F.array(*[r[0] for r in runs[1:]]))
    return run * step + below(F.get(F.array(*[F.array(*r) for r in runs]), run))


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A table; with `spread`, one in no more partitions than the session has cores is dealt out to all of them.

    Files of a single row group would keep one core busy. A table large enough to fill the cluster is never moved.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not spread:
        return rows
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() <= cores else rows


def bounded_sample(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """About `n` of the rows, at most 2n, or all if there are fewer: those whose hashed keys are low.

    Which rows are taken depends on their keys alone. One count of the rows sets the bar; no
    task or driver ever holds more than the sample.
    """
    total = rows.count()
    if total <= n:
        return rows
    bar = int(n / total * 2**63) - 1
    return rows.where(F.shiftrightunsigned(F.xxhash64(*keys), 1) <= bar).limit(2 * n)
