"""Tables kept as deltas: a batch adds its own rows, reading merges, compaction rewrites what has changed.

A table at `path` holds `delta=N/bucket=K` folders, one delta a batch, and `base=N/bucket=K` folders, which hold all deltas up to
batch N for their bucket. A key belongs to one bucket by its hash. A batch that is repeated writes its delta anew, and
one that a base already holds is not written again, so repeated and late batches change nothing that they should not. Rows keep the
column that orders them; an older row that comes late loses against a newer one wherever they meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKETS = 64


def _folders(spark: SparkSession, path: str, kind: str) -> dict[int, list[int]]:
    """Complete folders of a kind by number, each with its buckets, from the table's own file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for folder in fs.listStatus(root) if fs.exists(root) else []:
        name = folder.getPath().getName()
        if name.startswith(f"{kind}=") and fs.exists(hadoop.Path(folder.getPath(), "_SUCCESS")):
            inner = [s.getPath().getName() for s in fs.listStatus(folder.getPath())]
            found[int(name.split("=")[1])] = sorted(int(n.split("=")[1]) for n in inner if n.startswith("bucket="))
    return found


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def latest(keys: list[str], order: str) -> Callable[[DataFrame], DataFrame]:
    """Merges rows to the last one of each key; rows of one order go by their values, whichever comes first."""

    def merge(rows: DataFrame) -> DataFrame:
        value = [c for c in rows.columns if c not in (*keys, order)]
        best = rows.groupBy(*keys).agg(F.max(F.struct(order, *value)).alias("_best"))
        return best.select(*[c if c in keys else F.col(f"_best.{c}").alias(c) for c in rows.columns])

    return merge


def summed(keys: list[str], *counters: str) -> Callable[[DataFrame], DataFrame]:
    """Merges signed counters by adding them up; keys whose counters are all 0 again are left out."""

    def merge(rows: DataFrame) -> DataFrame:
        added = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
        some = F.lit(False)
        for c in counters:
            some |= F.col(c) != 0
        return added.where(some)

    return merge


def writer(path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds every batch, merged within itself, as a delta."""

    def add(batch: DataFrame, number: int) -> None:
        bases = _folders(batch.sparkSession, path, "base")
        if number <= max(bases, default=-1):
            return  # held by a base already
        merge(batch).withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").sortWithinPartitions(*keys).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/delta={number}")

    return add


def _live(spark: SparkSession, path: str) -> tuple[dict[int, list[int]], list[int]]:
    """The bases that hold the newest form of some bucket, with these buckets, and the deltas that no base holds."""
    bases = _folders(spark, path, "base")
    newest: dict[int, int] = {}
    for number in sorted(bases):
        newest |= dict.fromkeys(bases[number], number)
    by_base: dict[int, list[int]] = {}
    for bucket, number in newest.items():
        by_base.setdefault(number, []).append(bucket)
    return by_base, sorted(n for n in _folders(spark, path, "delta") if n > max(bases, default=-1))


def _rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    by_base, deltas = _live(spark, path)
    read = lambda folder: spark.read.schema(schema).parquet(folder)
    parts = [read(f"{path}/base={n}").where(F.col("bucket").isin(buckets)) for n, buckets in by_base.items()] + [read(f"{path}/delta={n}") for n in deltas]
    rows = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def _schema(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("bucket", IntegerType())])


def read(spark: SparkSession, path: str, schema: StructType, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table as it is now: bases and the deltas since, merged. Rows of one key lie in one bucket, in every part."""
    return merge(_rows(spark, path, _schema(schema)).drop("bucket"))


def compact(spark: SparkSession, path: str, schema: StructType, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> int | None:
    """Fold all deltas into a new base and give its number; only buckets that some delta touches are written.

    Readers go on with the old parts until the new base is complete. Nothing is removed here (see `obsolete`). A touched bucket whose
    rows have all cancelled out is written as an empty one.
    """
    held = _folders(spark, path, "delta")
    _, deltas = _live(spark, path)
    if not deltas:
        return None
    touched = sorted({b for n in deltas for b in held[n]})
    rows = merge(_rows(spark, path, _schema(schema)).where(F.col("bucket").isin(touched)).drop("bucket")).withColumn("bucket", _bucket(keys, buckets))
    number = max(deltas)
    rows.repartition("bucket").sortWithinPartitions(*keys).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/base={number}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket in touched:
        fs.mkdirs(hadoop.Path(f"{path}/base={number}/bucket={bucket}"))
    return number


def obsolete(spark: SparkSession, path: str) -> list[str]:
    """Folders that no reader of the present table needs: deltas that a base holds, bases without a live bucket."""
    bases, deltas = _folders(spark, path, "base"), _folders(spark, path, "delta")
    by_base, _ = _live(spark, path)
    return [f"{path}/delta={n}" for n in sorted(deltas) if n <= max(bases, default=-1)] + [f"{path}/base={n}" for n in sorted(bases) if n not in by_base]
