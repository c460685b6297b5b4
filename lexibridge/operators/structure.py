"""Alignment by structure: paragraphs, headings and table rows first, the units within them second."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexibridge.operators.alignment import by_progress


def structural_blocks(units: DataFrame) -> DataFrame:
    """`units` with `part`: the number, from 0, of the block that a unit belongs to within its pair and side.

    A block is a run of successive units of one block_type and block_index; of table cells, one of one row_index as well, so that
    rows are met whole before the cells within them.
    """
    order = Window.partitionBy("pair_id", "side").orderBy("unit_index")
    key = F.struct("block_type", "block_index", F.when(F.col("block_type") == "table_cell", F.col("row_index")).alias("row"))
    marked = units.withColumn("_key", key).withColumn("_new", (~F.col("_key").eqNullSafe(F.lag("_key").over(order))).cast("int"))
    return marked.withColumn("part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_key", "_new")


def _runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of both sides by progress for each row of keys and the two sides' sizes."""
    for part in parts:
        out = []
        for *keys, source, target in part.itertuples(index=False, name=None):
            source, target = ([] if x is None else list(x) for x in (source, target))
            if source and target:
                found = by_progress(source, target)
            else:  # one side has nothing: its units stand alone
                found = [(i, i + 1, 0, 0) for i in range(len(source))] + [(0, 0, j, j + 1) for j in range(len(target))]
            out += [(*keys, n, *f) for n, f in enumerate(found)]
        yield pd.DataFrame(out, columns=[*part.columns[:-2], "run", "s0", "s1", "t0", "t1"])


def _by_progress(sizes: DataFrame, keys: list[str], place: str) -> DataFrame:
    """(keys, run, s0, s1, t0, t1) of sizes (keys, side, place, size): only numbers come together, in order."""
    of = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct(place, "size")))), lambda x: x["size"]).alias(side)
    rows = sizes.groupBy(*keys).agg(of("source"), of("target"))
    return rows.mapInPandas(_runs, ", ".join(f"{k} long" for k in keys) + ", run int, s0 int, s1 int, t0 int, t1 int")


def _dealt(placed: DataFrame, runs: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The rows of `placed` with the run that holds their place on their side."""
    spread = runs.select(*keys, "run", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("s0").alias("low"), F.col("s1").alias("high")), F.struct(F.lit("target").alias("side"), F.col("t0").alias("low"), F.col("t1").alias("high")))).alias("r")).select(*keys, "run", "r.*").where("low < high")
    each = spread.select(*keys, "side", "run", F.explode(F.sequence("low", F.col("high") - 1)).alias(place))
    return placed.join(each, [*keys, "side", place])


def hierarchical_seed(units: DataFrame) -> DataFrame:
    """(pair_id, pair_order, src, tgt): units (pair_id, side, unit_index, text, block_type, block_index, row_index) in pairs by their shares
    of all characters, first block against block, then unit against unit within what blocks have met. Every unit is in one pair."""
    sized = structural_blocks(units).withColumn("size", F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)))
    blocks = sized.groupBy("pair_id", "side", "part").agg(F.sum("size").alias("size"))
    coarse = _by_progress(blocks.withColumn("part", F.col("part").cast("int")), ["pair_id"], "part")
    met = _dealt(sized.withColumn("part", F.col("part").cast("int")), coarse, ["pair_id"], "part").withColumnRenamed("run", "coarse")
    inner = Window.partitionBy("pair_id", "coarse", "side").orderBy("unit_index")
    numbered = met.withColumn("place", (F.row_number().over(inner) - 1).cast("int")).withColumn("coarse", F.col("coarse").cast("long"))
    fine = _by_progress(numbered.select("pair_id", "coarse", "side", "place", "size"), ["pair_id", "coarse"], "place")
    own = _dealt(numbered.select("pair_id", "coarse", "side", "place", "unit_index"), fine, ["pair_id", "coarse"], "place")
    members = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("unit_index"))))
    pairs = own.groupBy("pair_id", "coarse", "run").agg(members("source").alias("src"), members("target").alias("tgt"))
    order = F.row_number().over(Window.partitionBy("pair_id").orderBy("coarse", "run")) - 1
    return pairs.select("pair_id", order.cast("int").alias("pair_order"), "src", "tgt")
