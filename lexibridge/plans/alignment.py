"""Alignment queries: a user turn against the assistant's answer, sentence by sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibridge.functions import similarity as S
from lexibridge.operators import alignment as A
from lexibridge.operators import structure as ST
from lexibridge.plans import views as V
from lexibridge.plans.registry import query


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = V.bilingual(spark, sf_dir).withColumn("pair_id", F.col("conv_id") * 1000 + F.col("turn"))
    # Both sides in one go, so that turns are joined once.
    side = lambda name, c: F.coalesce(F.transform(F.filter(F.split(c, "[\n.]+"), lambda x: F.trim(x) != ""), lambda x, i: F.struct(F.lit(name).alias("side"), i.alias("unit_index"), F.trim(x).alias("text"))), F.array())
    return pairs.select("pair_id", F.explode(F.concat(side("source", "source_text"), side("target", "target_text"))).alias("u")).select("pair_id", "u.*")


_UNITS_SQL = rf"""{V.BILINGUAL_SQL}, units AS (SELECT pair_id, side, generate_subscripts(t, 1) - 1 AS unit_index, unnest(list_transform(t, lambda x: trim(x))) AS text FROM (
SELECT conv_id * 1000 + turn AS pair_id, 'source' AS side, list_filter(string_split_regex(source_text, '[\n.]+'), lambda x: trim(x) <> '') AS t FROM bilingual UNION ALL
SELECT conv_id * 1000 + turn, 'target', list_filter(string_split_regex(target_text, '[\n.]+'), lambda x: trim(x) <> '') FROM bilingual))"""


@query()
def align_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.align(units(spark, sf_dir)).withColumn("level", A.level(F.col("confidence")))


@query(f"WITH {_UNITS_SQL} SELECT side, count(*) AS units, CAST(0 AS BIGINT) AS broken FROM units GROUP BY side")
def align_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by side, and those that the alignment does not hold exactly once: none."""
    own = units(spark, sf_dir)
    broken = A.integrity(own, A.align(own)).groupBy("side").agg(F.count("*").alias("broken"))
    return own.groupBy("side").agg(F.count("*").alias("units")).join(broken, "side", "left").select("side", "units", F.coalesce("broken", F.lit(0)).cast("long").alias("broken"))


@query(rf"""WITH {_UNITS_SQL}, k AS (SELECT pair_id, side, lower(text) AS key, count(*) AS n, min(unit_index) AS i FROM units GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT a.pair_id, CAST(a.i AS BIGINT) AS s, CAST(b.i AS BIGINT) AS t FROM k a JOIN k b ON a.side = 'source' AND b.side = 'target' AND a.pair_id = b.pair_id AND a.key = b.key""")
def align_exact_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.candidate_anchors(units(spark, sf_dir)).where("weight = 110").select("pair_id", F.col("s").cast("long").alias("s"), F.col("t").cast("long").alias("t"))


@query(rf"""WITH {_UNITS_SQL}, r AS (SELECT side, regexp_matches(text, '^[0-9]{{1,4}}$') OR (length(text) <= 60 AND count(*) OVER (PARTITION BY pair_id, side, lower(text)) >= 2) AS running FROM units)
SELECT side, count(*) FILTER (WHERE running) AS running, count(*) AS units FROM r GROUP BY side""")
def running_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.running_matter(units(spark, sf_dir)).groupBy("side").agg(F.count_if("running").alias("running"), F.count("*").alias("units"))


@query(rf"""WITH {_UNITS_SQL}, k AS (SELECT pair_id, side, regexp_extract(CASE WHEN (unit_index + pair_id) % 3 = 0 THEN '2.' || (unit_index // 2 + 1) || ') ' || text ELSE text END, '^([0-9]+(?:\.[0-9]+){{0,5}})(?:[.)、]|\s)', 1) AS key, unit_index FROM units), f AS (SELECT pair_id, side, key, min(unit_index) AS i FROM k WHERE key <> '' GROUP BY 1, 2, 3)
SELECT a.pair_id, a.key, CAST(a.i AS BIGINT) AS s, CAST(b.i AS BIGINT) AS t FROM f a JOIN f b ON a.pair_id = b.pair_id AND a.key = b.key AND a.side = 'source' AND b.side = 'target'""")
def align_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some of the units numbered."""
    i = F.col("unit_index")
    numbered = F.when((i + F.col("pair_id")) % 3 == 0, F.concat(F.lit("2."), F.floor(i / 2) + 1, F.lit(") "), "text")).otherwise(F.col("text"))
    return A.aligned_by_number(units(spark, sf_dir).withColumn("text", numbered)).select("pair_id", "key", F.col("s").cast("long").alias("s"), F.col("t").cast("long").alias("t"))


@query(rf"""WITH {_UNITS_SQL}, c AS (SELECT pair_id, side, unit_index // 6 AS tab, unit_index % 6 // 2 AS "row", unit_index % 2 AS cell, unit_index FROM units), sh AS (SELECT pair_id, side, tab, max("row") AS r, max(cell) AS c, count(*) AS n FROM c GROUP BY 1, 2, 3),
m AS (SELECT a.pair_id, a.tab FROM sh a JOIN sh b ON a.side = 'source' AND b.side = 'target' AND a.pair_id = b.pair_id AND a.tab = b.tab AND a.r = b.r AND a.c = b.c AND a.n = b.n)
SELECT pair_id, CAST(unit_index AS BIGINT) AS s, CAST(unit_index AS BIGINT) AS t FROM c JOIN m USING (pair_id, tab) WHERE side = 'source'""")
def align_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units taken for cells of tables of three rows and two columns."""
    i = F.col("unit_index")
    cells = units(spark, sf_dir).select("pair_id", "side", F.floor(i / 6).alias("table"), F.floor(i % 6 / 2).alias("row"), (i % 2).alias("cell"), "unit_index")
    return A.table_anchors(cells).select("pair_id", F.col("s").cast("long").alias("s"), F.col("t").cast("long").alias("t"))


@query(rf"""WITH {_UNITS_SQL}, t AS (SELECT pair_id, side, string_agg(text, ' ' ORDER BY unit_index) AS text FROM units GROUP BY 1, 2) SELECT pair_id, coalesce(max(text) FILTER (WHERE side = 'source'), '') AS source_text, coalesce(max(text) FILTER (WHERE side = 'target'), '') AS target_text FROM t GROUP BY 1""")
def aligned_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments made of all pairs, put together again in order: the texts of both sides, nothing lost."""
    own = units(spark, sf_dir)
    made = A.pair_segments(A.align(own, repair=True), own, spark.createDataFrame([], "pair_id long, pair_order int"))
    joined = lambda c: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pair_order", c))), lambda x: x[c]), lambda t: t != ""), " ").alias(c)
    return made.groupBy("pair_id").agg(joined("source_text"), joined("target_text"))


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units as paragraphs of four, of which every third is a table of two rows."""
    i = F.col("unit_index")
    kind = F.when(F.floor(i / 4) % 3 == 2, "table_cell").otherwise("paragraph")
    return units(spark, sf_dir).withColumns({"block_type": kind, "block_index": F.floor(i / 4), "row_index": F.floor(i % 4 / 2)})


_STRUCTURED_SQL = f"""{_UNITS_SQL}, structured AS (SELECT *, CASE WHEN unit_index // 4 % 3 = 2 THEN 'table_cell' ELSE 'paragraph' END AS block_type FROM units)"""


@query(f"WITH {_STRUCTURED_SQL} SELECT pair_id, side, CAST(unit_index AS BIGINT) AS unit_index, CAST(unit_index // 4 + unit_index // 12 + CASE WHEN unit_index // 4 % 3 = 2 THEN unit_index % 4 // 2 ELSE 0 END AS BIGINT) AS part FROM structured")
def structural_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of every unit: three blocks of a dozen units, the last of two rows."""
    return ST.structural_blocks(_structured(spark, sf_dir)).select("pair_id", "side", F.col("unit_index").cast("long").alias("unit_index"), F.col("part").cast("long").alias("part"))


@query(f"WITH {_UNITS_SQL} SELECT pair_id, side, list_aggregate(list_sort(list(unit_index)), 'string_agg', ',') AS units FROM units GROUP BY pair_id, side")
def hierarchical_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of all pairs by structure, in the order of the pairs: each once and none out of order."""
    seed = ST.hierarchical_seed(_structured(spark, sf_dir))
    side = lambda name, c: seed.select("pair_id", F.lit(name).alias("side"), "pair_order", F.col(c).alias("held")).where(F.size("held") > 0)
    both = side("source", "src").unionByName(side("target", "tgt"))
    return both.groupBy("pair_id", "side").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pair_order", "held"))), lambda x: x.held)), ",").alias("units"))


@query(f"WITH {_UNITS_SQL} SELECT pair_id, CAST(unit_index AS BIGINT) AS s, CAST(unit_index AS BIGINT) AS t FROM units WHERE side = 'source'")
def align_same_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text against itself, with vectors: each unit meets itself."""
    own = units(spark, sf_dir).where("side = 'source'").withColumn("vector", S.hashed_embedding("text"))
    pairs = A.align(own.unionByName(own.withColumn("side", F.lit("target"))))
    return pairs.select("pair_id", F.explode(F.arrays_zip("src", "tgt")).alias("u")).select("pair_id", F.col("u.src").cast("long").alias("s"), F.col("u.tgt").cast("long").alias("t"))
