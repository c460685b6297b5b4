"""Status of segments and propagation of translations among equal sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank of a translation's origin where several could be propagated.
SOURCE_PRIORITY = {"manual": 30, "llm": 20, "llm_review": 20, "tm": 10, "project_sync": 0}


def effective_status(source: Column, exact: Column, target: Column, score: Column) -> Column:
    """project_sync for synchronised segments, else by the match: exact, fuzzy or none."""
    return F.when(source == "project_sync", "project_sync").when(exact, "exact").when((score > 0) & (target != ""), "fuzzy").otherwise("none")


def priority(source: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in SOURCE_PRIORITY.items() for x in p]), source), F.lit(-1))


def winners(rows: DataFrame, *keys: str) -> DataFrame:
    """Of every group of at least two rows the one to propagate: confirmed, source priority, time, id.

    rows: confirmed, source, updated_at, id, target_text; an aggregate, so hot groups combine early.
    """
    rank = F.struct(F.col("confirmed").cast("int").alias("c"), priority(F.col("source")).alias("p"), F.col("updated_at").alias("t"), F.col("id").alias("i"))
    best = rows.groupBy(*keys).agg(F.count("*").alias("members"), F.max_by(F.struct("id", "target_text", "source"), rank).alias("w")).where("members > 1")
    return best.select(*keys, "members", F.col("w.id").alias("id"), F.col("w.target_text").alias("target_text"), F.col("w.source").alias("source"))


def convergence(rows: DataFrame, *keys: str) -> DataFrame:
    """The winner of every group by tiers: newest confirmed, else earliest exact, else earliest translated."""
    tier = F.when(F.col("confirmed"), 0).when(F.col("exact"), 1).when(F.col("target_text") != "", 2)
    order = Window.partitionBy(*keys).orderBy("tier", F.desc(F.when(F.col("tier") == 0, F.col("updated_at"))), "place", "id")
    ranked = rows.withColumn("tier", tier).where("tier IS NOT NULL").withColumn("rank", F.row_number().over(order))
    return ranked.where("rank = 1").drop("rank")


def signed_delta(old: DataFrame, new: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Change of counters between two states of rows: new rows count 1, old ones -1."""
    both = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
    return both.groupBy(*keys).agg(F.sum("sign").alias("rows"), *[F.sum(F.when(c, F.col("sign")).otherwise(0)).alias(n) for n, c in flags.items()])


def collapse_revisions(revisions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the first row's before text with the last row's after text."""
    return revisions.groupBy(*keys).agg(F.min_by("before_text", order).alias("before_text"), F.max_by("after_text", order).alias("after_text"), F.min(order).alias("first_order"), F.count("*").alias("revisions"))
