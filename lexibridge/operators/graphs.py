"""Graph operators on edge tables: connected components, ranks along chains.

Both iterate on DataFrames; every round cuts its lineage through the shared checkpoint folder.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once and cut its lineage, in the folder that `spark.checkpoint.dir` names; only a local session may have none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an undirected edge table; component: its least node.

    Every round hangs a node's larger neighbours on its least one, then its smaller ones, so that paths halve: rounds grow with
    the logarithm of the longest path. Loops and repeated edges do no harm; a null end makes no edge, no edges give no rows.
    A hub's least neighbour is found by partial aggregation.
    """
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (F.col(a) != F.col(b)).alias("two")).where("two").select("a", "b").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        seen = state
        both = _both_ways(now)
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Edges now point down; each node's smaller neighbours and itself hang on the least of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b")).unionByName(lowest.select("a", F.col("low").alias("b")))
        now = cut(small.where("a <> b").distinct())


def chain_ranks(links: DataFrame, node: str = "node", after: str = "after") -> DataFrame:
    """(node, head, place, in_ring): where each node stands in its chain, place 0 being the head.

    `links` holds each node once with the node after it, or null at a chain's end; no node comes after two. Pointers double
    in every round, so a chain of n nodes takes about log2 n joins of light rows. Nodes that follow one another in a
    ring have no first: they get in_ring, the least node of the ring as head and null as place.
    """
    # From here each node looks towards its head: (node, ahead, hops), null ahead once it has arrived.
    before = links.where(F.col(after).isNotNull()).select(F.col(after).alias("node"), F.col(node).alias("ahead"))
    start = links.select(F.col(node).alias("node")).join(before, "node", "left")
    low = F.least("node", F.coalesce("ahead", "node"))
    now = cut(start.select("node", "ahead", F.coalesce("ahead", "node").alias("head"), F.col("ahead").isNotNull().cast("long").alias("hops"), low.alias("low")))
    nodes, reach = now.count(), 1
    while True:
        open_ = now.where("ahead IS NOT NULL")
        if reach > nodes or open_.isEmpty():
            ring = F.col("ahead").isNotNull()
            return now.select("node", F.when(ring, F.col("low")).otherwise(F.col("head")).alias("head"), F.when(~ring, F.col("hops")).alias("place"), ring.alias("in_ring"))
        there = now.select(F.col("node").alias("ahead"), F.col("ahead").alias("next_ahead"), F.col("head").alias("next_head"), F.col("hops").alias("more"), F.col("low").alias("next_low"))
        jumped = open_.join(there, "ahead").select("node", F.col("next_ahead").alias("ahead"), F.col("next_head").alias("head"), (F.col("hops") + F.col("more")).alias("hops"), F.least("low", "next_low").alias("low"))
        now, reach = cut(jumped.unionByName(now.where("ahead IS NULL"))), 2 * reach
