"""Connected components on DataFrames: contraction within partitions, stars between them.

Every partition of the edge list is contracted by union-find to a star forest, which no
component needs more than one edge per node for. Where that leaves several partitions,
alternating large-star and small-star steps join the forests; each step is contracted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibridge.llm.common import materialise

#: Edges that one task contracts in the last step, and nodes after which any task passes its forest on.
PARTITION_EDGES = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a partition's edges, each with the least node that it is connected to there.

    A forest that has grown large is passed on and a new one begun, so memory is bounded.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = root.setdefault(x, x)
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def forest() -> pa.RecordBatch:
        nodes = [x for x in root if root[x] != x]
        return pa.record_batch({"a": pa.array(nodes, pa.int64()), "b": pa.array([find(x) for x in nodes], pa.int64())})

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        # The last step's edges, in one task, have fewer nodes than this.
        if len(root) > 4 * PARTITION_EDGES:
            yield forest()
            root.clear()
    yield forest()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least node of each neighbourhood.

    large: the larger neighbours of each node; small: the smaller ones and the node itself.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    hung = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", partition_edges: int = PARTITION_EDGES) -> DataFrame:
    """(id, component) of every node of an undirected edge list; component: its least node.

    Self-loops and repeated edges are allowed; a null end makes no edge; no edges give no rows.
    A hub's edges are pre-aggregated before each exchange and its join may be split by adaptive
    execution. partition_edges: how many edges a task contracts; it does not change the result.
    """
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    seen = None
    while True:
        # Partitions that share a component mostly hang its nodes on the same least node: such edges count once.
        now = materialise(now.mapInArrow(_contract, "a long, b long").distinct())
        # The pair (edges, sum of ends) stands still only once every node hangs on its component's least node.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        parts = max(1, -(-state[0] // partition_edges))
        if parts == 1:
            now = materialise(now.coalesce(1).mapInArrow(_contract, "a long, b long"))
        if parts == 1 or state == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        seen = state
        now = _star(_star(now.coalesce(parts), True), False)
