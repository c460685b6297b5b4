"""Histogram sort: near-equal shards by bytes, in key order, with one exchange.

The sort key is a hash of the text, then a hash of the id, so that equal texts lie
together and are divided only where a shard ends within them. The key space is cut by
candidate boundaries; one pass counts the exact bytes and rows below each of them, and
only the cells that hold a wanted splitter are cut again in the next pass. When every
splitter is within tolerance the rows are exchanged once. A pass moves a bounded number
of counters, whatever the input.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexibridge.llm.common import materialise, shuffle_partitions

#: Bits of each of the two parts of the key, and bits that a pass resolves; the first resolves SPARE_BITS more than its parts need.
HALF, FIRST_BITS, NEXT_BITS, SPARE_BITS = 62, 12, 6, 3
#: What a shard's bound may miss its even share by, as a share of a part, and the bound of a part within a shard.
TOLERANCE, LOOSE = 0.002, 0.25


@dataclass
class Splitter:
    """Rows whose key is below `edge` come first: `size` bytes in `rows` rows."""

    edge: int
    size: int
    rows: int


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1)


def _key(value: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - HALF)


def _cell(depth: int) -> tuple[Column, Column]:
    """The first `depth` bits of the key, as its two parts."""
    if depth <= HALF:
        return F.shiftright("_k1", HALF - depth), F.lit(0).cast("long")
    return F.col("_k1"), F.shiftright("_k2", 2 * HALF - depth)


def _pairs(values: list[tuple[int, int]]) -> Column:
    """Pairs of numbers as one literal, however many there are."""
    return F.from_json(F.lit(json.dumps([{"a": a, "b": b} for a, b in values])), "array<struct<a: bigint, b: bigint>>")


def find_splitters(keys: DataFrame, parts: int, tolerance: float = TOLERANCE, inner: int = 1) -> list[Splitter]:
    """parts - 1 splitters of `keys` (_k1, _k2, _size) into near-equal bytes, in key order.

    Only every `inner`-th splitter need be within tolerance; the others divide work alone and may miss by LOOSE of a part.
    The first pass moves at most 16 counters a part (or 4096), a later one 64 for each splitter that is not yet found.
    """
    total = keys.agg(F.sum("_size")).first()[0] or 0
    goals = [total * i / parts for i in range(1, parts)]
    slack = [total / parts * (tolerance if i % inner == 0 else max(tolerance, LOOSE)) for i in range(1, parts)]
    found: dict[int, Splitter] = {}
    # Cells to cut next: their prefix, what lies below them, and the goals within them.
    cells = {0: (0, 0, list(range(len(goals))))} if total else {}
    depth, last = 0, 0
    while cells and depth < 2 * HALF:
        last, depth = depth, min(depth + (NEXT_BITS if depth else max(FIRST_BITS, (parts - 1).bit_length() + SPARE_BITS)), HALF if depth < HALF else 2 * HALF)
        chosen = keys
        if last:
            high, low = _cell(last)
            within = [(p, 0) if last <= HALF else (p >> (last - HALF), p & ((1 << (last - HALF)) - 1)) for p in cells]
            # No more rows than splitters.
            wanted = keys.sparkSession.range(1).select(F.explode(_pairs(within)).alias("c")).select("c.a", "c.b")
            chosen = keys.withColumns({"a": high, "b": low}).join(wanted, ["a", "b"], "left_semi")
        counts: dict[int, list[tuple[int, int, int]]] = {p: [] for p in cells}
        high, low = _cell(depth)
        for h, x, size, rows in chosen.groupBy(high.alias("h"), low.alias("l")).agg(F.sum("_size"), F.count("*")).collect():
            prefix = h if depth <= HALF else (h << (depth - HALF)) | x
            counts[prefix >> (depth - last)].append((prefix, size, rows))
        deeper: dict[int, tuple[int, int, list[int]]] = {}
        for cell, (size_below, rows_below, inside) in cells.items():
            edges, at = [], (size_below, rows_below)
            for prefix, size, rows in sorted(counts[cell]):
                edges.append((at[0], at[1], prefix, size, rows))
                at = (at[0] + size, at[1] + rows)
            starts = [e[0] for e in edges]
            for goal in inside:
                k = max(bisect_right(starts, goals[goal]) - 1, 0)
                below, rows_at, prefix, size, rows = edges[k]
                here, there = goals[goal] - below, below + size - goals[goal]
                if min(here, there) <= slack[goal] or rows == 1 or depth == 2 * HALF:
                    first = here <= there
                    edge = prefix if first else prefix + 1
                    found[goal] = Splitter(edge << (2 * HALF - depth), below if first else below + size, rows_at if first else rows_at + rows)
                else:
                    deeper.setdefault(prefix, (below, rows_at, []))[2].append(goal)
        cells = deeper
    return [found[i] for i in sorted(found)]


def _part(edges: list[tuple[int, int]]) -> Column:
    """How many of the ascending edges are at most the key, looked for in two steps of about their root each."""
    key, step = F.struct(F.col("_k1").alias("a"), F.col("_k2").alias("b")), math.isqrt(len(edges)) + 1
    below = lambda some: F.size(F.filter(some, lambda c: c <= key))
    run = below(_pairs(edges[step::step]))
    return run * step + below(F.slice(_pairs(edges), run * step + 1, F.lit(step)))


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """`docs` with its rows put into shards 0..shards-1 of near-equal bytes (law `bytes`).

    Adds size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32, law, shard,
    slot (gapless from 0 in each shard, in key order) and grown_shard (null: this law has no
    such guarantee); columns of these names in the input are replaced. A boundary misses the
    even share by at most `tolerance` of a part, or half a document where one is larger. Equal
    texts share a shard except where a boundary falls among them; rows that agree in text and
    id cannot be told apart and stay together. An empty table gives no rows.
    """
    keyed = docs.withColumns({"_k1": _key(F.col("text")), "_k2": _key(F.col("doc_id")), "_size": text_size(F.col("text"))})
    inner = max(1, -(-shuffle_partitions(docs.sparkSession) // shards))
    keys = materialise(keyed.select("_k1", "_k2", "_size"))
    cuts = find_splitters(keys, shards * inner, tolerance, inner)
    parts = _part([(c.edge >> HALF, c.edge & ((1 << HALF) - 1)) for c in cuts])
    before = [0] + [c.rows for c in cuts]
    offsets = [n - before[i // inner * inner] for i, n in enumerate(before)]
    order = Window.partitionBy("_part").orderBy("_k1", "_k2")
    return (
        keyed.withColumn("_part", parts)
        .withColumns({"size": F.col("_size"), "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")))})
        .withColumns({"law": F.lit("bytes"), "shard": F.floor(F.col("_part") / inner).cast("int"), "slot": (F.row_number().over(order) - 1).cast("long") + F.element_at(F.from_json(F.lit(json.dumps(offsets)), "array<bigint>"), F.col("_part") + 1), "grown_shard": F.lit(None).cast("int")})
        .drop("_k1", "_k2", "_size", "_part")
    )
