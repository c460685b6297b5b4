"""Document fingerprints: improbable byte windows in chained Bloom filters.

Every window of 32 bytes is ranked by how rare its entropy is. A window is a feature if,
of all runs of 32 neighbouring windows, it is the rarest in enough of them; so features
depend on their neighbourhood alone and survive edits elsewhere. Texts in which hardly any
window stands out, mostly short ones, add all their windows of 8 bytes. Features go in text
order into Bloom filters of 2048 bits, five bits each and 160 features a filter. Two
chains are compared by the normalised overlap of bits of their filters.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibridge.llm.arrays import mix64, slices
from lexibridge.llm.common import range_number, shuffle_partitions

WINDOW, RUN, POINTS = 32, 32, 8
#: Texts of fewer features add windows of SHORT bytes.
FEW, SHORT = 4, 8
BITS, HASHES, FEATURES = 2048, 5, 160
#: Entropy (bits) that windows of prose centre on; the further away, the rarer. Windows
#: below the floor repeat few bytes and say nothing about a text.
CENTRE, FLOOR = 3.3, 1.2
#: Bytes of text in one range of documents.
RANGE_BYTES = 64_000_000
_SCALE = 1 << 12
_NEVER = np.uint16(65535)


def _gain() -> np.ndarray:
    """What one more byte adds to the sum of n log2 n over the byte counts of a window, by n before."""
    f = np.array([round(n * math.log2(n) * _SCALE) if n else 0 for n in range(WINDOW + 2)], np.int64)
    return np.diff(f)


def ranks(data: np.ndarray) -> np.ndarray:
    """Rarity rank (0 rarest) of the window that begins at each byte; empty below one window."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.uint16)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    block = 1 << 15
    for s in range(0, n, block):
        part = data[s : s + block + WINDOW - 1]
        size = min(block, n - s)
        for lag in range(1, WINDOW):
            equal = (part[: max(min(size, len(part) - lag), 0)] == part[lag : lag + size]).view(np.uint8)
            after[s : s + len(equal)] += equal
            before[s + lag : s + lag + len(equal)] += equal
    gain = _gain()
    # Sliding the window over the bytes: the entering byte adds, the leaving one takes away.
    enter, leave = np.cumsum(gain[before]), np.cumsum(gain[after])
    total = enter[WINDOW - 1 :].copy()
    total[1:] -= leave[: n - WINDOW]
    entropy = math.log2(WINDOW) - total / (_SCALE * WINDOW)
    rank = np.clip(40000 - np.abs(entropy - CENTRE) * 10000, 0, 65000).astype(np.uint16)
    rank[entropy < FLOOR] = _NEVER
    return rank


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit feature) of every text in order, each feature once; every non-empty text has one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    rank = ranks(data)
    chosen, chosen_row = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(rank):
        # Least of its POINTS - 1 neighbours on both sides: few windows are left to look at closely.
        side = POINTS - 1
        padded = np.concatenate((np.full(side, _NEVER), rank, np.full(side, _NEVER)))
        low, reach = padded, 1
        while reach * 2 <= 2 * side + 1:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        rest = 2 * side + 1 - reach
        low = np.minimum(low[: len(rank)], low[rest : rest + len(rank)])
        at = np.flatnonzero((rank == low) & (rank != _NEVER))
        row = np.searchsorted(starts, at, side="right") - 1
        inside = at + WINDOW <= starts[row] + sizes[row]
        at, row = at[inside], row[inside]
        left, right = np.full(len(at), RUN), np.full(len(at), RUN)
        wide = np.concatenate((np.full(RUN, _NEVER), rank, np.full(RUN, _NEVER)))
        own, open_left, open_right = rank[at], np.arange(len(at)), np.arange(len(at))
        for d in range(1, RUN):
            hit = wide[at[open_left] + RUN - d] <= own[open_left]
            left[open_left[hit]] = d
            open_left = open_left[~hit]
            hit = wide[at[open_right] + RUN + d] < own[open_right]
            right[open_right[hit]] = d
            open_right = open_right[~hit]
        left = np.minimum(left, at - starts[row] + 1)
        right = np.minimum(right, starts[row] + sizes[row] - WINDOW - at + 1)
        keep = left + right - RUN >= POINTS
        chosen, chosen_row = at[keep], row[keep]
    value = np.zeros(0, np.uint64)
    if len(chosen):
        base = np.multiply.accumulate(np.full(WINDOW, np.uint64(0x9E3779B97F4A7C15 | 1)))
        value = np.concatenate([mix64(((data[c[:, None] + np.arange(WINDOW)].astype(np.uint64) + np.uint64(1)) * base).sum(1, dtype=np.uint64)) for c in np.array_split(chosen, len(chosen) // 50_000 + 1)])
    few = np.flatnonzero((np.bincount(chosen_row, minlength=len(texts)) < FEW) & (sizes > 0))
    if len(few):
        own = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(texts[i].ljust(SHORT, b"\0"), np.uint8), SHORT).copy().view(np.uint64).reshape(-1) for i in few.tolist()]
        chosen_row = np.concatenate((chosen_row, np.repeat(few, [len(x) for x in own])))
        value = np.concatenate((value, mix64(np.concatenate(own))))
    order = np.argsort(chosen_row, kind="stable")
    chosen_row, value = chosen_row[order], value[order]
    by_value = np.lexsort((np.arange(len(value)), value, chosen_row))
    first = np.ones(len(value), bool)
    first[1:] = (chosen_row[by_value][1:] != chosen_row[by_value][:-1]) | (value[by_value][1:] != value[by_value][:-1])
    once = np.sort(by_value[first])
    return chosen_row[once], value[once]


def digests(texts: list[bytes]) -> list[bytes]:
    """The chained filters of every text, 256 bytes each; an empty text has none."""
    row, value = features(texts)
    count = np.bincount(row, minlength=len(texts))
    filters = -(-count // FEATURES)
    first = np.cumsum(filters) - filters
    place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    own = first[row] + place // FEATURES
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for k in range(HASHES):
        bits[own, (value >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
    packed = np.packbits(bits, axis=1).tobytes()
    size = BITS // 8
    return [packed[a * size : (a + n) * size] for a, n in zip(first.tolist(), filters.tolist(), strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: mean over the shorter chain's filters of the best normalised overlap in the other chain.

    The overlap that random filters of the same fill would have counts as 0. Equal chains have 1,
    an empty chain is like nothing but an empty one.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.unpackbits(np.frombuffer(c, np.uint8)).reshape(-1, BITS).astype(np.float32) for c in (a, b))
    if (len(x), a) > (len(y), b):
        x, y = y, x
    n, m = x.sum(1)[:, None], y.sum(1)[None, :]
    both = x @ y.T
    least, chance = np.minimum(n, m), n * m / BITS
    score = np.clip((both - chance) / np.maximum(least - chance, 1e-9), 0, 1)
    return float(score.max(1).mean())


def edited(text: str, other: str) -> str:
    """`text` with its last floor(n/2) characters replaced by the first as many of `other`, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition is one range in order; its last row is the next range's first, marked."""
    from hashlib import sha256

    held: tuple | None = None

    def work(rows: list[tuple], after: tuple) -> Iterator[pa.RecordBatch]:
        chain = [*rows, after]
        texts = [r[2] for r in chain]
        prints = digests([t.encode() for t in texts])
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        raw = [t.encode() for t in changed]
        other = digests(raw)
        out = []
        for i, (_, doc_id, text, mark) in enumerate(rows):
            if not mark:
                a, b = prints[i], other[i]
                out.append((doc_id, len(text), sha256(raw[i]).hexdigest(), base64.b64encode(a).decode(), base64.b64encode(b).decode(), likeness(a, b), likeness(a, prints[i + 1])))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        rows = list(zip(*[batch.column(c).to_pylist() for c in ("code", "doc_id", "text", "mark")], strict=True))
        rows = ([held] if held else []) + rows
        for start, stop in slices([len(r[2]) for r in rows[:-1]]):
            yield from work(rows[start:stop], rows[stop])
        held = rows[-1] if rows else held


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (`edited` with the next document).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; the
    next document is that of the next lower doc_id, after the last one the first; rows of one id
    follow each other by text, rows without an id come last, by hashes of their texts. A null text
    counts as empty. Reads doc_id and text alone; repeated rows give repeated rows. The texts are
    exchanged once, by ranges of that order; each range is followed by one marked copy of the next
    range's first row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total, nulls, size = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(shuffle_partitions(docs.sparkSession), -(-size // RANGE_BYTES))
    least, cuts = rows.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000) if n > 1 else F.lit(None)).first()
    cuts = sorted({c for c in cuts or [] if c > least})
    # Ranges ascend while the order descends: those of rows without an id first, by the upper bits of a hash.
    low = -(-n * nulls // total) if nulls else 0
    code = F.when(F.col("doc_id").isNull(), F.shiftrightunsigned(F.xxhash64("text"), 33)).otherwise(0)
    part = F.when(F.col("doc_id").isNull(), F.shiftright(F.col("code") * low, 31)).otherwise(low + range_number(F.col("doc_id"), [F.lit(c).cast("long") for c in cuts])).cast("int")
    dealt = rows.withColumn("code", code).withColumn("part", part)
    tops = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.max("doc_id"), F.max("code")).collect())  # one row of numbers for each range
    follows = docs.sparkSession.createDataFrame([(p, top, *rest) for (p, *_), (top, *rest) in zip(tops, [*tops[-1:], *tops[:-1]], strict=True)], "at int, part int, top long, code long")
    first = (F.col("x.part") == F.col("y.part")) & F.col("x.doc_id").eqNullSafe(F.col("y.top")) & (F.col("x.code") == F.col("y.code"))
    tails = dealt.alias("x").join(F.broadcast(follows.alias("y")), first).groupBy("y.at", "x.doc_id", "x.code").agg(F.max("x.text").alias("text"))
    marked = tails.select(F.col("at").alias("part"), "code", "doc_id", "text", F.lit(True).alias("mark"))
    both = dealt.select("part", "code", "doc_id", "text", F.lit(False).alias("mark")).unionByName(marked)
    spread = both.repartitionById(low + len(cuts) + 1, "part").sortWithinPartitions("mark", F.desc_nulls_last("doc_id"), F.desc("code"), F.desc("text"))
    return spread.mapInArrow(_prints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
