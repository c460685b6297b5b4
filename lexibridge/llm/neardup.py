"""Near-duplicate documents by weighted Jaccard similarity of five-word shingles.

BagMinHash signatures are banded; what shares a band is estimated from the signatures,
and what the estimate does not clearly rule out is verified on the exact multisets.

Equal texts are one class from the start, signed once for each slice of a task. Links between different texts are searched in
two steps, so that a large group of copies costs rows in proportion to its members:

1. In every bucket each member meets a leader; the leader is drawn by one of a few random
   orders of all documents, so that a member meets several. Verified links are contracted
   to components.
2. What remains are pairs in one bucket but in different components. In small buckets they
   are listed, estimated and verified like the others. Large buckets are chained to groups,
   which are dealt out by weight level and in pairs of blocks of bounded text; tasks compare
   the multisets exactly in arrays and emit only links that join components.

No bucket is capped. No pair that shares a band is dropped unless its estimate lies more
than four standard deviations below the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexibridge.llm.arrays import grouped, mix64, slices, weighted
from lexibridge.llm.bagminhash import signatures
from lexibridge.llm.common import materialise, released
from lexibridge.llm.components import components

BANDS, ROWS = 32, 4
LEADERS = 4
#: Members up to which a bucket is compared pair by pair.
SMALL = 16
#: Characters of text in one block of a larger group.
BLOCK_CHARS = 4_000_000
#: Columns that `deduplicate` adds while it joins.
OWN_ID, OWN_KEY = "_near_duplicate_id", "_near_duplicate_key"


def _sign(bands: int, rows: int, width: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            texts, names, held = (batch.column(c).to_pylist() for c in ("text", "doc_id", "text_key"))
            for start, stop in slices([len(t) for t in texts], 4_000_000):
                # Equal texts of a slice are signed once and stay one row from here on.
                members: dict[bytes, list[int]] = {}
                own = []
                for i in range(start, stop):
                    if held[i] not in members:
                        own.append(texts[i])
                    members.setdefault(held[i], []).append(names[i])
                n = len(own)
                row, ids, times = weighted(own, width)
                signs = signatures(row, ids, times, n, m)
                some = np.bincount(row, minlength=n) > 0
                keys = np.zeros((n, bands), np.uint64)
                for k in range(rows):
                    keys = mix64(keys + signs[:, k::rows])
                keys = mix64(keys ^ salt).view(np.int64)
                flat = pa.array(keys[some].reshape(-1))
                ends = np.concatenate(([0], np.cumsum(some))) * bands
                short = (signs & 0xFFFF).astype("<u2")
                yield pa.record_batch(
                    {
                        "text_key": pa.array(list(members), pa.binary()),
                        "members": pa.array(list(members.values()), pa.list_(pa.int64())),
                        "first": pa.array(list(map(min, members.values())), pa.int64()),
                        "weight": pa.array(np.bincount(row, weights=times, minlength=n).astype(np.int64)),
                        "keys": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat),
                        "sign": pa.array([s.tobytes() if f else None for s, f in zip(short, some, strict=True)], pa.binary()),
                    }
                )

    return run


def _verify(threshold: float, width: int):
    """Keep the pairs of texts whose multisets of shingles reach the threshold exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            for start, stop in slices([len(x) + len(y) for x, y in zip(left, right, strict=True)]):
                n = stop - start
                row, ids, times = weighted(left[start:stop] + right[start:stop], width)
                second = row >= n
                # Elements of both sides of a pair side by side: the least of equal neighbours is shared.
                pair = np.where(second, row - n, row)
                order = np.lexsort((ids, pair))
                p, i, t = pair[order], ids[order], times[order]
                same = np.flatnonzero((p[1:] == p[:-1]) & (i[1:] == i[:-1])) if len(p) else np.zeros(0, np.int64)
                shared = np.bincount(p[same], weights=np.minimum(t[same], t[same + 1]), minlength=n)
                total = np.bincount(p, weights=t, minlength=n)
                alike = np.flatnonzero((total > 0) & (shared >= threshold * (total - shared) - 1e-9))
                at = pa.array(alike + start)
                yield pa.record_batch({"a": batch.column("a").take(at), "b": batch.column("b").take(at)})

    return run


def _connect(threshold: float, width: int):
    """Links that join components within one (cell, i, j) group of texts: enough of them to connect
    what is connected, worked out exactly and without listing the pairs.

    Rows arrive sorted by group. A member of weight w meets those whose weight is near enough to
    reach the threshold; one flag array over the group's shingles gives its overlap with all of them.
    """

    def links(t: pa.Table, own: np.ndarray) -> Iterator[tuple[int, int]]:
        ids, comp = t.column("id").to_pylist(), t.column("component").to_pylist()
        block, upper = t.column("block").to_numpy(), t.column("upper").to_numpy(zero_copy_only=False)
        row, shingle, times = weighted(t.column("text").to_pylist(), width)
        # A shingle that occurs n times is n elements, so that the least of two counts is a plain overlap.
        level = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, element = np.repeat(row, times), mix64(np.repeat(shingle, times) + level.astype(np.uint64))
        total = np.bincount(row, minlength=len(ids))
        _, code, count = np.unique(element, return_inverse=True, return_counts=True)
        shared = count[code] > 1
        row, code = row[shared], code[shared]
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(ids)))))
        flags = np.zeros(len(count), bool)
        root = {c: c for c in comp}
        number = {c: n for n, c in enumerate(root)}
        label = np.array([number[c] for c in comp])
        for x in range(len(ids) - 1):
            y = np.arange(x + 1, len(ids))
            y = y[(label[y] != label[x]) & ~(upper[x] & upper[y]) & (np.minimum(total[x], total[y]) >= threshold * np.maximum(total[x], total[y]) - 1e-9)]
            y = y[(block[y] != block[x]) | own[y]]
            y = y[ends[y + 1] > ends[y]]
            if not len(y):
                continue
            flags[code[ends[x] : ends[x + 1]]] = True
            sizes = ends[y + 1] - ends[y]
            starts = np.cumsum(sizes) - sizes
            at = np.arange(sizes.sum()) - np.repeat(starts - ends[y], sizes)
            both = np.add.reduceat(flags[code[at]].astype(np.int64), starts)
            flags[code[ends[x] : ends[x + 1]]] = False
            for z in y[both >= threshold * (total[x] + total[y] - both) - 1e-9]:
                if label[z] != label[x]:
                    label[label == label[z]] = label[x]
                    yield ids[x], ids[z]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ("cell", "i", "j")):
            found = list(links(t, (t.column("i").to_numpy() == t.column("j").to_numpy())))
            if found:
                yield pa.record_batch({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

    return run


def _cells(members: DataFrame, threshold: float) -> DataFrame:
    """Deal (group, id, component, weight, text) out into pairs of blocks of bounded text.

    A cell holds the members of one weight level of one group, and those of the level above it:
    weights in a ratio of at least `threshold` are never further apart.
    """
    level = F.floor(F.log(F.col("weight").cast("double")) / F.lit(math.log(1 / threshold)) + 1e-9)
    placed = members.withColumn("upper", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("cell", F.xxhash64("group", level - F.col("upper").cast("int")))
    sizes = placed.groupBy("cell").agg(F.sum(F.length("text")).alias("chars"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").withColumn("blocks", F.ceil(F.col("chars") / BLOCK_CHARS).cast("int")).select("cell", "blocks")
    return (
        placed.join(sizes, "cell")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "upper", "id", "component", "text")
        .repartition("cell", "i", "j")
        .sortWithinPartitions("cell", "i", "j", "id")
    )


def _classes(docs: DataFrame, threshold: float, width: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The members of all texts, (text_key, members), and what becomes of each distinct text,
    (text_key, first, class_id, stays): its least doc_id, its group's, and whether it is the group's text that stays."""
    m = bands * rows
    need = math.ceil(m * threshold - 4.2 * math.sqrt(m * threshold * (1 - threshold)))
    base = _keyed(docs).where("doc_id IS NOT NULL")
    signed = materialise(base.mapInArrow(released(_sign(bands, rows, width)), "text_key binary, members array<long>, first long, weight long, keys array<long>, sign binary"))
    # One row per distinct text, numbered; tasks have joined the copies that they met, so a text of very many copies is few rows.
    merged = signed.groupBy("text_key").agg(F.min("first").alias("first"), F.any_value("weight").alias("weight"), F.any_value("keys").alias("keys"), F.any_value("sign").alias("sign"))
    texts_of = materialise(merged.withColumn("id", F.monotonically_increasing_id()))
    classes = texts_of.where(F.col("sign").isNotNull()).select("id", "weight", "keys", "sign")

    places = classes.select("id", F.posexplode("keys").alias("band", "key")).withColumn("order", F.xxhash64("id", (F.col("band") % LEADERS)))
    buckets = places.groupBy("key").agg(F.count("*").alias("n"), F.min_by("id", "order").alias("leader")).where("n > 1")
    members = materialise(places.join(buckets, "key").select("key", "id", "n", "leader"))
    stars = members.where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    signs = classes.select("id", "sign")
    near = _alike(stars, signs, need)

    wanted = members.select("id").distinct().join(texts_of.select("id", F.col("first").alias("doc_id"), "text_key"), "id")
    texts = materialise(base.join(wanted, ["doc_id", "text_key"]).select("id", "text").dropDuplicates(["id"]))
    first = materialise(_verified(near, texts, threshold, width))
    found = components(first)

    placed = materialise(members.join(found, "id", "left").select("key", "id", "n", "leader", F.coalesce("component", "id").alias("component")))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_places = placed.join(mixed, "key", "left_semi")
    small = open_places.where(F.col("n") <= SMALL).select("key", "id", "component")
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    second = _verified(_alike(pairs.join(stars, ["a", "b"], "left_anti"), signs, need), texts, threshold, width)
    # Large buckets of several bands mostly hold the same texts: what they chain together is compared once.
    large = materialise(open_places.where(F.col("n") > SMALL).select("id", "leader", "component"))
    group = components(large.select("id", F.col("leader").alias("to")), "id", "to")
    dealt = _cells(large.select("id", "component").distinct().join(group.select("id", F.col("component").alias("group")), "id").join(classes.select("id", "weight"), "id").join(texts, "id"), threshold)
    third = dealt.mapInArrow(released(_connect(threshold, width)), "a long, b long")
    links = first.unionByName(second).unionByName(third).distinct()

    own = texts_of.select("id", "text_key", "first")
    grouped_ = own.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    top = grouped_.groupBy("component").agg(F.min(F.struct("first", "id")).alias("top"))
    named = grouped_.join(top, "component").select("text_key", "first", F.col("top.first").alias("class_id"), (F.col("id") == F.col("top.id")).alias("stays"))
    return signed.select("text_key", "members"), named


def _text_key() -> Column:
    """Equal texts share a 256-bit key, a null text has one of its own document."""
    return F.coalesce(F.unhex(F.sha2("text", 256)), F.encode(F.concat(F.lit("null "), F.col("doc_id").cast("string")), "utf-8"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text)"""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: (doc_id, class_id, kept).

    class_id: least doc_id of the group; a group is connected by links, a link being a
    weighted Jaccard similarity of at least `threshold` between the multisets of `width`-word
    shingles (lower-cased words; a text of fewer words is one shingle). kept: whether this is the
    document of the group that stays, the one with the class_id.
    Equal texts are one group; a null text, and a text without any word unless equal to another,
    is a group of its own. Rows without a doc_id are left out; repeated rows give one row, different
    texts under one doc_id are documents of their own, each with a row, and at most one of a group is kept.
    Only doc_id and text are read, so other columns may have any names.
    """
    members, named = _classes(docs, threshold, width, bands, rows)
    each = members.join(named, "text_key").select(F.explode("members").alias("doc_id"), "class_id", F.col("stays"), "text_key")
    return each.distinct().select("doc_id", "class_id", (F.col("stays") & (F.col("doc_id") == F.col("class_id"))).alias("kept"))


def _alike(pairs: DataFrame, signs: DataFrame, need: int) -> DataFrame:
    """The pairs whose signatures agree in at least `need` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("left", "right"))
                at = pa.array(np.flatnonzero((x == y).sum(1) >= need))
                yield pa.record_batch({"a": batch.column("a").take(at), "b": batch.column("b").take(at)})

    both = pairs.join(signs.select(F.col("id").alias("a"), F.col("sign").alias("left")), "a").join(signs.select(F.col("id").alias("b"), F.col("sign").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(released(run), "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(released(_verify(threshold, width)), "a long, b long")


def deduplicate(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps: one row of each group.

    Of repeated rows with one doc_id and text one stays; different texts of one doc_id are told apart;
    rows without a doc_id all stay.
    """
    _, named = _classes(docs, threshold, width, bands, rows)
    keys = named.where("stays").select(F.col("first").alias(OWN_ID), F.col("text_key").alias(OWN_KEY))
    once = docs.where(F.col("doc_id").isNotNull()).withColumns({OWN_ID: F.col("doc_id").cast("long"), OWN_KEY: _text_key()}).join(keys, [OWN_ID, OWN_KEY], "left_semi").dropDuplicates([OWN_ID, OWN_KEY])
    return once.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
