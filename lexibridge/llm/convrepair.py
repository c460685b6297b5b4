r"""Conversation structure repair: the cheapest edits that give a conversation its role grammar.

Three weighted automata are composed: the input acceptor (the rows in their order), an edit
transducer (keep, rerole, delete, insert) and the acceptor of the grammar `(s?(ua)+)?` over the
initials of roles. States of the composition are met only as the shortest-path search needs
them. Weights are pairs (cost, labels of the edits), least first by cost and then by the
labels' ASCII order; a path's weight is the sum of the costs and the labels in a row.

A label leads to one state alone, so labels decide everything that a path does. Two paths of
equal cost through the same rows never have labels of which one begins with the other, as what
is left could only be insertions, which cost. Least weights may therefore be worked out
block by block: a block of rows is a matrix of least weights from each grammar state to
each, and the product of a conversation's matrices is its repair. So a conversation of very
many rows is many tasks' work. Only the hash of the repaired text, which is defined
over all of it in order, is one stream a conversation, read batch by batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexibridge.llm.common import materialise

#: Bits that number the rows of one block.
BLOCK_BITS = 12
#: Costs of the edits, and of leaving a truncated row in its place.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar states: nothing yet, behind the system row, behind a user row, behind an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (EMPTY, ASSISTANT)
#: What an insertion or a new role makes of a state: a user row, or an assistant row behind a user row.
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}

Weight = tuple[int, str]


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after the fixed damage by crc32(`conv_id:turn`) % 20: (conv, conv_id, turn, role, text).

    0 drops a row, 1 empties its text, 2 removes `[.!?]` from it, 3 repeats the row, 4 makes it a user's. A null
    is one space where it is read as text. conv tells conversations apart, that of the null id too.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    rows = conversations.select(_conv().alias("conv"), "conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select(
        "conv",
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _conv() -> Column:
    return F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))


def _digest() -> Column:
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))


def _order() -> tuple[Column, ...]:
    return F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")


def _light(rows: DataFrame) -> DataFrame:
    """Rows without their texts, in order: (conv, block, pos, turn, role, blank, truncated, duplicate).

    Blocks are short runs of consecutive rows of one conversation. A text is a duplicate by its 256-bit digest.
    """
    read = rows.select(
        "conv",
        "turn",
        "role",
        _digest().alias("digest"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
        # Rows that agree in all else are alike in all that follows, but should not be kept to one range.
        F.monotonically_increasing_id().alias("tie"),
    )
    keys = (F.col("conv"), *_order(), F.col("tie"))
    placed = materialise(read.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("pos", F.monotonically_increasing_id()).withColumn("block", F.shiftright("pos", BLOCK_BITS))
    # The first row of each text within a block, then over the blocks: a text has one row a block at most here.
    seen = placed.where("NOT blank").groupBy("conv", "block", "role", "digest").agg(F.min("pos").alias("first"))
    seen = seen.withColumn("first", F.min("first").over(Window.partitionBy("conv", "role", "digest")))
    marked = placed.join(seen, ["conv", "block", "role", "digest"], "left")
    duplicate = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    return marked.select("conv", "block", "pos", "turn", "role", "blank", (~F.col("blank") & ~duplicate & F.col("truncated")).alias("truncated"), duplicate.alias("duplicate"))


def arcs(state: int, initial: str, gone: bool, truncated: bool) -> Iterator[tuple[int, str, int]]:
    """(cost, label, state after) of every edit that takes a row in one state of the composition."""
    yield DELETE, "D", state
    if not gone:
        stay = TRUNCATED if truncated else 0
        if (state, initial) in GRAMMAR:
            yield stay, "K", GRAMMAR[state, initial]
        yield stay + RENAME, "R", NEXT[state]


def _better(best: dict[int, Weight], state: int, weight: Weight) -> None:
    if state not in best or weight < best[state]:
        best[state] = weight


def _insertions(best: dict[int, Weight]) -> None:
    """Relax the insertions before a row: more than two in a row only lead back."""
    for state in (EMPTY, SYSTEM, USER, ASSISTANT):
        if state in best:
            cost, labels = best[state]
            _better(best, NEXT[state], (cost + INSERT, labels + "I"))


def block_weights(rows: list[tuple[str, bool, bool]], start: int) -> dict[int, Weight]:
    """Least weight of the rows (initial, gone, truncated) from grammar state `start` to each state that is reached.

    Positions are taken in order, which is the topological order of the composition.
    """
    best: dict[int, Weight] = {start: (0, "")}
    for row in rows:
        _insertions(best)
        after: dict[int, Weight] = {}
        for state, (cost, labels) in best.items():
            for more, label, to in arcs(state, *row):
                _better(after, to, (cost + more, labels + label))
        best = after
    return best


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of a conversation: its matrix and what its neighbours need to know of it.

    Rows come sorted by conversation, block and place; a block is short, so it may be held.
    """
    out: dict[str, list] = {k: [] for k in ("conv", "block", "pos", "first", "last", "illegal", "matrix")}

    def close(key, pos, rows) -> None:
        initials = [r[0] for r in rows]
        out["conv"].append(key[0])
        out["block"].append(key[1])
        out["pos"].append(pos)
        out["first"].append(initials[0])
        out["last"].append(initials[-1])
        out["illegal"].append(sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False)))
        out["matrix"].append([{"start": s, "stop": t, "cost": c, "labels": w} for s in range(4) for t, (c, w) in block_weights(rows, s).items()])

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), BLOCK_TYPES, strict=True)], names=list(out))
        for v in out.values():
            v.clear()
        return batch

    key, pos, held = None, 0, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "block", "pos", "initial", "gone", "truncated")]
        for conv, block, at, *row in zip(*columns, strict=True):
            if (conv, block) != key:
                if held:
                    close(key, pos, held)
                key, pos, held = (conv, block), at, []
            held.append(tuple(row))
        if len(out["conv"]) >= 1000:
            yield flush()
    if held:
        close(key, pos, held)
    yield flush()


_CELL = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())])
BLOCK_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(_CELL))
BLOCK_SCHEMA = "conv string, block long, pos long, first string, last string, illegal long, matrix array<struct<start: int, stop: int, cost: long, labels: string>>"


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost, edits and illegal neighbours of each conversation from its blocks, which come in order."""
    conv, best, last, illegal = None, {}, None, 0

    def close() -> dict:
        _insertions(best)
        cost, labels = min(best[s] for s in FINAL if s in best)
        return {"conv": conv, "cost": cost, "audit": labels, "illegal": illegal}

    schema = pa.schema([("conv", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())])
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["conv"] != conv:
                if conv is not None:
                    done.append(close())
                conv, best, last, illegal = row["conv"], {EMPTY: (0, "")}, None, 0
            after: dict[int, Weight] = {}
            for cell in row["matrix"]:
                if cell["start"] in best:
                    cost, labels = best[cell["start"]]
                    _better(after, cell["stop"], (cost + cell["cost"], labels + cell["labels"]))
            best = after
            illegal += row["illegal"] + (last is not None and last + row["first"] not in ("su", "ua", "au"))
            last = row["last"]
        yield pa.RecordBatch.from_pylist(done, schema)
    yield pa.RecordBatch.from_pylist([close()] if conv is not None else [], schema)


class Rewriter:
    """Carries one conversation's edits out row by row, into the hash of the repaired `role:text` lines."""

    def __init__(self, edits: str):
        self.edits, self.at, self.begun, self.digest = edits, 0, False, hashlib.sha256()
        # An odd number of lines begins with the system row, which is always one that was kept.
        self.state = EMPTY
        self.system = (len(edits) - edits.count("D")) % 2 == 1

    def _line(self, role: str | None, text: str) -> None:
        self.state = SYSTEM if self.system else NEXT[self.state]
        self.system = False
        self.digest.update(f"{chr(10) if self.begun else ''}{ROLE[self.state] if role is None else role}:{text}".encode())
        self.begun = True

    def _insertions(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self._line(None, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insertions()
        label = self.edits[self.at]
        self.at += 1
        if label != "D":
            self._line(role if label == "K" else None, text)

    def close(self) -> str:
        self._insertions()
        return self.digest.hexdigest()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each repaired conversation: a row with its edits comes first, then its damaged rows in order.

    Only a batch of rows and the edits of one conversation are held.
    """
    conv, now = None, None
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    for batch in batches:
        done = []
        for name, head, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "head", "role", "text")), strict=True):
            if head:
                if now is not None:
                    done.append({"conv": conv, "repaired_sha256": now.close()})
                conv, now = name, Rewriter(text)
            else:
                now.row(role, text)
        yield pa.RecordBatch.from_pylist(done, schema)
    yield pa.RecordBatch.from_pylist([] if now is None else [{"conv": conv, "repaired_sha256": now.close()}], schema)


def repair(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """What is wrong with each conversation and how it is cheapest repaired.

    One row for every conv_id of `conversations`, whose rows are (conv, turn, role, text) in `damaged`: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows are taken by turn, nulls first; rows of
    one turn by role, then by the hash of their text. The null conv_id is a conversation of its own; one without damaged rows has zeros, no
    edits and the hash of nothing. An empty role has no legal initial. Only these columns are read, so others may have any names; an empty table gives no rows.
    """
    rows = materialise(_light(damaged))
    some = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    gaps = F.max("turn").cast("long") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = rows.groupBy("conv").agg(gaps.alias("gaps"), some("blank"), some("duplicate"), some("truncated"))

    entered = rows.select("conv", "block", "pos", F.substring("role", 1, 1).alias("initial"), (F.col("blank") | F.col("duplicate")).alias("gone"), "truncated")
    blocks = entered.repartition("conv", "block").sortWithinPartitions("conv", "block", "pos").mapInArrow(_blocks, BLOCK_SCHEMA)
    edits = materialise(blocks.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(_product, "conv string, cost long, audit string, illegal long"))

    texts = damaged.select("conv", F.lit(False).alias("head"), "turn", "role", _digest().alias("digest"), "text")
    heads = edits.select("conv", F.lit(True).alias("head"), F.lit(None).cast(damaged.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    hashes = texts.unionByName(heads).repartition("conv").sortWithinPartitions("conv", F.col("head").desc(), *_order()).mapInArrow(_hashes, "conv string, repaired_sha256 string")

    every = conversations.select(_conv().alias("conv"), "conv_id").groupBy("conv").agg(F.any_value("conv_id").alias("conv_id"))
    known = every.join(counts, "conv", "left").join(edits, "conv", "left").join(hashes, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return known.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
