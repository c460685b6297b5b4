"""Best-fit decreasing packing of token sequences.

Only lengths decide where a piece goes, and there are at most `capacity` of them. So the
plan is made from the histogram of lengths: runs of equal pieces are placed together, each
into the tightest open sequences, which a segment tree over remaining capacities finds in
logarithmic time. The plan is exactly that of placing one document after the other, its
size is bounded by the capacity and not by the number of documents, and every task looks
up its pieces in it by length and rank.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexibridge.llm.common import materialise, released

CAPACITY = 2048
#: Pieces of one length that a slice holds, about: ranks within a length are counted in independent slices,
#: so that a length that a third of all pieces share is no single task. SLICES: the least number of them.
SLICE_PIECES = 200_000
SLICES = 64
#: Characters of the words whose ids a worker keeps; longer words than CACHE_LONGEST are not kept.
CACHE_CHARS = 4_000_000
CACHE_LONGEST = 64
#: Texts on which a tokenizer must agree with its words taken one by one.
PROBE = ("Plain words, 12 numbers & (signs)! a-b_c [x]{y} <z> don't ÄÖß é", "two  blanks\nand\n\nlines \u00a0 wide\u3000blank\ttab", "日本語 🙂 <|endoftext|> x", " <| edge |> ' ''s")


class FreeSpace:
    """Segment tree over remaining capacities 0..capacity: how many open sequences have each."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)

    def add(self, room: int, count: int) -> None:
        at = self.width + room
        while at:
            self.open[at] += count
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least `need` that an open sequence has."""
        at = self.width + need
        if self.open[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.width:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.width


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing for lengths[n] pieces of n tokens: rows (length, rank, sequence, offset, each).

    A row stands for the run of pieces that begins with its rank and ends before the next row's:
    they fill consecutive sequences from `sequence` on, from `offset` on, `each` of them one after
    the other in every sequence. After a piece its sequence is the tightest of all as long as an
    equal one still fits, so equal pieces go there first, as they would one by one.
    """
    free, runs = FreeSpace(capacity), {room: [] for room in range(capacity + 1)}
    out, opened = [], 0

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            runs[room].append((first, count))
            free.add(room, count)

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            room = free.tightest(length)
            if room is None:
                each = capacity // length
                first, there, room = opened, -(-left // each), capacity
                opened += there
            else:
                each = room // length
                first, there = runs[room].pop()
                free.add(room, -there)
            count = min(left, there * each)
            full, rest = divmod(count, each)
            out.append((length, rank, first, capacity - room, each))
            leave(room - each * length, first, full)
            leave(room - rest * length, first + full, 1 if rest else 0)
            leave(room, first + full + bool(rest), there - full - bool(rest))
            left, rank = left - count, rank + count
    return np.array(out, np.int64).reshape(-1, 5)


#: Words whose letters, digits and signs can be told apart without the tokenizer: printable
#: ASCII but the apostrophe, and the letters of Latin-1, which composition and lower case keep.
PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
RUNS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class RunIds(dict):
    """Ids of runs of plain characters, each looked up in the tokenizer's model once."""

    def __init__(self, model):
        self.tokenize, self.letters, self.held = model.tokenize, _byte_letters(), 0

    def __missing__(self, run: str) -> bytes:
        tokens = self.tokenize(run.encode().decode("latin-1").translate(self.letters))
        ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        if len(run) <= CACHE_LONGEST:
            self.held += len(run)
            if self.held > CACHE_CHARS:
                self.clear()
                self.held = len(run)
            self[run] = ids
        return ids


class WordIds:
    """Token ids of a text by its words, each word encoded once by the tokenizer.

    For vocabularies whose pre-tokeniser drops white space: no token and no normalisation
    reaches over a blank or line feed, so a text's ids are those of its pieces between them
    (special strings hold no white space either). Words of plain characters are cut into
    runs that the tokenizer's model encodes directly; all others take its whole path. Whether
    a tokenizer is of this kind is tried on loading; another one encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[str, bytes] = {}
        self.held, self.passing = 0, []
        self.runs = RunIds(self.tokenizer.model)
        self.by_words = self.by_runs = True
        signs = " ".join(chr(c) for c in [*range(33, 127), *range(161, 256)])
        for text in (*PROBE, signs, signs.replace(" ", ""), signs.replace(" ", "a")):
            self.by_runs = self.by_runs and self.encode([text]) == self._whole([text])
        if not self.by_runs:
            self.words = {}
            for text in PROBE:
                self.by_words = self.by_words and self.encode([text]) == self._whole([text])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self._whole(texts)
        words = [t.replace("\n", " ").split(" ") for t in texts]
        for w in self.passing:
            del self.words[w]
        new = {w for ws in words for w in ws}.difference(self.words)
        if self.held > CACHE_CHARS:
            self.words, self.held = {}, 0
            new = {w for ws in words for w in ws}
        odd, run = [], self.runs.__getitem__
        for w in new:
            if self.by_runs and PLAIN.fullmatch(w) and "<|" not in w:
                self.words[w] = b"".join(map(run, RUNS.findall(w.lower())))
            else:
                odd.append(w)
        self.words.update(zip(odd, self._whole(odd), strict=True))
        self.passing = [w for w in new if len(w) > CACHE_LONGEST]
        self.held += sum(map(len, new)) - sum(map(len, self.passing))
        return [b"".join(map(self.words.__getitem__, ws)) for ws in words]


@cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _pieces(path: str, end: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    close = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lexibridge.llm.arrays import slices

        encoder = _word_ids(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names = batch.column("doc_id").to_pylist()
            for start, stop in slices([len(t) for t in texts], 500_000):
                rows = []
                for name, ids in zip(names[start:stop], encoder.encode(texts[start:stop]), strict=True):
                    ids += close
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((name, n, at // 4, len(piece) // 4, crc32(piece)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and `end`, cut at `capacity`.

    A null text counts as empty and so is one piece, `end` alone.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(released(_pieces(path, end, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _place(table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    order = np.lexsort((table[:, 1], table[:, 0]))
    length, rank, first, offset, each = table[order].T
    steps = length << 44 | rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, place = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(steps, own << 44 | place, side="right") - 1
            columns = [c for c in batch.schema.names if c != "rank"]
            there, inside = np.divmod(place - rank[at], each[at])
            yield pa.record_batch([batch.column(c) for c in columns] + [pa.array(first[at] + there), pa.array(offset[at] + inside * own)], names=[*columns, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (with their `length`, 1..capacity) with sequence_id and offset: best-fit decreasing.

    Sequences are filled gaplessly from offset 0. Equal pieces are interchangeable; which of
    them goes where follows a hash of their columns. No pieces give no rows.
    """
    columns = pieces.columns
    own = [F.col(f"`{c}`") for c in columns]
    held = materialise(pieces)
    lengths = {r[0]: r[1] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slices = max(SLICES, -(-max(lengths.values(), default=0) // SLICE_PIECES))
    sliced = held.withColumn("_slice", F.pmod(F.xxhash64(*own), F.lit(slices)).cast("int"))
    # Pieces of a length in the slices before: at most `capacity` windows of `slices` rows.
    counts = sliced.groupBy("length", "_slice").agg(F.count("*").alias("n"))
    along = Window.partitionBy("length").orderBy("_slice")
    starts = counts.select("length", "_slice", (F.sum("n").over(along) - F.col("n")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*own)) - 1
    ranked = sliced.withColumn("_within", within).join(starts, ["length", "_slice"]).select(*own, (F.col("_within") + F.col("_start")).cast("long").alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(released(_place(plan(lengths, capacity))), schema)


def pack_documents(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """All documents packed into sequences of at most `capacity` tokens, one row per piece.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Documents longer than
    the capacity are cut into full pieces and a rest; no other document is cut.
    """
    return pack(token_pieces(docs, path, end, capacity), capacity)
