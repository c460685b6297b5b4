"""Byte-level BPE by ranks: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokens are found without a regular expression. Code points become classes (letter,
number, white space, other), and what a boundary depends on is the state of a small
automaton: every class is a transition function that either sets the state or keeps it,
so functions compose associatively and one running maximum scans all texts of a batch at
once. The slices between boundaries are merged once each and kept in a cache; the byte
offsets of all tokens are kept beside the ids, so that any run of tokens decodes by itself.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibridge.llm.arrays import LETTER, NUMBER, OTHER, SPACE, code_points, slices
from lexibridge.llm.merging import merged

#: Bytes of the pre-tokens whose ids a worker keeps; those longer than CACHE_LONGEST are merged each time.
CACHE_BYTES = 8_000_000
CACHE_LONGEST = 64
#: Endings that an apostrophe at the start of a pre-token takes along.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def class_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        table[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    for first, last in ((9, 13), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[first : last + 1] = SPACE
    return table


def boundaries(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code point positions at which a pre-token starts, for rows that lie end to end; ascending."""
    n = len(points)
    kind = class_table()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # row starts, and the end
    start = first[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    blank = points == 32
    space = kind == SPACE
    # The last character of a white space run that is followed by text: a token of its own or, if a
    # blank, the head of the next token.
    ends_run = np.zeros(n, bool)
    ends_run[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
    start |= ends_run
    start[1:] &= ~(ends_run[:-1] & blank[:-1])
    # State: whether the run of other characters here was begun by a blank. A row start, a letter, a
    # number and white space set it; other characters keep it. The state at i is what the last setter said.
    sets = kind != OTHER
    at = np.arange(n)
    head = first[:-1]
    setter = np.maximum.accumulate(np.where(sets, at, np.where(head, at, -1)))
    joined = blank[setter] & sets[setter] & ~((setter == at) & head & ~sets)
    quote = np.flatnonzero((points == 39) & start & ~joined)
    if len(quote):
        row_end = offsets[np.searchsorted(offsets, quote, side="right")]
        taken = np.zeros(len(quote), np.int64)
        padded = np.concatenate((points, np.zeros(3, points.dtype)))
        for ending in ENDINGS:
            here = (taken == 0) & (quote + len(ending) < row_end)
            for k, c in enumerate(ending, 1):
                here &= padded[quote + k] == ord(c)
            taken[here] = len(ending)
        own, taken = quote[taken > 0], taken[taken > 0]
        start[own + 1] = False
        after = own + taken + 1
        after = after[after < n]
        start[after] |= kind[after] == LETTER
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts by the ranks of a vocabulary file (base64 token and rank in each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, lines))}
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def merge(self, piece: bytes) -> bytes:
        """Ids of one pre-token: the adjacent pair of least rank merges first, the leftmost of equals."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return rank.to_bytes(4, "little")
        parts = merged([piece[i : i + 1] for i in range(len(piece))], self.ranks)
        return b"".join(self.ranks[p].to_bytes(4, "little") for p in parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        points, offsets = code_points(texts)
        if not len(points):
            return [b""] * len(texts)
        start = boundaries(points, offsets)
        data = "".join(texts).encode()
        width = np.ones(len(points), np.int64)
        for limit in (0x80, 0x800, 0x10000):
            width += points >= limit
        place = np.concatenate(([0], np.cumsum(width)))
        cuts = place[np.append(start, len(points))].tolist()
        pieces = list(map(data.__getitem__, map(slice, cuts[:-1], cuts[1:])))
        new = set(pieces).difference(self.known)
        if self.held > CACHE_BYTES:
            self.known, self.held, new = {}, 0, set(pieces)
        self.known.update((p, self.merge(p)) for p in new)
        ends = np.searchsorted(start, offsets).tolist()
        look = self.known.__getitem__
        encoded = [b"".join(map(look, pieces[a:b])) for a, b in zip(ends[:-1], ends[1:])]
        for p in new:
            if len(p) > CACHE_LONGEST:
                del self.known[p]
            else:
                self.held += len(p)
        return encoded

    def token_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets of the tokens and the end."""
        return np.concatenate(([0], np.cumsum(self.lengths[ids])))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of the tokens, each copied to its offset."""
        at = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0] - self.starts[ids], np.diff(offsets))
        return self.bytes[at].tobytes()


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, offsets, decoded): little-endian unsigned 32-bit ids of every whole text, the
    byte offsets of its tokens and its end in the same form, and the bytes that the ids decode to.

    A null text counts as empty: no ids. Reads doc_id and text alone; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            names, column = batch.column("doc_id"), batch.column("text")
            # Slices are turned into strings one at a time: a batch may hold far more text.
            for start, stop in slices(pc.binary_length(column).to_pylist()):
                ids = encoder.encode(column.slice(start, stop - start).to_pylist())
                arrays = [np.frombuffer(x, "<u4") for x in ids]
                offsets = [encoder.token_offsets(x) for x in arrays]
                decoded = [encoder.decode(i, o) for i, o in zip(arrays, offsets, strict=True)]
                yield pa.record_batch({"doc_id": names.slice(start, stop - start), "ids": pa.array(ids, pa.binary()), "offsets": pa.array([o.astype("<u4").tobytes() for o in offsets], pa.binary()), "decoded": pa.array(decoded, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids binary, offsets binary, decoded binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of what `encode_documents` gave: the bytes of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            pairs = zip(batch.column("ids").to_pylist(), batch.column("offsets").to_pylist(), strict=True)
            decoded = [encoder.decode(np.frombuffer(i, "<u4"), np.frombuffer(o, "<u4").astype(np.int64)) for i, o in pairs]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "decoded": pa.array(decoded, pa.binary())})

    return encoded.mapInArrow(run, "doc_id long, ids binary, decoded binary")
