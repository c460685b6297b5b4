"""Flat numpy views over a batch of texts, shared by the vectorised operators.

A batch of texts becomes one array of code points plus row offsets, so that
word boundaries, word hashes and n-grams are whole-array operations. Batches
are cut to a bounded number of characters first: memory does not follow the
number of rows that Arrow happens to deliver, only the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Characters that one slice of a batch may hold (a longer text is a slice alone).
SLICE_CHARS = 1_000_000
#: Rows that one slice may hold: arrays with a fixed width for every row stay bounded on short texts.
SLICE_ROWS = 2048

#: Class codes of `char_classes`.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def slices(lengths: list[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Cut rows 0..n into consecutive [start, stop) runs of at most `limit` characters and SLICE_ROWS rows."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > limit or i - start == SLICE_ROWS):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def word_table() -> np.ndarray:
    """True for code points that belong to a word: letters, numbers, marks, underscore."""
    import unicodedata

    table = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LNM":
            table[c] = True
    table[ord("_")] = True
    return table


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of `texts` in one uint32 array, and the offsets of its rows."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


#: The longest tables of powers made so far; shorter ones are their beginnings, so only one pair is held.
_POWERS: list[np.ndarray] = []


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and their inverses, `size` + 1 of each at least."""
    if not _POWERS or len(_POWERS[0]) <= size:
        step = 1 << 18
        n = -(-(size + 1) // step) * step
        up, down = np.full(n, _BASE, np.uint64), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of points[start:end] for every span: equal spans hash alike wherever they lie.

    One prefix sum of point * base^position serves all spans; a span's difference is
    shifted back to position 0 by the inverse power.
    """
    up, down = powers(len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint32(1)) * up[: len(points)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word characters; runs never cross rows."""
    inside = word_table()[points]
    edge = np.ones(len(points) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = inside[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit id of every run of `width` lower-cased words.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    points, offsets = code_points([t.lower() for t in texts])
    offsets = offsets.copy()
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, ends, rows = word_spans(points, offsets)
    words = span_hashes(points, starts, ends)
    count = np.bincount(rows, minlength=len(texts))
    first = np.cumsum(count) - count
    # Positions whose width words lie in one row, and the first position of short rows.
    place = np.arange(len(words)) - first[rows]
    room = count[rows] - place
    full = room >= width
    ids = words.copy()
    ids *= np.uint64(0xD6E8FEB86659FD93)
    for k in range(1, width):
        shifted = np.zeros_like(words)
        shifted[:-k or None] = words[k:] if k < len(words) else 0
        use = room > k
        ids[use] = (mix64(ids[use]) + shifted[use]) * np.uint64(0xD6E8FEB86659FD93)
    keep = full | ((place == 0) & (count[rows] < width))
    return rows[keep], mix64(ids[keep])


def multisets(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, times) of each distinct id of each row, ordered by row and id."""
    if not len(rows):
        return rows, ids, np.zeros(0, np.int64)
    order = np.lexsort((ids, rows))
    rows, ids = rows[order], ids[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
    at = np.flatnonzero(new)
    return rows[at], ids[at], np.diff(np.append(at, len(rows)))


def weighted(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, times) of all texts, worked out in slices that fit the processor's caches."""
    parts = []
    for start, stop in slices([len(t) for t in texts], 300_000):
        row, ids, times = multisets(*shingles(texts[start:stop], width))
        parts.append((row + start, ids, times))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (empty, empty.astype(np.uint64), empty)


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The groups of consecutive rows that agree in `keys` (numbers), each as one table."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        at = np.concatenate(([0], np.flatnonzero(change) + 1))
        for start, stop in zip(at[:-1], at[1:], strict=True):
            yield t.slice(start, stop - start)
        rest = t.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield rest
