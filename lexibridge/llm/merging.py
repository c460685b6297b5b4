"""Pair merging of one run of parts, in n log n steps whatever the run's length."""

from __future__ import annotations

from collections.abc import Mapping
from heapq import heapify, heappop, heappush
from operator import add
from typing import TypeVar

Part = TypeVar("Part", str, bytes)


#: Runs of up to so many parts are merged by looking through all their pairs each time, which is faster there.
SHORT = 64


def _short(parts: list, ranks: Mapping) -> list:
    none = 1 << 60
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return parts


def merged(parts: list[Part], ranks: Mapping[Part, int]) -> list[Part]:
    """Neighbours whose union has the least rank merge first, the leftmost of equals, until none has a rank.

    The heap holds rank and place of the left part in one number; an entry whose pair has changed since
    is passed over.
    """
    parts: list = list(parts)
    n = len(parts)
    if n <= SHORT:
        return _short(parts, ranks)
    after, before, known = list(range(1, n + 1)), list(range(-1, n - 1)), ranks.get
    heap = [rank << 32 | i for i, rank in enumerate(map(known, map(add, parts, parts[1:]))) if rank is not None]
    heapify(heap)
    while heap:
        least = heappop(heap)
        i = least & 0xFFFFFFFF
        j, left = after[i], parts[i]
        if left is None or j == n or known(left + parts[j]) != least >> 32:
            continue
        parts[i] = left = left + parts[j]
        parts[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := known(left + parts[k])) is not None:
                heappush(heap, rank << 32 | i)
        if (h := before[i]) >= 0 and (rank := known(parts[h] + left)) is not None:
            heappush(heap, rank << 32 | h)
    return [p for p in parts if p is not None]
