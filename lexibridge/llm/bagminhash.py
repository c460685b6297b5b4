"""BagMinHash signatures: weighted minwise hashing of multisets.

Every element owns a Poisson process of points (time, weight level, component) that
depends on the element alone. The weight axis is discretised to whole numbers and cut
into dyadic roots [0,1) [1,2) [2,4) [4,8) ...: a root has rate m times its length, and
the bits of a point's level within its root are the path down the halvings of that root.
An element of weight w owns the points below w. Component k of a signature is the
earliest point of component k over all elements, so two multisets agree in a component
with probability sum(min) / sum(max): the weighted Jaccard similarity, without bias.

Points are drawn in time order up to a horizon by which a row's components are mostly
filled; the processes of rows with open components go on from there, so that the result
never depends on the horizon.
"""

from __future__ import annotations

import math

import numpy as np

from lexibridge.llm.arrays import mix64

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROOT = np.uint64(0xA24BAED4963EE407)
_PLACE = np.uint64(0x9FB21C651E98DF25)


def _roots(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every element the roots that start below its weight: (element, low)."""
    element, low = [np.arange(len(times))], [np.zeros(len(times), np.int64)]
    at = 1
    while len(own := np.flatnonzero(times > at)):
        element.append(own)
        low.append(np.full(len(own), at))
        at *= 2
    return np.concatenate(element), np.concatenate(low)


def signatures(rows: np.ndarray, ids: np.ndarray, times: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """uint32 array (n_rows, m). rows, ids, times: as from `multisets`. A row without elements is all 0."""
    least = np.full(n_rows * m, np.inf)
    total = np.bincount(rows, weights=times, minlength=n_rows)
    element, low = _roots(times)
    row = rows[element].astype(np.int32)
    state = mix64(ids[element] ^ (low.astype(np.uint64) * _ROOT)) + _STEP
    limit = times[element]
    time = _wait(state, low)
    span = m / np.maximum(total, 1)
    horizon = (math.log(m) + 0.5) * span
    while len(row):
        row, state, time, low, limit = _draw(least, row, state, time, low, limit, horizon, m)
        gap = np.isinf(least.reshape(n_rows, m)).any(axis=1) & (total > 0)
        if not gap.any():
            break
        horizon = np.where(gap, horizon + span, 0)
        on = gap[row]
        row, state, time, low, limit = row[on], state[on], time[on], low[on], limit[on]
    out = (mix64(least.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(n_rows, m)
    out[total == 0] = 0
    return out


def _wait(state: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Exponential waiting times at the rate of each root, its length: 1 for [0,1), else its low end."""
    u = ((mix64(state) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return -np.log(u) / np.maximum(low, 1)


def _draw(least, row, state, time, low, limit, horizon, m):
    """Lower `least` to all points before the horizons; returns every process at its first later point."""
    later = []
    end = horizon[row]
    wide = bool(len(low)) and int(low.max()) > 1
    while len(row):
        due = time < end
        off = np.flatnonzero(~due)
        later.append((row[off], state[off], time[off], low[off], limit[off]))
        on = np.flatnonzero(due)
        row, state, time, low, limit, end = row[on], state[on], time[on], low[on], limit[on], end[on]
        if not len(row):
            break
        place = mix64(state ^ _PLACE)
        index = ((place >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64) + row * np.int64(m)
        if wide:
            level = low + (place & np.uint64(0xFFFFFFFF)).astype(np.int64) % np.maximum(low, 1)
            own = level < limit
            np.minimum.at(least, index[own], time[own])
        else:
            np.minimum.at(least, index, time)
        state = state + _STEP
        time = time + _wait(state, low)
    return tuple(np.concatenate(x) for x in zip(*later, strict=True)) if later else (row, state, time, low, limit)
