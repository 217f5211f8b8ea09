"""Neighbours and links of the places of one block of cells, for density.py: small arrays in a task.

A place in reach lies at most REACH cells away on each axis. Cells are sorted by their coordinates, so that those of a column
(the same first two coordinates) which are in reach stand side by side, and a search costs two look-ups for each column.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np

REACH = 2
#: Columns of cells in reach, the nearest first; pairs that are made at once.
COLUMNS = sorted(product(range(-REACH, REACH + 1), repeat=2), key=lambda d: d[0] ** 2 + d[1] ** 2)
AT_ONCE = 1 << 20


class _Grid:
    """Cells in order: the places in that order, where each cell's places start (and the end), and the cell of each place."""

    def __init__(self, cells: np.ndarray) -> None:
        at = cells - cells.min(0) + REACH
        _, self.wide, self.deep = (at.max(0) + REACH + 1).tolist()
        key = (at[:, 0] * self.wide + at[:, 1]) * self.deep + at[:, 2]
        self.order = np.argsort(key, kind="stable")
        self.keys, first, sizes = np.unique(key[self.order], return_index=True, return_counts=True)
        self.starts, self.of = np.append(first, len(key)), np.repeat(np.arange(len(first)), sizes)

    def column(self, by: tuple[int, int], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """For each cell the range of cells `by` columns and from low to high cells away."""
        mid = self.keys + (by[0] * self.wide + by[1]) * self.deep
        return np.searchsorted(self.keys, mid + low), np.searchsorted(self.keys, mid + high, "right")


def _each(low: np.ndarray, high: np.ndarray, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (number of a range, member) of all ranges low to high - 1, about `most` at a time, a range in one piece."""
    sizes = high - low
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        done = ends[begin] - sizes[begin]
        end = max(begin + 1, int(np.searchsorted(ends, done + (most or AT_ONCE), "right")))
        k = sizes[begin:end]
        yield np.repeat(np.arange(begin, end), k), np.arange(k.sum()) + np.repeat(low[begin:end] - (ends[begin:end] - k - done), k)
        begin = end


def _norm(gap: np.ndarray) -> np.ndarray:
    return np.sqrt(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2])


def cores(x: np.ndarray, cells: np.ndarray, weight: np.ndarray, own: np.ndarray, epsilon: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which places are core (told of `own` ones alone), and pairs (a, b): b lies within epsilon of a, an own place that is not core. Such a place has fewer than `least` others beside it."""
    g = _Grid(cells)
    x, weight = x[g.order], weight[g.order]
    near = np.where(np.add.reduceat(weight, g.starts[:-1])[g.of] >= least, least, 0)
    left, kept = np.flatnonzero(own[g.order] & (near < least)), []
    for by in COLUMNS:
        left = left[near[left] < least]
        if not len(left):
            break
        low, high = g.column(by, -REACH, REACH)
        for i, b in _each(g.starts[low[g.of[left]]], g.starts[high[g.of[left]]]):
            a = left[i]
            hit = _norm(x[a] - x[b]) <= epsilon
            a, b = a[hit], b[hit]
            np.add.at(near, a, weight[b])
            some = near[a] < least
            kept.append((a[some], b[some]))
    a, b = (np.concatenate(s) for s in zip(*kept, strict=True)) if kept else (np.zeros(0, int), np.zeros(0, int))
    lone = (near[a] < least) & (a != b)
    core = np.zeros(len(x), bool)
    core[g.order] = near >= least
    return core, g.order[a[lone]], g.order[b[lone]]


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (of each node its component's smallest node) after a and b are linked."""
    root = root.copy()
    while True:
        p, q = root[a], root[b]
        differ = p != q
        if not differ.any():
            return root
        a, b, p, q = a[differ], b[differ], p[differ], q[differ]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := root[root], root):
            root = up


def linked(x: np.ndarray, cells: np.ndarray, names: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell of core places one place, the smallest name, and that of all cells it is linked with: two cells with places within epsilon of one another are."""
    g = _Grid(cells)
    x, starts = x[g.order], g.starts
    low, high = np.minimum.reduceat(x, starts[:-1]), np.maximum.reduceat(x, starts[:-1])
    root, found = np.arange(len(g.keys)), []
    for by in COLUMNS:
        if by < (0, 0):
            continue
        for a, b in _each(*g.column(by, -REACH if by > (0, 0) else 1, REACH)):
            near = _norm(np.maximum(0, np.maximum(low[a] - high[b], low[b] - high[a]))) <= epsilon
            a, b = a[near], b[near]
            sure = _norm(np.maximum(high[a] - low[b], high[b] - low[a])) <= epsilon
            root = _merged(root, a[sure], b[sure])
            found.append((a[~sure], b[~sure]))
    a, b = (np.concatenate(s) for s in zip(*found, strict=True))

    def apart(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        differ = root[a] != root[b]
        return a[differ], b[differ]

    a, b = apart(a, b)
    if len(a):  # of a's places the nearest one to b's box, against b's places
        first = np.zeros(len(a), int)
        for i, p in _each(starts[a], starts[a + 1]):
            away = _norm(np.maximum(0, np.maximum(low[b[i]] - x[p], x[p] - high[b[i]])))
            best = np.lexsort((away, i))
            pairs, at = np.unique(i[best], return_index=True)
            first[pairs] = p[best[at]]
        hit = np.zeros(len(a), bool)
        for i, q in _each(starts[b], starts[b + 1]):
            hit[i[_norm(x[first[i]] - x[q]) <= epsilon]] = True
        root = _merged(root, a[hit], b[hit])
        a, b = apart(a, b)
    while len(a):  # all places of a near b's box against b's, the fewest pairs first; what is linked meanwhile is left out
        work = (starts[a + 1] - starts[a]) * (starts[b + 1] - starts[b])
        by = np.argsort(work, kind="stable")
        a, b, end = a[by], b[by], max(1, int(np.searchsorted(np.cumsum(work[by]), 4 * AT_ONCE, "right")))
        some, other, hit = a[:end], b[:end], np.zeros(end, bool)
        for i, p in _each(starts[some], starts[some + 1]):
            close = _norm(np.maximum(0, np.maximum(low[other[i]] - x[p], x[p] - high[other[i]]))) <= epsilon
            i, p = i[close], p[close]
            for j, q in _each(starts[other[i]], starts[other[i] + 1]):
                hit[i[j[_norm(x[p[j]] - x[q]) <= epsilon]]] = True
        root = _merged(root, some[hit], other[hit])
        a, b = apart(a[end:], b[end:])
    own = np.minimum.reduceat(names[g.order], starts[:-1])
    all_of = own.copy()
    np.minimum.at(all_of, root, own)
    return g.order[starts[:-1]], own, all_of[root]
