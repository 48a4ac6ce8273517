"""Planar helpers over numpy arrays: hulls and line simplification of one path each."""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np

_DIRECTIONS = np.array([(np.cos(t), np.sin(t)) for t in np.linspace(0, 2 * np.pi, 33)[:-1]])
_ROUNDING = 4.0 * np.finfo(float).eps


def _turn(a, b, c) -> float:
    """Sign of the turn a -> b -> c, exact when rounding could decide it."""
    left = (b[0] - a[0]) * (c[1] - a[1])
    right = (b[1] - a[1]) * (c[0] - a[0])
    det = left - right
    if abs(det) > _ROUNDING * (abs(left) + abs(right)):
        return det
    ax, ay = Fraction(a[0]), Fraction(a[1])
    exact = (Fraction(b[0]) - ax) * (Fraction(c[1]) - ay) - (Fraction(b[1]) - ay) * (
        Fraction(c[0]) - ax)
    return float((exact > 0) - (exact < 0))


def _chain(points):
    out = []
    for p in points:
        while len(out) >= 2 and _turn(out[-2], out[-1], p) <= 0:
            out.pop()
        out.append(p)
    return out


def _drop_inner(x, y):
    """Discard points that lie clearly inside the hull of a few extreme ones."""
    pick = np.unique(np.argmax(np.outer(_DIRECTIONS[:, 0], x) + np.outer(_DIRECTIONS[:, 1], y),
                               axis=1))
    corner = _ring_of(sorted(zip(x[pick].tolist(), y[pick].tolist())))
    if len(corner) < 3:
        return x, y
    margin = 1e-9 * (np.ptp(x) + np.ptp(y)) ** 2
    inside = np.ones(x.size, bool)
    for (x1, y1), (x2, y2) in zip(corner, corner[1:] + corner[:1]):
        inside &= (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) > margin
    return x[~inside], y[~inside]


def _ring_of(points):
    points = list(dict.fromkeys(points))
    if len(points) < 3:
        return points
    return _chain(points)[:-1] + _chain(points[::-1])[:-1]


def hull(x, y) -> list[tuple[float, float]]:
    """Counter-clockwise hull corners without repetition; one or two for degenerate input."""
    keep = np.isfinite(x) & np.isfinite(y)
    x, y = x[keep], y[keep]
    if x.size > 256:
        x, y = _drop_inner(x, y)
    order = np.lexsort((y, x))
    return _ring_of(list(zip(x[order].tolist(), y[order].tolist())))


def _spread(starts, sizes):
    """All indices of the runs ``starts[i] ... starts[i] + sizes[i] - 1``, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(starts - ends + sizes, sizes)


def _farthest(x, y, i, j):
    """For each run the vertex between ``i`` and ``j`` farthest from that segment, and its distance."""
    inner = j - i - 1
    at = _spread(i + 1, inner)
    run = np.repeat(np.arange(i.size), inner)
    dx, dy = (x[j] - x[i])[run], (y[j] - y[i])[run]
    px, py = x[at] - x[i][run], y[at] - y[i][run]
    norm = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(norm > 0, np.clip((px * dx + py * dy) / norm, 0.0, 1.0), 0.0)
    gap = (px - t * dx) ** 2 + (py - t * dy) ** 2
    most = np.maximum.reduceat(gap, np.cumsum(inner) - inner)
    hits = np.flatnonzero(gap == most[run])
    _, first = np.unique(run[hits], return_index=True)
    return at[hits[first]], np.sqrt(most)


def douglas_peucker_all(x, y, offsets, tolerance: float, min_points):
    """Which vertices of the paths ``offsets[p] ... offsets[p + 1]`` are kept.

    All runs of all paths are split in rounds. A run is left whole if dropping it, after those before
    it on the path, would leave the path under its ``min_points``.
    """
    keep = np.ones(x.size, bool)
    size = np.diff(offsets)
    path = np.flatnonzero(size > 2)
    i, j = offsets[path], offsets[path + 1] - 1
    flat = []
    while i.size:
        split, gap = _farthest(x, y, i, j)
        far = gap > tolerance
        flat.append((path[~far], i[~far], j[~far]))
        path, i, split, j = path[far], i[far], split[far], j[far]
        path, i, j = np.concatenate([path, path]), np.concatenate([i, split]), np.concatenate([split, j])
        longer = j - i > 1
        path, i, j = path[longer], i[longer], j[longer]
    if not flat:
        return keep
    path, i, j = (np.concatenate(c) for c in zip(*flat))
    order = np.argsort(i)
    path, i, j = path[order], i[order], j[order]
    inner = j - i - 1
    short = size - np.bincount(path, inner, size.size).astype(np.int64) < min_points
    spare = np.where(short, size - min_points, 0)
    drop = ~short[path]
    for k in np.flatnonzero(short[path]):
        if inner[k] <= spare[path[k]]:
            spare[path[k]] -= inner[k]
            drop[k] = True
    keep[_spread(i[drop] + 1, inner[drop])] = False
    return keep


def douglas_peucker(x, y, tolerance: float, min_points: int):
    """Indices kept of one path."""
    return np.flatnonzero(douglas_peucker_all(x, y, np.array([0, x.size]), tolerance, np.array([min_points])))


def visvalingam_all(x, y, offsets, threshold: float):
    """Which vertices of all paths are kept; only paths with a triangle small enough are walked."""
    keep = np.ones(x.size, bool)
    area = np.full(x.size, np.inf)
    area[1:-1] = np.abs((x[1:-1] - x[:-2]) * (y[2:] - y[:-2]) - (x[2:] - x[:-2]) * (y[1:-1] - y[:-2])) / 2.0
    path = np.repeat(np.arange(offsets.size - 1), np.diff(offsets))
    inner = np.ones(x.size, bool)
    ends = np.concatenate([offsets[:-1], offsets[1:] - 1])
    inner[ends[(ends >= 0) & (ends < x.size)]] = False
    for p in np.unique(path[inner & (area <= threshold)]):
        lo, hi = offsets[p], offsets[p + 1]
        keep[lo:hi] = False
        keep[lo + visvalingam(x[lo:hi], y[lo:hi], threshold)] = True
    return keep


def visvalingam(x, y, threshold: float):
    """Indices kept after removing vertices whose triangle area is at most ``threshold``."""
    n = x.size
    if n < 3:
        return np.arange(n)
    xs, ys = x.tolist(), y.tolist()
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def area(a, b, c):
        return abs((xs[b] - xs[a]) * (ys[c] - ys[a]) - (xs[c] - xs[a]) * (ys[b] - ys[a])) / 2.0

    queue = [(area(i - 1, i, i + 1), i - 1, i, i + 1) for i in range(1, n - 1)]
    heapq.heapify(queue)
    while queue:
        size, a, b, c = heapq.heappop(queue)
        if size > threshold:
            break
        if not alive[b] or before[b] != a or after[b] != c:
            continue
        alive[b] = False
        after[a], before[c] = c, a
        if a > 0:
            heapq.heappush(queue, (area(before[a], a, c), before[a], a, c))
        if c < n - 1:
            heapq.heappush(queue, (area(a, c, after[c]), a, c, after[c]))
    return np.flatnonzero(alive)
