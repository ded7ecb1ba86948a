"""Planar geometry of arrays of segments: the rules of `geometry` for many pairs at once. A
segment is a tuple (x1, y1, x2, y2) of arrays; what is missing is NaN."""

from __future__ import annotations

import numpy as np

Segments = tuple[np.ndarray, ...]


def divided(a: np.ndarray, b: np.ndarray, other: float = np.nan) -> np.ndarray:
    """a / b, `other` where b is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, other, a / b)


def length(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    dx, dy = x2 - x1, y2 - y1
    return np.sqrt(dx * dx + dy * dy)


def project(px: np.ndarray, py: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    return np.where(n > 0, np.clip(divided((px - x1) * dx + (py - y1) * dy, n), 0.0, 1.0), 0.0)


def point_segment(px: np.ndarray, py: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    t = project(px, py, x1, y1, x2, y2)
    return length(px, py, x1 + t * (x2 - x1), y1 + t * (y2 - y1))


def distance(a: Segments, b: Segments) -> np.ndarray:
    """0 where two segments cross, else the least from an end of one to the other."""
    turn = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
    across = lambda s, t: turn(s, t[0], t[1]) * turn(s, t[2], t[3]) < 0
    ends = [point_segment(s[i], s[i + 1], *t) for s, t in ((a, b), (b, a)) for i in (0, 2)]
    return np.where(across(a, b) & across(b, a), 0.0, np.fmin(np.fmin(ends[0], ends[1]), np.fmin(ends[2], ends[3])))


def abs_cosine(a: Segments, b: Segments) -> np.ndarray:
    """|cos| of two directions; 0.5 where either is missing or has no length."""
    n = length(*a) * length(*b)
    dot = (a[2] - a[0]) * (b[2] - b[0]) + (a[3] - a[1]) * (b[3] - b[1])
    return np.where(n > 0, np.minimum(np.abs(divided(dot, n)), 1.0), 0.5)


def stretch(a: Segments, b: Segments, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(low, high), from 0 to 1 along a, of what lies within `reach` of b; NaN where nothing
    does or a has no length: see geometry.segment_stretch."""
    size, long = length(*a), length(*b)
    ex, ey = divided(b[2] - b[0], long, 1.0), divided(b[3] - b[1], long, 0.0)
    u, v = (a[0] - b[0]) * ex + (a[1] - b[1]) * ey, (a[1] - b[1]) * ex - (a[0] - b[0]) * ey
    du, dv = (a[2] - a[0]) * ex + (a[3] - a[1]) * ey, (a[3] - a[1]) * ex - (a[2] - a[0]) * ey
    lows, highs = [], []
    for at in (0.0, long):
        half, far = (u - at) * du + v * dv, (u - at) * (u - at) + v * v - reach * reach
        root = half * half - size * size * far
        root = np.sqrt(np.where(root >= 0, root, np.nan))
        lows.append(divided(-half - root, size * size))
        highs.append(divided(-half + root, size * size))
    low, high = -np.inf, np.inf
    for start, step, lo, hi in ((v, dv, -reach, reach), (u, du, 0.0, long)):
        p, q = divided(lo - start, step), divided(hi - start, step)
        inside = (start >= lo) & (start <= hi)
        low = np.maximum(low, np.where(step != 0, np.minimum(p, q), np.where(inside, -np.inf, np.nan)))
        high = np.minimum(high, np.where(step != 0, np.maximum(p, q), np.where(inside, np.inf, np.nan)))
    met = low <= high
    lows.append(np.where(met, low, np.nan))
    highs.append(np.where(met, high, np.nan))
    low = np.maximum(np.fmin(np.fmin(lows[0], lows[1]), lows[2]), 0.0)
    high = np.minimum(np.fmax(np.fmax(highs[0], highs[1]), highs[2]), 1.0)
    met = (size > 0) & (low <= high)
    return np.where(met, low, np.nan), np.where(met, high, np.nan)


def cover(a: Segments, b: Segments, reach: float) -> np.ndarray:
    """Share of a that lies within `reach` of b."""
    low, high = stretch(a, b, reach)
    return np.nan_to_num(np.maximum(high - low, 0.0))


def interval(a: Segments, b: Segments, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) along a between the projections of the ends of b, and where it counts: it
    has a length, and its middle lies within the tolerance of b."""
    size = length(*a)
    p, q = (project(b[i], b[i + 1], *a) * size for i in (0, 2))
    start, end = np.minimum(p, q), np.maximum(p, q)
    at = divided((start + end) / 2, size)
    middle = point_segment(a[0] + at * (a[2] - a[0]), a[1] + at * (a[3] - a[1]), *b)
    return start, end, (end - start > 1e-6) & (middle <= tolerance)


def crossing(a: Segments, b: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y) where two segments cross, and whether they do: not at an end, not on one line."""
    den = (a[2] - a[0]) * (b[3] - b[1]) - (a[3] - a[1]) * (b[2] - b[0])
    t = divided((b[0] - a[0]) * (b[3] - b[1]) - (b[1] - a[1]) * (b[2] - b[0]), den)
    s = divided((b[0] - a[0]) * (a[3] - a[1]) - (b[1] - a[1]) * (a[2] - a[0]), den)
    return a[0] + t * (a[2] - a[0]), a[1] + t * (a[3] - a[1]), (t > 0) & (t < 1) & (s > 0) & (s < 1)


def sampled(a: Segments, b: Segments, spacing: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances from evenly spaced places of each a to its b, infinite beyond their number,
    and that number."""
    n = np.clip(np.ceil(length(*a) / max(spacing, 0.25)) + 1, 3, 101).astype(np.int64)
    k = np.arange(n.max(initial=3))
    place = lambda i: a[i][:, None] + (a[i + 2] - a[i])[:, None] * k / (n - 1)[:, None]
    off = point_segment(place(0), place(1), *[c[:, None] for c in b])
    return np.where(k < n[:, None], off, np.inf), n


def median_distance(a: Segments, b: Segments, spacing: float) -> np.ndarray:
    """Median of the distances from places of either segment to the other."""
    (p, m), (q, n) = sampled(a, b, spacing), sampled(b, a, spacing)
    every, count, row = np.sort(np.concatenate([p, q], axis=1), axis=1), m + n, np.arange(len(m))
    return (every[row, (count - 1) // 2] + every[row, count // 2]) / 2


def endpoint_score(a: Segments, b: Segments, tolerance: float) -> np.ndarray:
    """Mean nearness of the four ends to the nearest end of the other segment."""
    best = lambda s, i, t: np.minimum(length(s[i], s[i + 1], t[0], t[1]), length(s[i], s[i + 1], t[2], t[3]))
    near = [np.maximum(0.0, 1 - best(s, i, t) / max(3 * tolerance, 1e-6)) for s, t in ((a, b), (b, a)) for i in (0, 2)]
    return (near[0] + near[1] + near[2] + near[3]) / 4


def leading(groups: list[np.ndarray], order: list[np.ndarray], most: int = 1) -> np.ndarray:
    """Places of the first `most` rows, ascending by order, of each group."""
    at = np.lexsort((*order[::-1], *groups[::-1]))
    if not len(at):
        return at
    fresh = np.ones(len(at), bool)
    fresh[1:] = np.any([g[at][1:] != g[at][:-1] for g in groups], axis=0)
    row = np.arange(len(at))
    return at[row - np.maximum.accumulate(np.where(fresh, row, 0)) < most]


def united(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each id with those that overlap or touch made one: (place of a row with
    the id, start, end)."""
    at = np.lexsort((end, start, ids))
    ids, start, top = ids[at], start[at], end[at]
    if not len(at):
        return at, start, top
    fresh = np.ones(len(at), bool)
    fresh[1:] = ids[1:] != ids[:-1]
    bounds = [*np.flatnonzero(fresh), len(at)]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        top[lo:hi] = np.maximum.accumulate(top[lo:hi])
    fresh[1:] |= start[1:] > top[:-1]
    first = np.flatnonzero(fresh)
    return at[first], start[first], top[np.append(first[1:], len(at)) - 1]
