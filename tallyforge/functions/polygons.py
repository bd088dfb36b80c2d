"""Outlines of strips and the area by which two polygons differ, on flat arrays of numbers."""

from __future__ import annotations

import math

import numpy as np


def mitred(path: list[tuple[float, float]], half: float, limit: float = 100.0) -> list[tuple[float, float]] | None:
    """The outline of a strip of twice ``half`` around a path: ends cut square, corners where the offset lines meet. None if a corner is sharper than ``limit`` halves or the path turns back."""
    p = np.array(path, float)
    d = np.diff(p, axis=0)
    size = np.hypot(d[:, 0], d[:, 1])
    if len(p) < 2 or (size <= 0).any():
        return None
    d /= size[:, None]
    normal = np.stack([-d[:, 1], d[:, 0]], 1)
    # a corner's offset is along the sum of both normals, longer the sharper it is
    both = normal[:-1] + normal[1:]
    square = (both**2).sum(1)
    if (square < 4 / limit**2).any():
        return None
    offset = np.concatenate([normal[:1], 2 * both / square[:, None] if len(both) else both, normal[-1:]]) * half
    return [tuple(x) for x in np.concatenate([p + offset, (p - offset)[::-1]])]


def crosses_itself(path: list[tuple[float, float]]) -> bool:
    """Whether two stretches of a path that aren't neighbours touch, or it turns back on itself."""
    p = np.array(path, float)
    a, b = p[:-1], p[1:]
    turn = lambda o, s, t: (s[..., 0] - o[..., 0]) * (t[..., 1] - o[..., 1]) - (s[..., 1] - o[..., 1]) * (t[..., 0] - o[..., 0])
    i, j = np.triu_indices(len(a), 2)
    one, two = turn(a[i], b[i], a[j]) * turn(a[i], b[i], b[j]), turn(a[j], b[j], a[i]) * turn(a[j], b[j], b[i])
    low, high = np.minimum(a, b), np.maximum(a, b)
    boxes = ((low[i] <= high[j]) & (low[j] <= high[i])).all(1)
    back = [turn(x, y, z) == 0 and (y - x) @ (z - y) < 0 for x, y, z in zip(p, p[1:], p[2:])]
    return bool(((one <= 0) & (two <= 0) & boxes).any() or any(back))


def difference_area(one: list[tuple[float, float]], two: list[tuple[float, float]]) -> float:
    """The area that just one of two polygons covers.

    The plane is cut in levels at all corners and crossings. Within a level no edges cross, so between neighbouring edges lies a trapezoid that each polygon
    covers or not, by the number of its edges to the left.
    """
    edges, owner = [], []
    for which, polygon in enumerate((one, two)):
        p = np.array(polygon, float)
        edges.append(np.concatenate([p, np.roll(p, -1, 0)], 1))
        owner += [which] * len(p)
    e, owner = np.concatenate(edges), np.array(owner)
    down = e[:, 1] > e[:, 3]
    e[down] = e[down][:, [2, 3, 0, 1]]
    flat = e[:, 1] == e[:, 3]
    levels = [e[:, 1], e[:, 3]]
    e, owner = e[~flat], owner[~flat]
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    start = e[:, 0] - slope * e[:, 1]
    i, j = np.triu_indices(len(e), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        y = (start[j] - start[i]) / (slope[i] - slope[j])
    levels.append(y[(y > np.maximum(e[i, 1], e[j, 1])) & (y < np.minimum(e[i, 3], e[j, 3]))])
    y = np.unique(np.concatenate(levels))
    area = 0.0
    for low, high in zip(y, y[1:]):
        mid = (low + high) / 2
        here = np.flatnonzero((e[:, 1] <= low) & (e[:, 3] >= high))
        x = start[here] + slope[here] * mid
        order = np.argsort(x)
        x, who = x[order], owner[here][order]
        odd = (np.cumsum(who == 0) + np.cumsum(who == 1)) % 2 == 1  # covered by one of them alone
        area += float((np.diff(x) * odd[:-1]).sum() * (high - low))
    return area


def polygon_area(polygon: list[tuple[float, float]]) -> float:
    return abs(math.fsum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1]))) / 2
