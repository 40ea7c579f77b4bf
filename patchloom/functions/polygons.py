"""Small numpy helpers for polygons with holes, used on candidate pairs only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

EPS = 1e-9


def rings(geom) -> list[np.ndarray]:
    """All rings of a geometry array as closed ``(n, 2)`` arrays."""
    out = []
    for polygon in geom:
        for ring in polygon:
            r = np.array([[p[0], p[1]] for p in ring], dtype=float)
            out.append(r if np.array_equal(r[0], r[-1]) else np.vstack([r, r[:1]]))
    return out


def edges(geom) -> np.ndarray:
    """Edges ``(ax, ay, bx, by)`` of every ring; zero-length ones are dropped."""
    parts = [np.hstack([r[:-1], r[1:]]) for r in rings(geom)]
    e = np.vstack(parts)
    return e[(e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])]


def _levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights of all vertices, and of all points where an edge of ``a`` crosses one of ``b``."""
    ax, ay, dx, dy = a[:, 0, None], a[:, 1, None], (a[:, 2] - a[:, 0])[:, None], (a[:, 3] - a[:, 1])[:, None]
    cx, cy, ex, ey = b[:, 0], b[:, 1], b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
    den = dx * ey - dy * ex
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((cx - ax) * ey - (cy - ay) * ex) / den
        u = ((cx - ax) * dy - (cy - ay) * dx) / den
        hit = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        crossings = (ay + t * dy)[hit]
    return np.unique(np.concatenate([a[:, 1], a[:, 3], b[:, 1], b[:, 3], crossings]))


def clip_to(geom, mask) -> list:
    """Part of ``geom`` inside ``mask``; both may be concave, in parts and with holes.

    Between two neighbouring heights no edges cross, so what both cover there are
    trapezoids. Trapezoids that meet in a whole side are one part; parts that an
    outline joins at a branch keep a common side.
    """
    ea, eb = edges(geom), edges(mask)
    e, of_a = np.vstack([ea, eb]), np.arange(len(ea) + len(eb)) < len(ea)
    e = np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)

    def x_at(i: np.ndarray, y: float) -> np.ndarray:
        ax, ay, bx, by = e[i].T
        return np.where(y == ay, ax, np.where(y == by, bx, ax + (y - ay) * (bx - ax) / (by - ay)))

    done, growing = [], []
    ys = _levels(ea, eb)
    for lo, hi in zip(ys[:-1], ys[1:]):
        active = np.flatnonzero((e[:, 1] <= lo) & (e[:, 3] >= hi))
        active = active[np.argsort(x_at(active, (lo + hi) / 2), kind="stable")]
        both = (np.cumsum(of_a[active]) % 2 == 1) & (np.cumsum(~of_a[active]) % 2 == 1)
        below, above = x_at(active, lo), x_at(active, hi)
        runs = np.flatnonzero(np.diff(np.r_[False, both, False]))
        still = []
        for i, j in zip(runs[::2], runs[1::2]):
            if abs(below[j] - below[i]) + abs(above[j] - above[i]) <= EPS:
                continue
            for k, (left, right) in enumerate(growing):
                if abs(left[-1][0] - below[i]) <= EPS and abs(right[-1][0] - below[j]) <= EPS:
                    part = growing.pop(k)
                    break
            else:
                part = [(below[i], lo)], [(below[j], lo)]
            part[0].append((above[i], hi))
            part[1].append((above[j], hi))
            still.append(part)
        done += growing
        growing = still
    rings_ = [_ring(left, right) for left, right in done + growing]
    return [[r] for r in rings_ if len(r) > 3]


def _ring(left: list, right: list) -> list[list[float]]:
    """A closed ring up the right side and down the left one, without points on straight lines."""
    points = right + left[::-1]
    points = [p for i, p in enumerate(points) if max(abs(p[0] - points[i - 1][0]), abs(p[1] - points[i - 1][1])) > EPS]
    kept = []
    for i, (x, y) in enumerate(points):
        (px, py), (nx, ny) = points[i - 1], points[(i + 1) % len(points)]
        if abs((x - px) * (ny - y) - (y - py) * (nx - x)) > EPS:
            kept.append([float(x), float(y)])
    return [*kept, *kept[:1]]


def clip_udf():
    """Arrow-batched ``clip_to``."""

    @F.pandas_udf("array<array<array<array<double>>>>")
    def clip(geom: pd.Series, mask: pd.Series) -> pd.Series:
        return pd.Series([clip_to(g, m) for g, m in zip(geom, mask)], dtype=object)

    return clip
