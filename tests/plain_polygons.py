"""Predicates, shared borders and scan lines of outlines, vertex by vertex, to compare joins with."""

import numpy as np

from patchloom.functions.polygons import EPS, edges


def locate(points: np.ndarray, e: np.ndarray, tol: float = EPS) -> np.ndarray:
    """1 inside, 0 on the border (within ``tol``), -1 outside, by even-odd rule."""
    px, py = points[:, :1], points[:, 1:2]
    ax, ay, bx, by = e.T
    dx, dy = bx - ax, by - ay
    t = np.clip(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0, 1)
    near = np.hypot(px - ax - t * dx, py - ay - t * dy).min(axis=1) <= tol
    spans = (ay > py) != (by > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = ax + (py - ay) * dx / dy
    inside = (spans & (px < at)).sum(axis=1) % 2 == 1
    return np.where(near, 0, np.where(inside, 1, -1))


def pieces(e: np.ndarray, cutters: np.ndarray) -> np.ndarray:
    """Edges cut wherever a cutter edge crosses or meets them."""
    out = []
    cx, cy = cutters[:, 0], cutters[:, 1]
    ex, ey = cutters[:, 2] - cx, cutters[:, 3] - cy
    for ax, ay, bx, by in e:
        dx, dy = bx - ax, by - ay
        den = dx * ey - dy * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((cx - ax) * ey - (cy - ay) * ex) / den
            u = ((cx - ax) * dy - (cy - ay) * dx) / den
        hit = (np.abs(den) > 0) & (u >= -EPS) & (u <= 1 + EPS)
        # ends of collinear cutters also cut
        ends = ((cutters.reshape(-1, 2) - (ax, ay)) @ (dx, dy)) / (dx * dx + dy * dy)
        ts = np.concatenate([[0.0, 1.0], t[hit], ends])
        ts = np.unique(ts[(ts >= 0) & (ts <= 1)])
        p = np.column_stack([ax + ts * dx, ay + ts * dy])
        out.append(np.hstack([p[:-1], p[1:]]))
    return np.vstack(out)


def relation(a, b, tol: float = EPS) -> dict[str, bool]:
    """The four predicates between two geometries, from where the cut edges lie."""
    ea, eb = edges(a), edges(b)
    pa, pb = pieces(ea, eb), pieces(eb, ea)
    la = locate((pa[:, :2] + pa[:, 2:]) / 2, eb, tol)
    lb = locate((pb[:, :2] + pb[:, 2:]) / 2, ea, tol)
    meet_line = (la == 0).any() or (lb == 0).any()
    interior = (la == 1).any() or (lb == 1).any()
    if not interior and (la == 0).all() and (lb == 0).all():
        interior = True  # same border on both sides
    corner = (locate(ea[:, :2], eb, tol) >= 0).any() or (locate(eb[:, :2], ea, tol) >= 0).any()
    intersects = bool(interior or meet_line or corner)
    a_in_b = bool(interior and not (la == -1).any() and not (lb == 1).any())
    b_in_a = bool(interior and not (lb == -1).any() and not (la == 1).any())
    return {
        "intersects": intersects,
        "within": a_in_b,
        "overlaps": bool(interior and not a_in_b and not b_in_a),
        "touches": bool(intersects and not interior),
    }


def shared_length(a, b, tol: float = EPS) -> float:
    """Length of the border of ``a`` that runs along the border of ``b``."""
    ea, eb = edges(a), edges(b)
    p = pieces(ea, eb)
    d = np.hypot(p[:, 2] - p[:, 0], p[:, 3] - p[:, 1])
    ends_on = np.ones(len(p), dtype=bool)
    for q in (p[:, :2], p[:, 2:], (p[:, :2] + p[:, 2:]) / 2):
        ends_on &= locate(q, eb, tol) == 0
    return float(d[ends_on].sum())


def line_spans(e: np.ndarray, y: float) -> list[tuple[float, float]]:
    """x-intervals inside the rings along one horizontal line, by even-odd rule."""
    ax, ay, bx, by = e.T
    cross = (ay > y) != (by > y)
    xs = np.sort(ax[cross] + (y - ay[cross]) * (bx - ax)[cross] / (by - ay)[cross])
    return [(float(a), float(b)) for a, b in zip(xs[::2], xs[1::2])]


def strip_spans(geom, ylo: float, yhi: float) -> list[tuple[float, float]]:
    """x-intervals that the geometry covers somewhere in ``ylo <= y <= yhi``.

    Border pieces inside the strip plus the even-odd interior at mid height
    cover every column of cells that the polygon reaches in this strip.
    """
    e = edges(geom)
    ax, ay, bx, by = e.T
    near = (np.maximum(ay, by) > ylo) & (np.minimum(ay, by) < yhi)
    spans = []
    for x0, y0, x1, y1 in e[near]:
        if y0 != y1:
            cut = np.clip([ylo, yhi], min(y0, y1), max(y0, y1))
            xs = x0 + (cut - y0) * (x1 - x0) / (y1 - y0)
        else:
            xs = np.array([x0, x1])
        spans.append((float(xs.min()), float(xs.max())))
    return spans + line_spans(e, (ylo + yhi) / 2)
