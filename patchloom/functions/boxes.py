"""Predicates and measures on axis-parallel boxes ``(x0, y0, x1, y1)``.

``touching`` contact counts for ``intersects`` and ``touches`` only; the other
predicates look at interiors.  All are plain Column expressions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

SIDES = ("x0", "y0", "x1", "y1")


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box(prefix: str = "") -> Box:
    """The four side columns, each with ``prefix``."""
    return Box(*[F.col(f"{prefix}{s}") for s in SIDES])


def expand_box(df: DataFrame, d: float) -> DataFrame:
    """Push every side outwards by ``d``."""
    return df.withColumns(
        {"x0": F.col("x0") - d, "y0": F.col("y0") - d, "x1": F.col("x1") + d, "y1": F.col("y1") + d}
    )


def intersects(a: Box, b: Box, tol: float = 0.0) -> Column:
    return (
        (a.x0 <= b.x1 + tol) & (b.x0 <= a.x1 + tol) & (a.y0 <= b.y1 + tol) & (b.y0 <= a.y1 + tol)
    )


def interiors_meet(a: Box, b: Box, tol: float = 0.0) -> Column:
    return (
        (a.x0 < b.x1 - tol) & (b.x0 < a.x1 - tol) & (a.y0 < b.y1 - tol) & (b.y0 < a.y1 - tol)
    )


def within(a: Box, b: Box, tol: float = 0.0) -> Column:
    """``a`` lies inside ``b`` (shared edges allowed)."""
    return (
        (a.x0 >= b.x0 - tol) & (a.y0 >= b.y0 - tol) & (a.x1 <= b.x1 + tol) & (a.y1 <= b.y1 + tol)
    )


def overlaps(a: Box, b: Box, tol: float = 0.0) -> Column:
    """Interiors meet and neither box contains the other."""
    return interiors_meet(a, b, tol) & ~within(a, b, tol) & ~within(b, a, tol)


def touches(a: Box, b: Box, tol: float = 0.0) -> Column:
    """Boundaries meet, interiors do not."""
    return intersects(a, b, tol) & ~interiors_meet(a, b, tol)


PREDICATES = {
    "intersects": intersects,
    "overlaps": overlaps,
    "within": within,
    "touches": touches,
}


def shared_border(a: Box, b: Box, tol: float = 0.0) -> Column:
    """Length of common border of two boxes whose interiors do not meet."""
    dx = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    dy = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when(F.abs(dx) <= tol, F.greatest(dy, F.lit(0.0))).when(
        F.abs(dy) <= tol, F.greatest(dx, F.lit(0.0))
    ).otherwise(F.lit(0.0))


def intersection(a: Box, b: Box) -> Box:
    return Box(
        F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1)
    )
