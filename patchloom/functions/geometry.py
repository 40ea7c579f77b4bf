"""Geometry arrays: ``array<polygon array<ring array<vertex array<double>>>>``."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions.projections import Stage, projection

GEOM_TYPE = "array<array<array<array<double>>>>"
# Fixed value: sphere radius of the web Mercator projection, metres.
MERCATOR_RADIUS = 6378137.0
#: Codes of plain degrees; no shift of the datum is made between them.
GEOGRAPHIC = ("EPSG:4326", "EPSG:4269")
#: Points on each side of a box whose sides do not stay straight.
SIDE_POINTS = 21


def bbox(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Add the bounding box columns of a geometry column."""
    vertices = F.flatten(F.flatten(geom))
    xs = F.transform(vertices, lambda p: p[0])
    ys = F.transform(vertices, lambda p: p[1])
    return df.withColumns(
        {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}
    )


def area(geom: str = "geom") -> Column:
    """Area covered by rings that run one way round their polygon and the other way round its holes."""

    def ring(r: Column) -> Column:
        steps = F.zip_with(
            F.slice(r, 1, F.size(r) - 1),
            F.slice(r, F.lit(2), F.size(r) - 1),
            lambda a, b: (a[0] * b[1] - b[0] * a[1]) / 2,
        )
        return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)

    return F.abs(F.aggregate(F.flatten(geom), F.lit(0.0), lambda s, r: s + ring(r)))


def explode_parts(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row per polygon of a multi-part geometry; ``part`` is its position.

    ``(feature id, part)`` is the fresh key: it needs no global numbering.
    """
    others = [c for c in df.columns if c != geom]
    parts = df.select(*others, F.posexplode(geom).alias("part", "__poly"))
    return parts.select(*others, "part", F.array("__poly").alias(geom))


def box_geom(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box as a geometry array with one closed ring."""
    corner = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    ring = F.array(*[F.array(x, y) for x, y in corner])
    return F.array(F.array(ring))


def _to_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return (
        F.radians(x) * MERCATOR_RADIUS,
        F.log(F.tan(F.lit(pi / 4) + F.radians(y) / 2)) * MERCATOR_RADIUS,
    )


def _from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return (
        F.degrees(x / MERCATOR_RADIUS),
        F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - pi / 2),
    )


def point_transform(src: str, dst: str, affine: tuple[float, ...] | None = None) -> Callable:
    """Function of two Columns for one of the supported CRS pairs."""
    if affine is not None:
        a, b, c, d, e, f = affine
        return lambda x, y: (x * a + y * b + c, x * d + y * e + f)
    steps = stages(src, dst)

    def move(x, y):
        for stage in steps:
            x, y = stage(x, y)
        return x, y

    return move


def stages(src: str, dst: str) -> list[Stage]:
    """Steps from one coordinate system over degrees to another."""
    if src == dst:
        return []
    out = []
    for crs, there, mercator in ((src, "inverse", _from_mercator), (dst, "forward", _to_mercator)):
        if crs in GEOGRAPHIC:
            continue
        known = projection(crs)
        if crs != "EPSG:3857" and known is None:
            raise ValueError(f"no transform from {src} to {dst}")
        out += [mercator] if known is None else getattr(known, there)()
    return out


def _each_vertex(geom: Column, stage: Stage) -> Column:
    return F.transform(
        geom,
        lambda poly: F.transform(
            poly, lambda ring: F.transform(ring, lambda p: F.array(*stage(p[0], p[1])))
        ),
    )


def _dense_box() -> Column:
    """The four sides of a box as one ring of ``SIDE_POINTS`` points each."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(SIDE_POINTS - 1)), lambda i: i / (SIDE_POINTS - 1))

    def side(ax, ay, bx, by):
        # the last point is the corner itself
        return F.transform(
            parts, lambda t: F.array(F.when(t == 1, bx).otherwise(ax + (bx - ax) * t), F.when(t == 1, by).otherwise(ay + (by - ay) * t))
        )

    ring = F.concat(side(x0, y0, x1, y0), side(x1, y0, x1, y1), side(x1, y1, x0, y1), side(x0, y1, x0, y0))
    return F.array(F.array(ring))


def to_crs(
    df: DataFrame, src: str, dst: str, geom: str | None = "geom", affine: tuple[float, ...] | None = None
) -> DataFrame:
    """Reproject the geometry column, or the box columns when ``geom`` is None.

    Degrees and web Mercator map axis-parallel boxes to such boxes. With any other
    projection a box becomes the box around ``SIDE_POINTS`` points of each side.
    """
    steps = [point_transform(src, dst, affine)] if affine is not None else stages(src, dst)
    straight = affine is not None or {src, dst} <= {*GEOGRAPHIC, "EPSG:3857"}
    move = point_transform(src, dst, affine)
    if geom is not None:
        if geom not in df.columns:
            raise ValueError(f"no geometry column {geom}")
        moved = F.col(geom)
        for stage in steps:
            moved = _each_vertex(moved, stage)
        df = df.withColumn(geom, moved)
        if "x0" in df.columns:
            df = bbox(df, geom)
    elif not straight:
        moved = _dense_box()
        for stage in steps:
            moved = _each_vertex(moved, stage)
        df = bbox(df.withColumn("__edge", moved), "__edge").drop("__edge")
    else:
        ax, ay = move(F.col("x0"), F.col("y0"))
        bx, by = move(F.col("x1"), F.col("y1"))
        df = df.withColumns(
            {
                "x0": F.least(ax, bx),
                "y0": F.least(ay, by),
                "x1": F.greatest(ax, bx),
                "y1": F.greatest(ay, by),
            }
        )
    return df.withColumn("crs", F.lit(dst)) if "crs" in df.columns else df
