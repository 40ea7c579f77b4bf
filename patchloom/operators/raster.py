"""Raster operators on long pixels ``(keys..., px, py, v)``; NULL or absent is nodata."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.functions.geometry import bbox
from patchloom.operators.areas import edges
from patchloom.operators.lookup import attach
from patchloom.operators.spatial import sized_cells


#: Longest run of cells that is listed by one row.
RUN = 1024
#: Cells that one task lists, about.
TASK_CELLS = 1 << 19


class Grid(NamedTuple):
    """A pixel grid: north-west corner, pixel side, size."""

    left: float
    top: float
    res: float
    width: int
    height: int

    @classmethod
    def of(cls, grid: DataFrame) -> Grid:
        """From the one row of ``grid_of``."""
        r = grid.first()
        return cls(r["left"], r["top"], r["res"], int(r["width"]), int(r["height"]))

    @classmethod
    def covering(cls, left: float, bottom: float, right: float, top: float, res: float) -> Grid:
        return cls(left, top, res, ceil((right - left) / res), ceil((top - bottom) / res))


def _touched(lo: Column, hi: Column, last: int) -> Column:
    """Cells that the interval enters, cut to the grid; an edge on a cell border enters none."""
    return _cut(F.floor(lo), F.ceil(hi) - 1, last)


def _cut(first: Column, end: Column, last: int) -> Column:
    """Numbers ``first..end`` that are within ``0..last``."""
    a = F.greatest(first, F.lit(0).cast("long"))
    b = F.least(end, F.lit(last).cast("long"))
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def touched_cells(units: DataFrame, grid: Grid, keep: Sequence[str], geometry: bool = False) -> DataFrame:
    """Every grid cell that a box or polygon touches, as ``(keep..., py, bx, px)``.

    A feature is cut into the strips of its pixel rows, and strips into runs of
    at most ``RUN`` columns; a polygon is gone through by its edges, see
    ``border_strips`` and ``inner_strips``.  Runs are moved by ``(py, bx)`` and
    listed as cells only after that: a huge feature becomes many tasks, and
    grouping by ``(py, bx, px)`` needs no further shuffle of single cells.  Bytes of
    runs say little about cells, so the number of tasks comes from ``most_cells``;
    boxes or edges are dealt to as many, as few of them may be very many runs.
    """
    tasks = min(ceil(most_cells(units, grid, geometry) / TASK_CELLS), grid.height * ceil(grid.width / RUN))
    tasks = max(tasks, 1)
    if geometry:
        lines = rising_edges(units, keep).repartition(tasks)
        strips = border_strips(lines, grid).unionByName(inner_strips(lines, grid))
        strips = strips.select(*(F.col(f"__f.{c}").alias(c) for c in keep), "py", "__x0", "__x1")
    else:
        rows = _touched(
            (F.lit(grid.top) - F.col("y1")) / grid.res, (F.lit(grid.top) - F.col("y0")) / grid.res, grid.height - 1
        )
        strips = units.repartition(tasks).select(
            *keep, F.explode(rows).alias("py"), F.col("x0").alias("__x0"), F.col("x1").alias("__x1")
        )
    first = F.greatest(F.floor((F.col("__x0") - grid.left) / grid.res), F.lit(0).cast("long"))
    end = F.least(
        F.ceil((F.col("__x1") - grid.left) / grid.res) - 1, F.lit(grid.width - 1).cast("long")
    )
    runs = _runs(strips.select(*keep, "py", first.alias("__a"), end.alias("__b"))).repartition(tasks, "py", "bx")
    return runs.withColumn("px", F.explode(F.sequence("__a", "__b"))).drop("__a", "__b")


def most_cells(units: DataFrame, grid: Grid, geometry: bool = False) -> int:
    """At most how many different cells each feature touches, added up, from one pass over the features.

    Those of its box, cut to the grid. For an outline also no more than its edges touch
    and its rings hold; a ring lies in the triangles between its first corner and its edges.
    """
    sides, bound = units, F.lit(None)
    if geometry:
        sides = bbox(units.select("geom").where("geom is not null"))
        bound = F.aggregate(F.flatten("geom"), F.lit(0.0), lambda n, ring: n + _ring_cells(ring, grid.res))

    def span(lo: Column, hi: Column, last: int) -> Column:
        first, end = F.greatest(F.floor(lo), F.lit(0).cast("long")), F.least(F.ceil(hi) - 1, F.lit(last).cast("long"))
        return F.greatest(end - first + 1, F.lit(0).cast("long")).cast("double")

    columns = span((F.col("x0") - grid.left) / grid.res, (F.col("x1") - grid.left) / grid.res, grid.width - 1)
    rows = span((F.lit(grid.top) - F.col("y1")) / grid.res, (F.lit(grid.top) - F.col("y0")) / grid.res, grid.height - 1)
    return int(sides.agg(F.sum(F.least(columns * rows, bound))).first()[0] or 0)


def _ring_cells(ring: Column, res: float) -> Column:
    """At most how many cells the edges of a ring touch and the triangles below them hold."""
    start = F.get(ring, F.lit(0))

    def add(n: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, F.greatest(F.size(ring), F.lit(1))))
        edge = sum((F.abs(b[c] - a[c]) for c in range(2)), F.lit(0.0)) / res + 3
        fan = F.abs((a[0] - start[0]) * (b[1] - start[1]) - (b[0] - start[0]) * (a[1] - start[1]))
        return n + F.coalesce(edge + fan / res**2, F.lit(0.0))

    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(0.0), add)


def _runs(spans: DataFrame) -> DataFrame:
    """Spans ``__a..__b`` of columns cut at multiples of ``RUN``, with the number ``bx`` of the run; empty ones go."""
    blocks = F.sequence(F.floor(F.col("__a") / RUN), F.floor(F.col("__b") / RUN))
    cut = spans.where(F.col("__a") <= F.col("__b")).withColumn("bx", F.explode(blocks))
    start = F.col("bx") * RUN
    return cut.withColumns({"__a": F.greatest("__a", start), "__b": F.least("__b", start + (RUN - 1))})


def rising_edges(units: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Edges of outlines from their lower to their upper end: ``__f, ax, ay, bx, by``.

    ``__f`` has the ``keep`` columns and ``__id``, which tells features apart, equal
    ones too.  All edges of a feature come from one row, so an id means the same
    to all rows that meet in a group, however often a lost task is run again.
    """
    feature = F.struct(F.monotonically_increasing_id().alias("__id"), *keep)
    found = edges(units.select(feature.alias("__f"), "geom"), "__f")
    up = F.col("ay") <= F.col("by")
    turned = {
        n: F.when(up, F.col(n)).otherwise(F.col(m)) for n, m in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))
    }
    return found.select("__f", *(c.alias(n) for n, c in turned.items()))


def _x_at(y: Column) -> Column:
    """Where a rising edge is at the height ``y``; its ends are met exactly."""
    share = (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    return F.when(y == F.col("by"), F.col("bx")).otherwise(F.col("ax") + share)


def border_strips(lines: DataFrame, grid: Grid) -> DataFrame:
    """What the edges cover of the strips of pixel rows: ``__f, py, __x0, __x1``.

    An edge on the border of two strips is in neither, as for boxes.
    """
    rows = _touched((F.lit(grid.top) - F.col("by")) / grid.res, (F.lit(grid.top) - F.col("ay")) / grid.res, grid.height - 1)
    at = lines.withColumn("py", F.explode(rows))
    top = F.lit(grid.top) - F.col("py") * grid.res
    low, high = F.greatest("ay", F.least("by", top - grid.res)), F.least("by", F.greatest("ay", top))
    flat = F.col("ay") == F.col("by")
    one, two = F.when(flat, F.col("ax")).otherwise(_x_at(low)), F.when(flat, F.col("bx")).otherwise(_x_at(high))
    return at.select("__f", "py", F.least(one, two).alias("__x0"), F.greatest(one, two).alias("__x1"))


def inner_strips(lines: DataFrame, grid: Grid) -> DataFrame:
    """What lies inside the outlines on the middle lines of pixel rows: ``__f, py, __x0, __x1``.

    Each edge is listed in the rows whose middle line it crosses, its lower end
    included and its upper end not, so edges that share a vertex never both miss or
    both take it.  Crossings of a feature in a row are paired in order of x, by the
    even-odd rule; a group is never larger than the feature's own list of edges.
    """
    row = {c: F.floor((F.lit(grid.top) - F.col(c)) / grid.res - 0.5) for c in ("ay", "by")}
    at = lines.where("ay < by").withColumn("py", F.explode(_cut(row["by"] + 1, row["ay"], grid.height - 1)))
    y = F.lit(grid.top) - (F.col("py") + 0.5) * grid.res
    along = Window.partitionBy("__f.__id", "py").orderBy("__x0")
    paired = at.select("__f", "py", _x_at(y).alias("__x0")).withColumns(
        {"__n": F.row_number().over(along), "__x1": F.lead("__x0").over(along)}
    )
    return paired.where("__n % 2 = 1 and __x1 is not null").drop("__n")


def rasterise(
    units: DataFrame, grid: Grid, value: str, seq: str = "gid", geometry: bool = False
) -> DataFrame:
    """Burn features: every touched cell gets the value, the later feature wins.

    A NULL value still wins its cells and leaves them as nodata.
    """
    burned = touched_cells(units, grid, [value, seq], geometry)
    # a NULL value takes part, so that a later unmapped feature clears the cell
    last = F.max_by(F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))), F.col(seq))
    cells = burned.groupBy("py", "bx", "px").agg(F.nanvl(last, F.lit(None).cast("double")).alias("v"))
    return cells.select("px", "py", "v")


def burn_layers(
    layers: Sequence[DataFrame],
    names: Sequence[str],
    ref: DataFrame,
    grid: Grid,
    binary: bool = True,
    geometry: bool = False,
) -> tuple[DataFrame, dict[str, int]]:
    """Burn layers onto the cells of a reference raster, the last layer winning.

    Cells outside all layers are 0, cells where the reference has no value stay
    without one.  Returns the raster and the map of layer names to numbers.
    """
    columns = ["x0", "y0", "x1", "y1", *(["geom"] if geometry else [])]
    merged: DataFrame | None = None
    for number, layer in enumerate(layers, start=1):
        numbered = layer.select(*columns, F.lit(number).alias("__n"))
        merged = numbered if merged is None else merged.unionByName(numbered)
    cells = touched_cells(merged, grid, ["__n"], geometry)
    top = cells.groupBy("py", "bx", "px").agg(F.max("__n").alias("__n")).drop("bx")
    number = F.when(F.col("__n").isNull(), 0).otherwise(1 if binary else F.col("__n"))
    # the planner takes the cells for as few as the features, and would broadcast them
    out = ref.join(top.hint("merge"), ["px", "py"], "left").withColumn(
        "v", F.when(F.col("v").isNotNull(), number.cast("double"))
    )
    return out.drop("__n"), {"background": 0} | {n: i for i, n in enumerate(names, start=1)}


def cast_raster(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """Values as float32, the image's nodata value as NULL."""
    joined = attach(pixels, meta.select("image", "nodata"), ["image"], ["px", "py"])
    return joined.withColumn("v", F.nullif(F.col("v"), F.col("nodata")).cast("float")).drop("nodata")


def read_window(
    pixels: DataFrame, grid: Grid, bounds: tuple[float, float, float, float]
) -> DataFrame:
    """Pixels whose centre is inside ``(left, bottom, right, top)``.

    The bounds become ranges of ``px`` and ``py``, which reach the scan.
    """
    left, bottom, right, top = bounds
    px0 = ceil((left - grid.left) / grid.res - 0.5)
    px1 = ceil((right - grid.left) / grid.res - 0.5)
    py0 = ceil((grid.top - top) / grid.res - 0.5)
    py1 = ceil((grid.top - bottom) / grid.res - 0.5)
    return pixels.where(
        (F.col("px") >= px0) & (F.col("px") < px1) & (F.col("py") >= py0) & (F.col("py") < py1)
    )


def value_range(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest value."""
    return pixels.groupBy(*by).agg(F.min("v").alias("min"), F.max("v").alias("max"))


def channel_stats(pixels: DataFrame, by: Sequence[str] = ("image",)) -> DataFrame:
    """Mean and population deviation per channel, nodata skipped."""
    v = F.col("v").cast("double")
    return pixels.groupBy(*by).agg(
        F.count("v").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")
    )


def mosaic(
    pixels: DataFrame,
    meta: DataFrame,
    order: str = "tile_order",
    band: str | int | None = None,
    res: float | None = None,
) -> tuple[DataFrame, Grid]:
    """Put tiles of one band on a common grid; the first tile with a value wins.

    ``meta`` has ``(image, left, top, res, width, height, <order>)``; tiles share
    one resolution and lie on one pixel grid.  Equal orders go by image name.
    ``band`` picks one value of the ``band`` column.  With ``res`` the mosaic is
    resampled (bilinear).
    """
    if band is not None:
        pixels = pixels.where(F.col("band") == band)
    ends = meta.agg(
        F.min("left").alias("left"),
        F.max("top").alias("top"),
        F.max(F.col("left") + F.col("width") * F.col("res")).alias("right"),
        F.min(F.col("top") - F.col("height") * F.col("res")).alias("bottom"),
        F.min("res").alias("res"),
        F.max("res").alias("res_max"),
    ).first()
    if ends["res"] != ends["res_max"]:
        raise ValueError("tiles differ in resolution; resample them first")
    grid = Grid.covering(ends["left"], ends["bottom"], ends["right"], ends["top"], ends["res"])
    offsets = (F.col("left") - grid.left) / grid.res, (F.lit(grid.top) - F.col("top")) / grid.res
    on_grid = [F.when(F.abs(o - F.round(o)) < 1e-6, F.round(o)) for o in offsets]
    shift_x, shift_y = (
        F.coalesce(o, F.raise_error(F.lit("a tile is off the pixel grid of the others"))).cast("long") for o in on_grid
    )
    shifts = meta.select("image", order, shift_x.alias("__sx"), shift_y.alias("__sy"))
    placed = attach(pixels, shifts, ["image"], ["px", "py"], how="inner").select(
        (F.col("px") + F.col("__sx")).alias("px"), (F.col("py") + F.col("__sy")).alias("py"), order, "image", "v"
    )
    first = F.min_by("v", F.struct(order, "image"))
    out = placed.where(F.col("v").isNotNull()).groupBy("px", "py").agg(first.alias("v"))
    if res is None:
        return out, grid
    from patchloom.operators.focal import resample

    return resample(out, grid, res, "bilinear", keys=[])


def clip_raster(
    pixels: DataFrame,
    grid: Grid,
    boundary: DataFrame,
    cell: float,
    keys: Sequence[str] = ("band",),
    geometry: bool = False,
) -> tuple[DataFrame, Grid]:
    """Keep pixels whose centre is inside a boundary feature; crop to its extent.

    Returned pixel numbers count from the cropped corner.
    """
    ends = boundary.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    x_from = max(int((ends[0] - grid.left) // grid.res), 0)
    y_from = max(int((grid.top - ends[3]) // grid.res), 0)
    x_to = min(ceil((ends[2] - grid.left) / grid.res), grid.width)
    y_to = min(ceil((grid.top - ends[1]) / grid.res), grid.height)
    cropped = Grid(
        grid.left + x_from * grid.res, grid.top - y_from * grid.res, grid.res, x_to - x_from, y_to - y_from
    )
    near = pixels.where(F.col("px").between(x_from, x_to - 1) & F.col("py").between(y_from, y_to - 1))
    if geometry:
        at = near.withColumn("bx", F.floor(F.col("px") / RUN))
        inside = F.col("px").between(F.col("__a"), F.col("__b"))
        on = (F.col("a.py") == F.col("b.py")) & (F.col("a.bx") == F.col("b.bx")) & inside
        kept = at.alias("a").join(inner_runs(boundary, grid).alias("b"), on, "left_semi")
    else:
        # a pixel centre has exactly one grid cell, so the semi join needs no ids
        x = F.lit(grid.left) + (F.col("px") + 0.5) * grid.res
        y = F.lit(grid.top) - (F.col("py") + 0.5) * grid.res
        at = near.withColumns({"cx": F.floor(x / cell), "cy": F.floor(y / cell)})
        inside = (x >= F.col("x0")) & (x <= F.col("x1")) & (y >= F.col("y0")) & (y <= F.col("y1"))
        on = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & inside
        kept = at.alias("a").join(sized_cells(boundary, cell).alias("b"), on, "left_semi")
    return (
        kept.select(*keys, (F.col("px") - x_from).alias("px"), (F.col("py") - y_from).alias("py"), "v"),
        cropped,
    )


def inner_runs(boundary: DataFrame, grid: Grid) -> DataFrame:
    """Cells whose centre lies inside a polygon, as runs ``(py, bx, __a, __b)`` of columns.

    Of runs with one start the longest stays, so there are at most ``RUN`` of them
    for one ``(py, bx)``, however many features lie over each other.
    """
    spans = inner_strips(rising_edges(boundary), grid)
    first = F.ceil((F.col("__x0") - grid.left) / grid.res - 0.5)
    last = F.ceil((F.col("__x1") - grid.left) / grid.res - 0.5) - 1
    zero, end = F.lit(0).cast("long"), F.lit(grid.width - 1).cast("long")
    spans = spans.select("py", F.greatest(first, zero).alias("__a"), F.least(last, end).alias("__b"))
    return _runs(spans).groupBy("py", "bx", "__a").agg(F.max("__b").alias("__b"))
