"""Patch layout, pixel extraction and class shares per patch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.functions.scalar import CLASS_CODES
from patchloom.operators.lookup import attach
from patchloom.operators.spatial import area_joiner, sized_cells, spatial_join


def make_patches(
    grid: DataFrame,
    size: int,
    overlap: float,
    boundary: DataFrame,
    prefix: str | None = None,
) -> DataFrame:
    """Square patches inside a boundary feature, numbered column by column.

    Where ``boundary`` has a ``geom`` column a patch must lie inside that outline,
    else inside the feature's box.

    ``grid`` is one row with ``left, bottom, right, top, res``.  Origins step by
    ``size * res * (1 - overlap)`` from the lower left while they stay below the
    upper right.  Ids count kept patches, x outer and y inner; the count runs
    per column and a running sum over columns gives the offset.
    """
    step = F.col("res") * (size * (1 - overlap))
    side = F.col("res") * size

    def steps(lo: str, hi: str) -> Column:
        n = F.ceil((F.col(hi) - F.col(lo)) / F.col("__step"))
        return F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array()))

    columns = (
        grid.withColumns({"__step": step, "__side": side})
        .withColumn("i", steps("left", "right"))
        .repartition("i")
    )
    x0 = F.col("left") + F.col("i") * F.col("__step")
    y0 = F.col("bottom") + F.col("j") * F.col("__step")
    laid = columns.withColumn("j", steps("bottom", "top")).select(
        "i",
        "j",
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + F.col("__side")).alias("x1"),
        (y0 + F.col("__side")).alias("y1"),
    )
    cell = float(size) * float(grid.first()["res"])
    keyed = laid.withColumn("__key", F.concat_ws(":", "i", "j"))
    kept = area_joiner(boundary)(keyed, boundary, "within", "left_semi", cell, "__key")
    per_column = kept.groupBy("i").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # one row per column
    offset = per_column.select("i", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__off"))
    number = F.row_number().over(Window.partitionBy("i").orderBy("j"))
    name = f"{prefix}_" if prefix else ""
    return (
        attach(kept.withColumn("__rn", number), offset, ["i"], ["j"], how="inner")
        .withColumn("pid", F.col("__off") + F.col("__rn"))
        .withColumn("patch_id", F.concat(F.lit(f"{name}{size}_{int(overlap * 100)}_"), F.col("pid")))
        .select("pid", "patch_id", "x0", "y0", "x1", "y1")
    )


def pixel_box(pixels: DataFrame) -> DataFrame:
    """Add the box and centre of every pixel from the image's ``left, top, res``."""
    x0 = F.col("left") + F.col("px") * F.col("res_x")
    y1 = F.col("top") - F.col("py") * F.col("res_y")
    return pixels.withColumns(
        {"x0": x0, "x1": x0 + F.col("res_x"), "y1": y1, "y0": y1 - F.col("res_y")}
    )


def extract_patches(
    pixels: DataFrame,
    meta: DataFrame,
    patches: DataFrame,
    cell: float,
    keys: Sequence[str] = ("image", "band"),
    fill: float | None = None,
) -> DataFrame:
    """Pixels whose centre lies in a patch, with their place ``(col, row)`` in it.

    Patches are listed by grid cell and a pixel has exactly one cell, so this is
    an equi-join that moves every pixel once; pixels of one crowded cell are
    split over several tasks.  With ``fill`` every pixel that the patch reaches
    inside the raster is returned, ``fill`` standing where the centre is outside
    or the source has no value.
    """
    located = attach(pixels, meta, ["image"], ["px", "py"], how="inner")
    if fill is None:
        cx = F.floor((F.col("left") + (F.col("px") + 0.5) * F.col("res_x")) / cell)
        cy = F.floor((F.col("top") - (F.col("py") + 0.5) * F.col("res_y")) / cell)
        at = located.withColumns({"cx": cx, "cy": cy}).withColumn(
            "__salt", F.pmod(F.xxhash64("px", "py"), F.lit(PIXEL_SALTS)).cast("int")
        )
        listed = sized_cells(patches, cell, keep=["patch_id"], salts=PIXEL_SALTS).drop("fx", "fy")
        x = F.col("left") + (F.col("px") + 0.5) * F.col("res_x")
        y = F.col("top") - (F.col("py") + 0.5) * F.col("res_y")
        # the right and lower sides are open, as for neighbouring patches
        inside = (x >= F.col("x0")) & (x < F.col("x1")) & (y > F.col("y0")) & (y <= F.col("y1"))
        hit = at.join(listed, [c for c in ("cx", "cy", "__salt") if c in listed.columns]).where(inside)
        return hit.select("patch_id", *keys, *_place(), "v")

    per_image = pixels.select(*keys).distinct()
    frames = attach(per_image, meta, ["image"], list(keys), how="inner")
    # images are listed by cell through their whole extent
    extent = frames.select(
        *keys,
        "left",
        "top",
        "res_x",
        "res_y",
        "width",
        "height",
        F.col("left").alias("x0"),
        (F.col("top") - F.col("height") * F.col("res_y")).alias("y0"),
        (F.col("left") + F.col("width") * F.col("res_x")).alias("x1"),
        F.col("top").alias("y1"),
    )
    met = spatial_join(
        patches.select("patch_id", "x0", "y0", "x1", "y1"), extent, "intersects", "inner", cell, "patch_id"
    )
    first_x = F.floor((F.col("x0") - F.col("left")) / F.col("res_x"))
    last_x = F.ceil((F.col("x1") - F.col("left")) / F.col("res_x")) - 1
    first_y = F.floor((F.col("top") - F.col("y1")) / F.col("res_y"))
    last_y = F.ceil((F.col("top") - F.col("y0")) / F.col("res_y")) - 1
    grid = (
        met.withColumns(
            {
                "__px0": F.greatest(first_x, F.lit(0)),
                "__px1": F.least(last_x, F.col("width") - 1),
                "__py0": F.greatest(first_y, F.lit(0)),
                "__py1": F.least(last_y, F.col("height") - 1),
            }
        )
        .where((F.col("__px0") <= F.col("__px1")) & (F.col("__py0") <= F.col("__py1")))
        .withColumn("py", F.explode(F.sequence("__py0", "__py1")))
        .withColumn("px", F.explode(F.sequence("__px0", "__px1")))
    )
    x = F.col("left") + (F.col("px") + 0.5) * F.col("res_x")
    y = F.col("top") - (F.col("py") + 0.5) * F.col("res_y")
    inside = (x >= F.col("x0")) & (x < F.col("x1")) & (y > F.col("y0")) & (y <= F.col("y1"))
    source = pixels.select(*keys, F.col("px").cast("long"), F.col("py").cast("long"), "v")
    value = F.when(inside, F.coalesce("v", F.lit(fill))).otherwise(F.lit(fill))
    return grid.join(source, [*keys, "px", "py"], "left").select(
        "patch_id", *keys, *_place(), value.alias("v")
    )


#: Ways the pixels of one grid cell are split.
PIXEL_SALTS = 4


def _place() -> list[Column]:
    first_x = F.floor((F.col("x0") - F.col("left")) / F.col("res_x"))
    first_y = F.floor((F.col("top") - F.col("y1")) / F.col("res_y"))
    return [
        (F.col("px") - F.greatest(first_x, F.lit(0))).alias("col"),
        (F.col("py") - F.greatest(first_y, F.lit(0))).alias("row"),
    ]


def patch_areas(
    patch_pixels: DataFrame, codes: Mapping[str, int] = CLASS_CODES, value: str = "v"
) -> DataFrame:
    """Share of each class among a patch's pixels; pixels of no class count in the total."""
    names = list(codes)
    sums = [F.count_if(F.col(value) == float(codes[n])).alias(f"__{n}") for n in names]
    counted = patch_pixels.groupBy("patch_id").agg(F.count(F.lit(1)).alias("__all"), *sums)
    return counted.select(
        "patch_id", *[F.try_divide(F.col(f"__{n}"), F.col("__all")).alias(n) for n in names]
    )


def patch_labels(areas: DataFrame, on: str = "patch_id") -> DataFrame:
    """Presence of each class: its share is above zero."""
    return areas.select(on, *[(F.col(c) > 0).cast("int").alias(c) for c in areas.columns if c != on])
