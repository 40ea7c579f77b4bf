"""Boxes against areas with real outlines, as joins of boxes with edges.

An area is never copied to the boxes it may hold. Its edges become rows that are
matched with boxes on grid cells, and two facts per (box, area) decide all
predicates: whether an edge reaches the inside of the box or only its border, and
on which side of the outline the centre of the box lies, by counting the edges to
the left of it. Holes and parts count by the even-odd rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions.boxes import SIDES
from patchloom.functions.geometry import bbox
from patchloom.operators.spatial import spatial_join

AREA = "__area"


def edges(areas: DataFrame, area: str = AREA, geom: str = "geom") -> DataFrame:
    """One row per edge: the area's id and ``ax, ay, bx, by``; rings are closed, edges without length dropped."""
    rings = areas.select(area, F.explode(F.flatten(geom)).alias("r")).where(F.size("r") > 1)
    closed = F.when(F.element_at("r", 1) == F.element_at("r", -1), F.col("r")).otherwise(
        F.concat("r", F.slice("r", 1, 1))
    )
    after = F.slice("c", 2, F.size("c") - 1)
    ends = F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), after.alias("b"))).alias("e")
    rows = rings.select(area, closed.alias("c")).select(area, ends)
    return rows.select(
        area, *[F.col(f"e.{p}")[i].alias(f"{p}{c}") for p in "ab" for i, c in enumerate("xy")]
    ).where("ax <> bx or ay <> by")


def _reach(strict: bool) -> Column:
    """Whether the edge meets the open (``strict``) or the closed box: the part of it inside both slabs."""
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    fits = F.lit(True)
    for c in "xy":
        a, b, lo, hi = F.col(f"a{c}"), F.col(f"b{c}"), F.col(f"{c}0"), F.col(f"{c}1")
        d = b - a
        one, two = F.try_divide(lo - a, d), F.try_divide(hi - a, d)
        low.append(F.coalesce(F.least(one, two), F.lit(0.0)))
        high.append(F.coalesce(F.greatest(one, two), F.lit(1.0)))
        flat = (lo < a) & (a < hi) if strict else (lo <= a) & (a <= hi)
        fits = fits & ((d != 0) | flat)
    low, high = F.greatest(*low), F.least(*high)
    return fits & ((low < high) if strict else (low <= high))


def relate(boxes: DataFrame, areas: DataFrame, box_id: str, cell: float) -> DataFrame:
    """(box id, area id) pairs whose bounding boxes meet, with ``within`` and ``intersects``.

    ``areas`` has an id ``__area`` and ``geom``; ids are unique on both sides. A box
    is within an area if no edge passes through its inside and its centre is in
    the area, and meets it if an edge reaches it or its centre is in the area.
    """
    box = boxes.select(box_id, *SIDES)
    outline = edges(areas)
    near = spatial_join(box, bbox(areas.select(AREA, "geom")).drop("geom"), "intersects", "inner", cell, box_id)
    near = near.select(box_id, AREA)

    spans = outline.withColumns(
        {
            "x0": F.least("ax", "bx"),
            "y0": F.least("ay", "by"),
            "x1": F.greatest("ax", "bx"),
            "y1": F.greatest("ay", "by"),
        }
    )
    met = spatial_join(box, spans, "intersects", "inner", cell, box_id).where(_reach(False))
    met = met.groupBy(box_id, AREA).agg(F.bool_or(_reach(True)).alias("crossed"))

    # An edge is listed in the rows of cells that it spans; a centre is in one row.
    centre = boxes.select(
        box_id, ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py")
    ).withColumn("strip", F.floor(F.col("py") / cell))
    strips = F.sequence(F.floor(F.least("ay", "by") / cell), F.floor(F.greatest("ay", "by") / cell))
    listed = outline.where("ay <> by").withColumn("strip", F.explode(strips))
    x = F.col("ax") + (F.col("py") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    left = ((F.col("ay") > F.col("py")) != (F.col("by") > F.col("py"))) & (x < F.col("px"))
    inside = centre.join(near, box_id).join(listed, [AREA, "strip"]).where(left)
    inside = inside.groupBy(box_id, AREA).agg((F.count("*") % 2 == 1).alias("inside"))

    both = near.join(met, [box_id, AREA], "left").join(inside, [box_id, AREA], "left")
    crossed, odd = F.coalesce("crossed", F.lit(False)), F.coalesce("inside", F.lit(False))
    return both.select(
        box_id, AREA, (~crossed & odd).alias("within"), (F.col("crossed").isNotNull() | odd).alias("intersects")
    )


def area_join(
    boxes: DataFrame, areas: DataFrame, predicate: str, how: str, cell: float, box_id: str, suffix: str = "_right"
) -> DataFrame:
    """Join boxes with areas by ``within`` or ``intersects``, as ``spatial_join`` does for boxes.

    Outlines travel as edges, other columns of an area join by its id at the end.
    """
    if predicate not in ("within", "intersects"):
        raise ValueError(f"no area predicate {predicate}")
    others = [c for c in areas.columns if c != "geom"]
    numbered = areas.withColumn(AREA, F.xxhash64(*areas.columns))
    once = numbered.select(AREA, "geom").dropDuplicates([AREA])
    pairs = relate(boxes, once, box_id, cell).where(predicate).select(box_id, AREA)
    if how != "inner":
        return boxes.join(pairs.select(box_id).distinct(), box_id, how)
    names = {c: f"{c}{suffix}" if c in boxes.columns else c for c in others}
    right = numbered.select(AREA, *[F.col(c).alias(n) for c, n in names.items()])
    return boxes.join(pairs, box_id).join(right, AREA).drop(AREA)
