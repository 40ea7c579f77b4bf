"""Outlines against outlines, as joins of edges with edges.

No outline is copied to another one. Edges of both sides meet on grid cells, and what
they do to each other is written as numbers along the left edge: where it is crossed,
and from where to where it runs along the other edge. These cut the left edge into
pieces, each of which lies on the other border, inside it or outside; the side of a
piece is the parity of the edges left of its middle. What all pieces of both outlines
do decides the predicates; the stretches along the other border add up to its shared
length. Parts and holes count by the even-odd rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions.geometry import bbox
from patchloom.operators import spatial
from patchloom.operators.areas import edges
from patchloom.session import written

#: Distance within which a point lies on a border, at least.
EPS = 1e-9
LEFT, RIGHT = "__left", "__right"
ENDS = ("ax", "ay", "bx", "by")
LOOKS = ("inside", "outside", "border")


def row_key(*columns: str) -> Column:
    """128 bits of a row's values; equal rows have one key."""
    return F.struct(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(7), *columns).alias("g"))


def _boxed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({
        "x0": F.least("ax", "bx"), "y0": F.least("ay", "by"), "x1": F.greatest("ax", "bx"), "y1": F.greatest("ay", "by"),
    })


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once.

    A filter on columns of a projection is moved below it with their expressions copied
    in; the rows of a generator stay as they are.
    """
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__held")
    return df.select("*", one).select(*df.columns, *(F.col(f"__held.{n}").alias(n) for n in columns))


def _cut(v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def _distance(px: Column, py: Column, ax: Column, ay: Column, dx: Column, dy: Column) -> Column:
    """From a point to the line from (ax, ay) by (dx, dy), which has a length."""
    t = _cut(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def meetings(left: DataFrame, right: DataFrame, cell: float, tol: float) -> DataFrame:
    """Pairs of edges that come within ``tol``, with what the right one does along the left one.

    ``along`` has (from, to) as shares of the left edge: the stretch that runs on the
    right edge, or a crossing, where both are one number; null if the edges only come
    near. Inputs have an id (``LEFT``, ``RIGHT``) and the ends of an edge.
    """
    near = spatial.spatial_join(_boxed(left), _boxed(right), "intersects", "inner", cell, LEFT, tol)
    ax, ay, bx, by = (F.col(c) for c in ENDS)
    cx, cy, ex, ey = (F.col(f"{c}_right") for c in ENDS)
    near = near.select(LEFT, RIGHT, *ENDS, *(f"{c}_right" for c in ENDS))
    near = _held(near, dx=bx - ax, dy=by - ay, fx=ex - cx, fy=ey - cy)
    dx, dy, fx, fy = (F.col(c) for c in ("dx", "dy", "fx", "fy"))
    across, square = dx * fy - dy * fx, dx * dx + dy * dy
    near = _held(
        near,
        t=F.try_divide((cx - ax) * fy - (cy - ay) * fx, across), u=F.try_divide((cx - ax) * dy - (cy - ay) * dx, across),
        one=((cx - ax) * dx + (cy - ay) * dy) / square, two=((ex - ax) * dx + (ey - ay) * dy) / square,
    )
    crossed = F.col("t").between(-EPS, 1 + EPS) & F.col("u").between(-EPS, 1 + EPS)
    apart = F.least(
        *(_distance(px, py, cx, cy, fx, fy) for px, py in ((ax, ay), (bx, by))),
        *(_distance(px, py, ax, ay, dx, dy) for px, py in ((cx, cy), (ex, ey))),
    )
    near = _held(
        near, lo=_cut(F.least("one", "two")), hi=_cut(F.greatest("one", "two")), cross=F.when(crossed, _cut(F.col("t"))), apart=apart
    )
    near = near.where(F.col("cross").isNotNull() | (F.col("apart") <= tol))
    lo, hi, cross = F.col("lo"), F.col("hi"), F.col("cross")
    ends_on = F.greatest(*(_distance(ax + s * dx, ay + s * dy, cx, cy, fx, fy) for s in (lo, hi))) <= tol
    runs = ((hi - lo) * F.sqrt(square) > tol) & ends_on
    along = F.when(runs, F.struct(lo.alias("from"), hi.alias("to"))).when(
        cross.isNotNull(), F.struct(cross.alias("from"), cross.alias("to"))
    )
    return _held(near, along=along).select(LEFT, RIGHT, *ENDS, "along")


def pieces(listed: DataFrame, met: DataFrame) -> DataFrame:
    """All pieces of the left edges that are listed with a right outline: middle, length, on_border."""
    keys = [LEFT, RIGHT, *ENDS]
    cuts = met.where("along is not null").groupBy(keys).agg(F.collect_list("along").alias("along"))
    cut = listed.join(cuts, keys, "left")
    none = F.array().cast(cuts.schema["along"].dataType)
    cut = cut.withColumn("along", F.coalesce("along", none))
    ends = F.transform("along", lambda s: s["from"]), F.transform("along", lambda s: s["to"])
    cut = cut.withColumn("at", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), *ends))))
    steps = F.arrays_zip(F.slice("at", 1, F.size("at") - 1).alias("a"), F.slice("at", 2, F.size("at") - 1).alias("b"))
    each = cut.select(*keys, "along", F.explode(steps).alias("s"))
    each = each.withColumn("m", (F.col("s.a") + F.col("s.b")) / 2)
    size = (F.col("s.b") - F.col("s.a")) * F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    on = F.exists("along", lambda s: (s["from"] < F.col("m")) & (F.col("m") < s["to"]))
    x, y = ((1 - F.col("m")) * F.col(f"a{c}") + F.col("m") * F.col(f"b{c}") for c in "xy")
    return each.select(
        LEFT, RIGHT, x.alias("px"), y.alias("py"), size.alias("size"), on.alias("on_border")
    ).where(F.col("size") > EPS)


def _sides(cut: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Per pair: whether pieces lie inside and outside the right outline."""
    off = cut.where("not on_border").select(LEFT, RIGHT, "px", "py").distinct().withColumn("strip", F.floor(F.col("py") / cell))
    strips = F.sequence(F.floor(F.least("ay", "by") / cell), F.floor(F.greatest("ay", "by") / cell))
    listed = right.where("ay <> by").select(RIGHT, *ENDS, F.explode(strips).alias("strip"))
    x = F.col("ax") + (F.col("py") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    passed = ((F.col("ay") > F.col("py")) != (F.col("by") > F.col("py"))) & (x < F.col("px"))
    odd = off.join(listed, [RIGHT, "strip"]).where(passed).groupBy(LEFT, RIGHT, "px", "py").count()
    odd = odd.where("count % 2 = 1").select(LEFT, RIGHT, "px", "py", F.lit(True).alias("in"))
    seen = off.join(odd, [LEFT, RIGHT, "px", "py"], "left").withColumn("in", F.coalesce("in", F.lit(False)))
    return seen.groupBy(LEFT, RIGHT).agg(F.bool_or("in").alias("inside"), F.bool_or(~F.col("in")).alias("outside"))


def _seen_from(left: DataFrame, right: DataFrame, right_boxes: DataFrame, met: DataFrame, cell: float, tol: float):
    """Per pair: inside, outside, border, whether left pieces are there."""
    listed = spatial.spatial_join(_boxed(left), right_boxes, "intersects", "inner", cell, LEFT, tol)
    listed = written(listed.select(LEFT, RIGHT, *ENDS).distinct())
    cut = written(pieces(listed, met))
    border = cut.groupBy(LEFT, RIGHT).agg(F.bool_or("on_border").alias("border"))
    # edges beyond the other's bounds lie outside it
    here = listed.groupBy(LEFT, RIGHT).agg(F.count("*").alias("here"))
    total = left.select(LEFT, *ENDS).distinct().groupBy(LEFT).agg(F.count("*").alias("total"))
    beyond = here.join(total, LEFT).select(LEFT, RIGHT, (F.col("here") < F.col("total")).alias("beyond"))
    return beyond.join(border, [LEFT, RIGHT], "left").join(_sides(cut, right, cell), [LEFT, RIGHT], "left").select(
        LEFT, RIGHT,
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("inside", "border")),
        (F.coalesce("outside", F.lit(False)) | F.col("beyond")).alias("outside"),
    )


def shared_borders(left: DataFrame, right: DataFrame, cell: float, tol: float = EPS) -> DataFrame:
    """Per pair of outlines the length of the left border that runs on the right one within ``tol``, if any does."""
    tol = max(tol, EPS)
    met = meetings(edges(left, LEFT), edges(right, RIGHT), cell, tol).where("along.from < along.to")
    reach = F.aggregate(
        F.array_sort(F.collect_list("along")),
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("at")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["to"] - F.greatest(s["from"], a["at"]), F.lit(0.0))).alias("n"),
            F.greatest(a["at"], s["to"]).alias("at"),
        ),
        lambda a: a["n"],
    )
    per_edge = met.groupBy(LEFT, RIGHT, *ENDS).agg(reach.alias("share"))
    size = F.col("share") * F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return per_edge.groupBy(LEFT, RIGHT).agg(F.sum(size).alias("shared"))


def relate_outlines(left: DataFrame, right: DataFrame, cell: float, tol: float = EPS) -> DataFrame:
    """How outlines relate, a row per pair with bounds that meet.

    ``left`` has ``LEFT`` (id) and geom, ``right`` ``RIGHT`` and geom. Result: both ids,
    intersects, within (left in right), overlaps, touches.
    """
    tol = max(tol, EPS)
    one, two = written(edges(left, LEFT)), written(edges(right, RIGHT))
    boxes = [written(bbox(side.select(key, "geom")).drop("geom")) for side, key in ((left, LEFT), (right, RIGHT))]
    there = written(meetings(one, two, cell, tol))
    # the same with the sides changed
    one_, two_ = one.withColumnRenamed(LEFT, RIGHT), two.withColumnRenamed(RIGHT, LEFT)
    back = written(meetings(two_, one_, cell, tol))
    seen = _seen_from(one, two, boxes[1], there, cell, tol)
    other = _seen_from(two_, one_, boxes[0].withColumnRenamed(LEFT, RIGHT), back, cell, tol)
    other = other.select(
        F.col(RIGHT).alias(LEFT), F.col(LEFT).alias(RIGHT), *(F.col(c).alias(f"{c}_of_right") for c in LOOKS)
    )
    contact = there.select(LEFT, RIGHT).distinct().withColumn("contact", F.lit(True))
    both = spatial.spatial_join(boxes[0], boxes[1], "intersects", "inner", cell, LEFT, tol).select(LEFT, RIGHT)
    for side in (seen, other, contact):
        both = both.join(side, [LEFT, RIGHT], "left")
    yes = {c: F.coalesce(c, F.lit(False)) for c in ("contact", *LOOKS, *(f"{c}_of_right" for c in LOOKS))}
    # no border at all of one outline may be near the other, if that lies around it or beside it
    same = ~yes["outside"] & ~yes["outside_of_right"] & yes["border"] & yes["border_of_right"]
    interior = yes["inside"] | yes["inside_of_right"] | same
    within = interior & ~yes["outside"] & ~yes["inside_of_right"]
    around = interior & ~yes["outside_of_right"] & ~yes["inside"]
    meet = interior | yes["border"] | yes["border_of_right"] | yes["contact"]
    return both.select(
        LEFT, RIGHT, meet.alias("intersects"), within.alias("within"), (interior & ~within & ~around).alias("overlaps"),
        (meet & ~interior).alias("touches"),
    )


def outline_relations(left: DataFrame, right: DataFrame, cell: float, left_id: str, tol: float = 0.0) -> DataFrame:
    """``relate_outlines`` of two tables, written: joins of them by several predicates can share it."""
    keyed = right.select(row_key(*right.columns).alias(RIGHT), "geom").dropDuplicates([RIGHT])
    return written(relate_outlines(left.select(F.col(left_id).alias(LEFT), "geom"), keyed, cell, tol))


def outline_join(
    left: DataFrame, right: DataFrame, predicate: str, how: str, cell: float, left_id: str, tol: float, suffix: str,
    related: DataFrame | None = None,
) -> DataFrame:
    """``spatial_join`` by outlines; columns of both sides join the pairs at the end."""
    keyed = right.withColumn(RIGHT, row_key(*right.columns))
    if related is None:
        one = left.select(F.col(left_id).alias(LEFT), "geom")
        related = relate_outlines(one, keyed.select(RIGHT, "geom").dropDuplicates([RIGHT]), cell, tol)
    pairs = related.where(predicate).select(F.col(LEFT).alias(left_id), RIGHT)
    if how != "inner":
        return left.join(pairs.select(left_id).distinct(), left_id, how)
    names = {c: f"{c}{suffix}" if c in left.columns else c for c in right.columns}
    keyed = keyed.select(RIGHT, *(F.col(c).alias(n) for c, n in names.items()))
    kept = [n for c, n in names.items() if c != "crs" or "crs" not in left.columns]
    return left.join(pairs, left_id).join(keyed, RIGHT).select(*left.columns, *kept)
