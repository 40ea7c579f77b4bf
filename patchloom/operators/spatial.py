"""Spatial joins as grid equi-joins.

Every box is listed in the grid cells it meets and the two lists are joined on
the cell.  For inner joins a pair is kept only in its lowest common cell, so no
``distinct`` over pairs is needed.  Semi and anti joins carry the id and box
alone through the grid and stop at the first match instead of emitting pairs.
Where a cell is crowded on both sides the grid is a quadtree: such cells are cut
into four, level by level, and both sides are listed by its leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions import boxes, polygons
from patchloom.functions.boxes import SIDES, box
from patchloom.functions.geometry import GEOM_TYPE, bbox, to_crs
from patchloom.operators.lookup import attach
from patchloom.session import written

#: Largest cell list (rows, bytes) that is broadcast, known from sums beforehand.
BROADCAST_CELLS = 200_000
BROADCAST_BYTES = 64 << 20
#: A box with more cells than this has them produced by several tasks.
SPREAD_CELLS = 100_000
#: A cell that lists more boxes than this on both sides is cut into four.
CROWDED = 5_000
#: How often a cell is halved at most.
MOST_HALVINGS = 12
#: A cut must leave at most this share of the box tests, by the children that boxes meet.
WORTH_CUTTING = 0.75
LEAF = ["lv", "cx", "cy"]


def same_crs(left: DataFrame, right: DataFrame) -> None:
    """Both inputs must agree on having a ``crs`` column (values are compared in the join)."""
    if ("crs" in left.columns) != ("crs" in right.columns):
        raise ValueError("one input has a crs column and the other has none")


def _span(lo: Column, hi: Column, cell: float, tol: float) -> tuple[Column, Column]:
    return F.floor((lo - tol) / cell), F.floor((hi + tol) / cell)


def cells(
    df: DataFrame, cell: float, tol: float = 0.0, keep: Sequence[str] = (), spread: bool = False
) -> DataFrame:
    """List boxes by grid cell ``(cx, cy)``, with their first cell ``(fx, fy)``.

    With ``spread`` rows are redistributed between the two explodes, so that one
    huge box does not become one huge task.
    """
    x0, x1 = _span(F.col("x0"), F.col("x1"), cell, tol)
    y0, y1 = _span(F.col("y0"), F.col("y1"), cell, tol)
    wide = df.select(*keep, *SIDES, x0.alias("fx"), y0.alias("fy"), x1.alias("__lx"), y1.alias("__ly"))
    columns = wide.withColumn("cx", F.explode(F.sequence("fx", "__lx")))
    if spread:
        columns = columns.repartition("cx", "fy")
    return columns.withColumn("cy", F.explode(F.sequence("fy", "__ly"))).drop("__lx", "__ly")


def _width(df: DataFrame, keep: Sequence[str]) -> Column:
    """Approximate bytes of one row of the cell list."""
    types = dict(df.dtypes)
    total = F.lit(8 * 8)
    for c in keep:
        if types[c] == GEOM_TYPE:
            total = total + F.size(F.flatten(F.flatten(c))) * 24
        elif types[c] in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif types[c].startswith(("array", "map", "struct")):
            total = total + F.octet_length(F.to_json(F.struct(c)))
        else:
            total = total + 8
    return total


def cell_list_size(
    df: DataFrame, cell: float, tol: float = 0.0, keep: Sequence[str] = ()
) -> tuple[bool, bool]:
    """Whether a cell list may be broadcast, and whether a box in it has very many cells.

    Rows and bytes are summed first, without listing it.
    """
    x0, x1 = _span(F.col("x0"), F.col("x1"), cell, tol)
    y0, y1 = _span(F.col("y0"), F.col("y1"), cell, tol)
    per_box = (x1 - x0 + 1) * (y1 - y0 + 1)
    size = df.select(
        F.sum(per_box).alias("n"), F.max(per_box).alias("m"), F.sum(per_box * _width(df, keep)).alias("b")
    ).first()
    small = (size["n"] or 0) <= BROADCAST_CELLS and (size["b"] or 0) <= BROADCAST_BYTES
    return small, (size["m"] or 0) > SPREAD_CELLS


def sized_cells(
    df: DataFrame, cell: float, tol: float = 0.0, keep: Sequence[str] = (), salts: int = 0
) -> DataFrame:
    """The cell list of the right side of a join, with the join strategy it allows.

    A small list is broadcast.  Otherwise the merge hint keeps the planner from
    guessing the exploded size from the input, and adaptive execution splits
    skewed cells at run time.  With ``salts`` such a list, and only such a list,
    has a copy for each number below it in ``__salt``.
    """
    small, spread = cell_list_size(df, cell, tol, keep)
    if small:
        return F.broadcast(cells(df, cell, tol, keep))
    listed = cells(df, cell, tol, keep, spread=spread)
    if salts:
        listed = listed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return listed.hint("merge")


def _children(cell: float, tol: float, level: int) -> tuple[Column, Column, Column, Column]:
    """First and last child column and row of a cell of ``level`` that a box listed there meets.

    Sides of cells are halved exactly, so children agree with their parents.
    """
    side = cell / 2 ** (level + 1)
    x0, x1 = _span(F.col("x0"), F.col("x1"), side, tol)
    y0, y1 = _span(F.col("y0"), F.col("y1"), side, tol)
    cx, cy = F.col("cx") * 2, F.col("cy") * 2
    return F.greatest(x0, cx), F.least(x1, cx + 1), F.greatest(y0, cy), F.least(y1, cy + 1)


def _descend(listed: DataFrame, cut: DataFrame, cell: float, tol: float, level: int) -> DataFrame:
    """Boxes listed in the cells ``cut`` of ``level`` move to the children they meet; others stay."""
    ax, bx, ay, by = _children(cell, tol, level)
    below = F.flatten(
        F.transform(
            F.sequence(ax, bx),
            lambda x: F.transform(
                F.sequence(ay, by),
                lambda y: F.struct(F.lit(level + 1).alias("lv"), x.alias("cx"), y.alias("cy")),
            ),
        )
    )
    marked = attach(listed, cut.withColumn("__cut", F.lit(True)), LEAF, SIDES)
    at = F.when(F.col("__cut"), below).otherwise(F.array(F.struct(*LEAF)))
    moved = marked.withColumn("__at", F.explode(at)).drop(*LEAF, "__cut")
    return moved.select("*", "__at.*").drop("__at")


def _cuts(left: DataFrame, right: DataFrame, cell: float, tol: float) -> list[DataFrame]:
    """Cells ``(lv, cx, cy)`` to cut, a table per level, found from counts alone.

    A cell is cut where both sides list more than ``CROWDED`` boxes and the boxes
    meet so few of its children that fewer pairs are left to test. Boxes larger
    than a cell do not cut it, and copies of one place stop at ``MOST_HALVINGS``.
    """
    sides = [cells(df.select(*SIDES), cell, tol).withColumn("lv", F.lit(0)) for df in (left, right)]
    cuts = []
    for level in range(MOST_HALVINGS):
        ax, bx, ay, by = _children(cell, tol, level)
        counts = [
            df.groupBy(*LEAF)
            .agg(
                F.count(F.lit(1)).cast("double").alias(f"n{i}"),
                F.sum((bx - ax + 1) * (by - ay + 1)).cast("double").alias(f"k{i}"),
            )
            .where(F.col(f"n{i}") > CROWDED)
            for i, df in enumerate(sides)
        ]
        worth = F.col("k0") * F.col("k1") / 4 <= WORTH_CUTTING * F.col("n0") * F.col("n1")
        cut = written(counts[0].join(counts[1], LEAF).where(worth).select(*LEAF))
        if cut.isEmpty():
            break
        cuts.append(cut)
        sides = [_descend(df, cut, cell, tol, level).where(F.col("lv") == level + 1) for df in sides]
    return cuts


def leaf_lists(
    left: DataFrame, right: DataFrame, cell: float, tol: float, keep: Sequence[str], right_keep: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join listed by ``LEAF``, the leaves of one quadtree over the grid.

    With a right side small enough to be broadcast nothing is shuffled by cell
    and the grid stays as it is.
    """
    small, spread = cell_list_size(right, cell, tol, right_keep)
    lists = [cells(left, cell, tol, keep), cells(right, cell, tol, right_keep, spread=spread and not small)]
    lists = [df.drop("fx", "fy").withColumn("lv", F.lit(0)) for df in lists]
    if small:
        return lists[0], F.broadcast(lists[1])
    for level, cut in enumerate(_cuts(left, right, cell, tol)):
        lists = [_descend(df, cut, cell, tol, level) for df in lists]
    return lists[0], lists[1].hint("merge")


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    predicate: str = "intersects",
    how: str = "inner",
    cell: float = 1000.0,
    left_id: str = "id",
    tol: float = 0.0,
    suffix: str = "_right",
    exact_geometry: bool = False,
    related: DataFrame | None = None,
) -> DataFrame:
    """Join two box tables by ``intersects``, ``overlaps``, ``within`` or ``touches``.

    ``how`` is ``inner`` (one row per pair; columns of the right that also occur
    on the left get ``suffix``), ``left_semi`` or ``left_anti``.  ``cell`` should
    be near the usual box side; ``left_id`` must be unique on the left.  With
    ``exact_geometry`` the outlines in the ``geom`` columns decide, edge by edge; for
    several predicates ``related`` (``outlines.outline_relations`` of the same tables)
    has them related once.
    """
    if predicate not in boxes.PREDICATES:
        raise ValueError(f"unknown predicate {predicate}")
    same_crs(left, right)
    crs = ["crs"] if "crs" in left.columns else []
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unknown join type {how}")
    if exact_geometry:
        from patchloom.operators.outlines import outline_join  # built on this module

        return outline_join(left, right, predicate, how, cell, left_id, tol, suffix, related)
    if how == "inner":
        return _pairs(left, right, predicate, cell, tol, suffix, crs)

    right = right.select(*SIDES, *crs).distinct()  # copies of a box test alike
    lc, rc = leaf_lists(left, right, cell, tol, [left_id, *crs], crs)
    rc = _renamed(rc, [*SIDES, *crs], "__r_")
    on = boxes.PREDICATES[predicate](box(), box("__r_"), tol)
    for c in LEAF:
        on = (F.col(f"l.{c}") == F.col(f"r.{c}")) & on
    if crs:
        on = on & _crs_equal()
    hit = lc.alias("l").join(rc.alias("r"), on, "left_semi")
    return left.join(hit.select(left_id).distinct(), left_id, how)


def _crs_equal() -> Column:
    different = F.raise_error(F.lit("spatial join of different coordinate systems")).cast("boolean")
    return F.when(F.col("crs") == F.col("__r_crs"), F.lit(True)).otherwise(different)


def _renamed(df: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({n: f"{prefix}{n}" for n in names})


def _pairs(
    left: DataFrame,
    right: DataFrame,
    predicate: str,
    cell: float,
    tol: float,
    suffix: str,
    crs: list[str],
) -> DataFrame:
    keep, right_keep = ([c for c in df.columns if c not in SIDES] for df in (left, right))
    lc, rc = leaf_lists(left, right, cell, tol, keep, right_keep)
    rc = _renamed(rc, [c for c in rc.columns if c not in LEAF], "__r_")
    # the leaf that holds the lower corner of the common part, in no other leaf
    side = F.lit(cell) / F.pow(F.lit(2.0), "lv")
    first = (F.col("cx") == F.floor((F.greatest("x0", "__r_x0") - tol) / side)) & (
        F.col("cy") == F.floor((F.greatest("y0", "__r_y0") - tol) / side)
    )
    joined = lc.join(rc, LEAF).where(first)
    if crs:
        joined = joined.where(_crs_equal())
    joined = joined.where(boxes.PREDICATES[predicate](box(), box("__r_"), tol))
    out = [F.col(c) for c in left.columns]
    for c in right.columns:
        if c in crs:
            continue
        out.append(F.col(f"__r_{c}").alias(f"{c}{suffix}" if c in left.columns else c))
    return joined.select(*out)


def split_contained_edge(
    tiles: DataFrame, aoi: DataFrame, tile_id: str = "tile_id", cell: float = 1000.0
) -> DataFrame:
    """Flag tiles that lie inside an area feature; all others are edge tiles.

    Where ``aoi`` has a ``geom`` column its outline decides, else its box.
    """
    join = area_joiner(aoi)
    inside = join(tiles, aoi, "within", "left_semi", cell, tile_id).select(tile_id, F.lit(True).alias("__in"))
    return (
        tiles.join(inside, tile_id, "left")
        .withColumn("contained", F.col("__in").isNotNull())
        .drop("__in")
    )


def tiles_in_aoi(
    tiles: DataFrame,
    aoi: DataFrame,
    tile_id: str = "tile_id",
    cell: float = 1000.0,
    src_crs: str | None = None,
    dst_crs: str | None = None,
) -> DataFrame:
    """Tiles that meet the area, moved to its coordinate system first if they differ.

    One row per (tile, area feature), as an index join gives. Where ``aoi`` has a
    ``geom`` column its outline decides, else its box; tiles are taken as boxes.
    """
    if src_crs and dst_crs and src_crs != dst_crs:
        tiles = to_crs(tiles, src_crs, dst_crs, geom="geom" if "geom" in tiles.columns else None)
    return area_joiner(aoi)(tiles, aoi, "intersects", "inner", cell, tile_id)


def area_joiner(areas: DataFrame):
    """The join that takes the outlines of ``areas`` into account if there are any."""
    if "geom" not in areas.columns:
        return spatial_join
    from patchloom.operators.areas import area_join  # built on this module

    return area_join


def clip(
    df: DataFrame,
    mask: DataFrame,
    cell: float = 1000.0,
    mask_suffix: str = "_mask",
    keep_edges: bool = False,
    geometry: bool = False,
) -> DataFrame:
    """Part of every feature inside each mask feature; empty parts are dropped.

    Boxes are clipped by Columns.  With ``geometry`` the ``geom`` columns are
    clipped instead, of any outline, and the box is that of what is left.
    Contact without area is an empty part; for boxes ``keep_edges`` keeps it.
    """
    pairs = spatial_join(df, mask, "intersects", "inner", cell, suffix=mask_suffix)
    inner = boxes.intersection(box(), boxes.Box(*[F.col(f"{s}{mask_suffix}") for s in SIDES]))
    if geometry:
        pairs = pairs.withColumn("geom", polygons.clip_udf()("geom", f"geom{mask_suffix}"))
        pairs = bbox(pairs.where(F.size("geom") > 0))
    else:
        pairs = pairs.withColumns(dict(zip(SIDES, inner)))
    if not keep_edges:
        pairs = pairs.where((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    return pairs.drop(*[f"{s}{mask_suffix}" for s in SIDES], f"geom{mask_suffix}")


def reassign_symbol(
    units: DataFrame,
    symbols: Sequence[str],
    cell: float = 1000.0,
    tol: float = 0.0,
    unit_id: str = "gid",
    symbol: str = "symbol",
    geometry: bool = False,
) -> DataFrame:
    """Give the chosen symbols to the neighbour with which they share most border.

    Neighbours are units of other symbols with a common border longer than zero;
    ties go to the lowest id; a unit without neighbours keeps its symbol. With
    ``geometry`` borders are those of the outlines, and lengths that are equal to six
    digits are ties.
    """
    chosen, others = units.where(F.col(symbol).isin(*symbols)), units.where(~F.col(symbol).isin(*symbols))
    if geometry:
        from patchloom.operators.outlines import LEFT, RIGHT, shared_borders  # built on this module

        named = others.select(F.col(unit_id).alias(RIGHT), F.col(symbol).alias(f"{symbol}_n"))
        sides = (side.select(F.col(unit_id).alias(key), "geom") for side, key in ((chosen, LEFT), (others, RIGHT)))
        pairs = shared_borders(*sides, cell, tol).join(named, RIGHT).withColumnsRenamed({LEFT: unit_id, RIGHT: f"{unit_id}_n"})
        length = F.round("shared", 6)
    else:
        chosen, others = (side.select(unit_id, symbol, *SIDES) for side in (chosen, others))
        pairs = spatial_join(chosen, others, "intersects", "inner", cell, unit_id, tol, "_n")
        length = boxes.shared_border(box(), boxes.Box(*[F.col(f"{s}_n") for s in SIDES]), tol)
    best = (
        pairs.withColumn("__len", length)
        .where(F.col("__len") > 0)
        .groupBy(unit_id)
        .agg(
            F.max_by(f"{symbol}_n", F.struct(F.col("__len"), -F.col(f"{unit_id}_n"))).alias("__new")
        )
    )
    return (
        units.join(best, unit_id, "left")
        .withColumn(symbol, F.coalesce("__new", symbol))
        .drop("__new")
    )


def grid_of(df: DataFrame, res: float) -> DataFrame:
    """Total bounds and the pixel grid that covers them, origin at the north-west."""
    return df.agg(
        F.min("x0").alias("left"),
        F.min("y0").alias("bottom"),
        F.max("x1").alias("right"),
        F.max("y1").alias("top"),
    ).select(
        "*",
        F.lit(float(res)).alias("res"),
        F.ceil((F.col("right") - F.col("left")) / res).alias("width"),
        F.ceil((F.col("top") - F.col("bottom")) / res).alias("height"),
    )
