"""Spatial joins, clipping, layout and splits over the derived boxes."""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from patchloom.functions.boxes import SIDES, expand_box
from patchloom.functions.geometry import area, box_geom, bbox, explode_parts, to_crs
from patchloom.functions.projections import CONICS
from patchloom.operators import dataset as D, spatial as S
from patchloom.operators.labels import split_summary
from patchloom.operators.outlines import outline_relations
from patchloom.operators.patches import make_patches
from patchloom.plans.fixtures import view, with_views
from patchloom.plans.queries_metrics import rounded
from patchloom.plans.registry import query
from patchloom.sources.geojson import feature_text, parse_features

MEET = "a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1"
TOUCH = "a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1"
A_IN_B = "a.x0 >= b.x0 and a.y0 >= b.y0 and a.x1 <= b.x1 and a.y1 <= b.y1"
B_IN_A = "b.x0 >= a.x0 and b.y0 >= a.y0 and b.x1 <= a.x1 and b.y1 <= a.y1"
OVERLAP = f"{MEET} and not ({A_IN_B}) and not ({B_IN_A})"

PATCH_CELL, TILE_CELL, UNIT_CELL = 1280.0, 3200.0, 400.0


@query(
    "spatial_join_intersects",
    with_views("tile_index aoi", f"select tile_id, aoi_id from tile_index a join aoi b on {TOUCH}"),
)
def _intersects(spark, d):
    tiles, aoi = view(spark, d, "tile_index"), view(spark, d, "aoi")
    return S.spatial_join(tiles, aoi, "intersects", cell=TILE_CELL, left_id="tile_id").select("tile_id", "aoi_id")


@query(
    "spatial_join_overlaps",
    with_views("patches aoi", f"select pid, aoi_id from patches a join aoi b on {OVERLAP}"),
)
def _overlaps(spark, d):
    patches, aoi = view(spark, d, "patches"), view(spark, d, "aoi")
    return S.spatial_join(patches, aoi, "overlaps", cell=PATCH_CELL, left_id="pid").select("pid", "aoi_id")


@query(
    "spatial_join_within",
    with_views("patches aoi", f"select pid, patch_id from patches a where exists (select 1 from aoi b where {A_IN_B})"),
)
def _within(spark, d):
    patches, aoi = view(spark, d, "patches"), view(spark, d, "aoi")
    return S.spatial_join(patches, aoi, "within", "left_semi", PATCH_CELL, "pid").select("pid", "patch_id")


@query(
    "spatial_join_touches",
    with_views("units", f"select a.gid, b.gid as neighbour from units a join units b on {TOUCH} and not ({MEET})"),
)
def _touches(spark, d):
    units = view(spark, d, "units").select("gid", "x0", "y0", "x1", "y1")
    pairs = S.spatial_join(units, units, "touches", cell=UNIT_CELL, left_id="gid", suffix="_n")
    return pairs.select("gid", F.col("gid_n").alias("neighbour"))


@query(
    "spatial_join_anti",
    with_views("tile_index units", f"select tile_id from tile_index a where not exists (select 1 from units b where {TOUCH})"),
)
def _anti(spark, d):
    tiles, units = view(spark, d, "tile_index"), view(spark, d, "units")
    return S.spatial_join(tiles, units, "intersects", "left_anti", TILE_CELL, "tile_id").select("tile_id")


@query(
    "spatial_join_tolerance",
    with_views(
        "units tile_index",
        """select gid, tile_id from units a join tile_index b
 on a.x0 <= b.x1 + 100 and b.x0 <= a.x1 + 100 and a.y0 <= b.y1 + 100 and b.y0 <= a.y1 + 100""",
    ),
)
def _tolerance(spark, d):
    units, tiles = view(spark, d, "units"), view(spark, d, "tile_index")
    return S.spatial_join(units, tiles, "intersects", cell=800.0, left_id="gid", tol=100.0).select("gid", "tile_id")


@query(
    "expand_box",
    with_views("units", "select gid, x0 - 0.1e0 as x0, y0 - 0.1e0 as y0, x1 + 0.1e0 as x1, y1 + 0.1e0 as y1 from units"),
)
def _expand(spark, d):
    return expand_box(view(spark, d, "units"), 0.1).select("gid", "x0", "y0", "x1", "y1")


@query(
    "split_contained_edge",
    with_views("tile_index aoi", f"select tile_id, exists (select 1 from aoi b where {A_IN_B}) as contained from tile_index a"),
)
def _contained(spark, d):
    tiles, aoi = view(spark, d, "tile_index"), view(spark, d, "aoi")
    return S.split_contained_edge(tiles, aoi, cell=TILE_CELL).select("tile_id", "contained")


DEG = "degrees(({0}) / 6378137e0)"
LAT = "degrees(2 * atan(exp(({0}) / 6378137e0)) - pi() / 2)"


@query(
    "tiles_in_aoi",
    with_views(
        "tile_index aoi",
        f"select tile_id, aoi_id from ta a join bo b on {TOUCH}",
        ta=f"""select tile_id, {DEG.format('x0 - 800')} as x0, {LAT.format('y0 - 800')} as y0,
 {DEG.format('x1 - 800')} as x1, {LAT.format('y1 - 800')} as y1 from tile_index""",
        bo=f"select aoi_id, {DEG.format('x0')} as x0, {LAT.format('y0')} as y0, {DEG.format('x1')} as x1, {LAT.format('y1')} as y1 from aoi",
    ),
)
def _tiles_aoi(spark, d):
    # tiles shifted off the feature borders, so that no pair hangs on the last bit
    tiles = view(spark, d, "tile_index").withColumns({c: F.col(c) - 800 for c in ("x0", "y0", "x1", "y1")})
    aoi = to_crs(view(spark, d, "aoi"), "EPSG:3857", "EPSG:4326", geom=None)
    out = S.tiles_in_aoi(tiles, aoi, cell=0.03, src_crs="EPSG:3857", dst_crs="EPSG:4326")
    return out.select("tile_id", "aoi_id")


@query(
    "to_crs",
    with_views(
        "patches",
        f"""select pid, round({DEG.format('x0')}, 6) as x0, round({LAT.format('y0')}, 6) as y0,
 round({DEG.format('x1')}, 6) as x1, round({LAT.format('y1')}, 6) as y1 from patches""",
    ),
)
def _crs(spark, d):
    out = to_crs(view(spark, d, "patches"), "EPSG:3857", "EPSG:4326", geom=None)
    return rounded(out.select("pid", "x0", "y0", "x1", "y1"), 6, "x0", "y0", "x1", "y1")


def _number(v: float) -> str:
    return f"({v:.17e})"


def _corners(x: str, y: str, middle: str, flat: float = 298.257223563) -> str:
    """SQL of box corners in another projection, from longitude ``lam`` and isometric latitude ``psi``."""
    e = _number(math.sqrt((2 - 1 / flat) / flat))
    return f"""select pid, round(min({x}), 2) as x0, round(min({y}), 2) as y0, round(max({x}), 2) as x1,
 round(max({y}), 2) as y1 from (select pid, {middle} from (select pid, lam,
 atanh(sin(phi)) - {e} * atanh({e} * sin(phi)) as psi from (select pid, x / 6378137e0 as lam,
 2 * atan(exp(y / 6378137e0)) - pi() / 2 as phi from (select pid, unnest([x0, x1, x1, x0]) as x,
 unnest([y0, y0, y1, y1]) as y from patches)))) group by pid"""


def _reprojected(spark, d, crs):
    """Outlines of patches in another projection, as their boxes."""
    patches = view(spark, d, "patches").withColumn("geom", box_geom(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    out = to_crs(patches, "EPSG:3857", crs)
    return rounded(out.select("pid", "x0", "y0", "x1", "y1"), 2, "x0", "y0", "x1", "y1")


THIRD = 1 / (2 * 298.257223563 - 1)
UTM_RADIUS = 0.9996 * 6378137.0 / (1 + THIRD) * (1 + THIRD**2 / 4 + THIRD**4 / 64)
UTM_TERMS = [
    THIRD / 2 - 2 / 3 * THIRD**2 + 5 / 16 * THIRD**3 + 41 / 180 * THIRD**4,
    13 / 48 * THIRD**2 - 3 / 5 * THIRD**3 + 557 / 1440 * THIRD**4,
    61 / 240 * THIRD**3 - 103 / 140 * THIRD**4,
    49561 / 161280 * THIRD**4,
]


def _utm_sum(own: str, f: str, other: str, g: str) -> str:
    return own + "".join(
        f" + {_number(a)} * {f}({2 * j} * {own}) * {g}({2 * j} * {other})" for j, a in enumerate(UTM_TERMS, 1)
    )


@query(
    "to_crs_utm",
    with_views(
        "patches",
        _corners(
            f"500000e0 + {_number(UTM_RADIUS)} * ({_utm_sum('eta', 'sinh', 'xi', 'cos')})",
            f"{_number(UTM_RADIUS)} * ({_utm_sum('xi', 'sin', 'eta', 'cosh')})",
            "atan2(sinh(psi), cos(lam - radians(3))) as xi, atanh(sin(lam - radians(3)) / cosh(psi)) as eta",
        ),
    ),
)
def _utm(spark, d):
    return _reprojected(spark, d, "EPSG:32631")


CONE, CONE_EQUATOR, CONE_ORIGIN = CONICS["EPSG:3034"].cone()


@query(
    "to_crs_conic",
    with_views(
        "patches",
        _corners(
            "4000000e0 + r * sin(angle)",
            f"2800000e0 + {_number(CONE_ORIGIN)} - r * cos(angle)",
            f"{_number(CONE)} * (lam - radians(10)) as angle, {_number(CONE_EQUATOR)} * exp(-{_number(CONE)} * psi) as r",
            298.257222101,
        ),
    ),
)
def _conic(spark, d):
    return _reprojected(spark, d, "EPSG:3034")


@query(
    "clip",
    with_views(
        "units aoi",
        f"""select gid, aoi_id, greatest(a.x0, b.x0) as x0, greatest(a.y0, b.y0) as y0,
 least(a.x1, b.x1) as x1, least(a.y1, b.y1) as y1 from units a join aoi b on {MEET}""",
    ),
)
def _clip(spark, d):
    out = S.clip(view(spark, d, "units"), view(spark, d, "aoi"), cell=800.0)
    return out.select("gid", "aoi_id", "x0", "y0", "x1", "y1")


CHOSEN = "('FURNITURE', 'MACHINERY')"


REASSIGN = (
    with_views(
        "units",
        """select u.gid, coalesce(n.symbol, u.symbol) as symbol from units u left join (
 select gid, symbol, row_number() over (partition by gid order by len desc, nid) as r from pairs where len > 0) n
 on n.gid = u.gid and n.r = 1""",
        pairs=f"""select a.gid, b.gid as nid, b.symbol,
 case when a.x0 = b.x1 or b.x0 = a.x1 then least(a.y1, b.y1) - greatest(a.y0, b.y0)
  else least(a.x1, b.x1) - greatest(a.x0, b.x0) end as len
 from units a join units b on {TOUCH} where a.symbol in {CHOSEN} and b.symbol not in {CHOSEN}""",
    )
)


@query("reassign_symbol", REASSIGN)
def _reassign(spark, d):
    units = view(spark, d, "units")
    return S.reassign_symbol(units, ["FURNITURE", "MACHINERY"], UNIT_CELL).select("gid", "symbol")


@query("reassign_symbol_polygon", REASSIGN)
def _reassign_polygon(spark, d):
    units = view(spark, d, "units").withColumn("geom", box_geom(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    return S.reassign_symbol(units, ["FURNITURE", "MACHINERY"], UNIT_CELL, geometry=True).select("gid", "symbol")


BOUNDS = """select min(x0) as "left", min(y0) as bottom, max(x1) as "right", max(y1) as top from units"""


@query(
    "grid_of",
    with_views(
        "units",
        """select "left", bottom, "right", top, 30e0 as res, cast(ceil(("right" - "left") / 30e0) as bigint) as width,
 cast(ceil((top - bottom) / 30e0) as bigint) as height from b""",
        b=BOUNDS,
    ),
)
def _grid(spark, d):
    return S.grid_of(view(spark, d, "units"), 30.0)


@query(
    "make_patches",
    with_views(
        "units aoi",
        f"""select row_number() over (order by x0, y0) as pid,
 concat('a_256_50_', cast(row_number() over (order by x0, y0) as varchar)) as patch_id, x0, y0, x1, y1
 from p a where exists (select 1 from aoi b where {A_IN_B})""",
        b=BOUNDS,
        cols="""select unnest(range(0, cast(ceil(("right" - "left") / 640e0) as bigint))) as i, * from b""",
        grid="select unnest(range(0, cast(ceil((top - bottom) / 640e0) as bigint))) as j, * from cols",
        p="""select "left" + i * 640e0 as x0, bottom + j * 640e0 as y0, "left" + i * 640e0 + 1280e0 as x1,
 bottom + j * 640e0 + 1280e0 as y1 from grid""",
    ),
)
def _make(spark, d):
    grid = S.grid_of(view(spark, d, "units"), 5.0)
    return make_patches(grid, 256, 0.5, view(spark, d, "aoi"), "a")


# --- splits: about three percent of the patches are drawn ----------------------

SELECTED = """select * from patches order by md5(concat('111:', patch_id)), patch_id
 limit (select cast(floor(count(*) * 3 / 100) as bigint) from patches)"""
REST = f"""select * from patches a where pid not in (select pid from sel)
 and not exists (select 1 from sel b where {OVERLAP})"""
VAL = """select * from rest order by md5(concat('111:', patch_id)), patch_id
 limit (select cast(floor(count(*) * 3 / 200) as bigint) from patches)"""
TRAIN = f"""select * from rest a where pid not in (select pid from val)
 and not exists (select 1 from val b where {OVERLAP})"""


def _draw(patches: DataFrame, share: int) -> int:
    return patches.count() * 3 // share


@query("independent_split", with_views("patches", "select pid, patch_id from rest", sel=SELECTED, rest=REST))
def _split(spark, d):
    patches = view(spark, d, "patches")
    _, rest = D.independent_split(patches, _draw(patches, 100))
    return rest.select("pid", "patch_id")


@query(
    "split_shares",
    with_views(
        "patches",
        """select split, count(*) as n, cast(trunc(count(*) * 100 / sum(count(*)) over ()) as int) as percent
 from (select 'test' as split from sel union all select 'remaining' from rest) group by split""",
        sel=SELECTED,
        rest=REST,
    ),
)
def _shares(spark, d):
    patches = view(spark, d, "patches")
    test, rest = D.independent_split(patches, _draw(patches, 100))
    both = test.select(F.lit("test").alias("split")).unionByName(rest.select(F.lit("remaining").alias("split")))
    return split_summary(both)


@query(
    "train_val_test",
    with_views(
        "patches",
        """select pid, 'test' as split from sel union all select pid, 'val' from val
 union all select pid, 'train' from train""",
        sel=SELECTED,
        rest=REST,
        val=VAL,
        train=TRAIN,
    ),
)
def _three(spark, d):
    patches = view(spark, d, "patches")
    out = D.train_val_test(patches, _draw(patches, 100), _draw(patches, 200))
    return out.select("pid", "split")


# --- features as text and geometry arrays ---------------------------------------


@query(
    "geojson_features",
    with_views("patches", "select patch_id, 'Polygon' as geometry_type, x0, y0, x1, y1 from patches"),
)
def _features(spark, d):
    patches = view(spark, d, "patches")
    shaped = patches.withColumn("geom", box_geom(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    lines = shaped.select(feature_text(["patch_id"], "geom").alias("value"))
    return parse_features(lines, "patch_id string").select(
        "patch_id", "geometry_type", "x0", "y0", "x1", "y1"
    )


@query(
    "explode_parts",
    with_views(
        "units",
        """select cast(floor(gid / 40) as bigint) as strip, cast(gid % 40 as int) as part, x0, y0, x1, y1 from units""",
    ),
)
def _parts(spark, d):
    units = view(spark, d, "units").withColumn(
        "geom", box_geom(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    )
    # one multi-part feature per row of 40 units, parts in id order
    multi = units.groupBy(F.floor(F.col("gid") / 40).alias("strip")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("gid", "geom"))), lambda u: u["geom"])).alias("geom")
    )
    return bbox(explode_parts(multi)).select("strip", "part", "x0", "y0", "x1", "y1")


@query(
    "spatial_join_polygons",
    with_views("patches aoi", f"select pid, aoi_id from patches a join aoi b on {OVERLAP}"),
)
def _polygon_pairs(spark, d):
    def shaped(name):
        return view(spark, d, name).withColumn(
            "geom", box_geom(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
        )

    out = S.spatial_join(
        shaped("patches"), shaped("aoi"), "overlaps", cell=PATCH_CELL, left_id="pid", exact_geometry=True
    )
    return out.select("pid", "aoi_id")


# --- areas with slanted outlines: the lower left half of every box ---------------

#: How far a point is from the slanted side, times the sides' lengths; negative or zero is in the area.
BEYOND = "(a.{x} - b.x0) * (b.y1 - b.y0) + (a.{y} - b.y0) * (b.x1 - b.x0) - (b.x1 - b.x0) * (b.y1 - b.y0)"
IN_HALF = f"{A_IN_B} and {BEYOND.format(x='x1', y='y1')} <= 0"
# The part of a box that is also in the area's box reaches the area if its lower left corner does.
MEET_HALF = f"""{TOUCH} and (greatest(a.x0, b.x0) - b.x0) * (b.y1 - b.y0) + (greatest(a.y0, b.y0) - b.y0) * (b.x1 - b.x0)
 <= (b.x1 - b.x0) * (b.y1 - b.y0)"""


def halves(spark, d, name: str = "aoi") -> DataFrame:
    corners = [("x0", "y0"), ("x1", "y0"), ("x0", "y1"), ("x0", "y0")]
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in corners])
    return view(spark, d, name).withColumn("geom", F.array(F.array(ring)))


# A box and a half area meet inside if the lower left corner of what their bounds share is before the slanted side.
CORNER = """(greatest(a.x0, b.x0) - b.x0) * (b.y1 - b.y0) + (greatest(a.y0, b.y0) - b.y0) * (b.x1 - b.x0)
 - (b.x1 - b.x0) * (b.y1 - b.y0)"""
MEET_INSIDE = f"{MEET} and {CORNER} < 0"


@query(
    "spatial_join_outlines",
    with_views(
        "patches aoi",
        f"""select pid, aoi_id, predicate from (
 select pid, aoi_id, {MEET_INSIDE} as inner_, {IN_HALF} as in_, {B_IN_A} as around
 from patches a join aoi b on {MEET_HALF}
), (values ('intersects'), ('overlaps'), ('within'), ('touches')) p(predicate)
 where case predicate when 'intersects' then true when 'within' then in_ when 'touches' then not inner_
 else inner_ and not in_ and not around end""",
    ),
)
def _outline_pairs(spark, d):
    patches = view(spark, d, "patches").withColumn("geom", box_geom(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    areas = halves(spark, d).select("aoi_id", *SIDES, "geom")
    related = outline_relations(patches, areas, PATCH_CELL, "pid")
    found = [
        S.spatial_join(patches, areas, p, cell=PATCH_CELL, left_id="pid", exact_geometry=True, related=related).select(
            "pid", "aoi_id", F.lit(p).alias("predicate")
        )
        for p in ("intersects", "overlaps", "within", "touches")
    ]
    return reduce(DataFrame.unionAll, found)


@query(
    "split_contained_polygon",
    with_views("tile_index aoi", f"select tile_id, exists (select 1 from aoi b where {IN_HALF}) as contained from small a",
        small="select tile_id, x0 / 4 as x0, y0 / 4 as y0, x0 / 4 + 800 as x1, y0 / 4 + 800 as y1 from tile_index"),
)
def _contained_polygon(spark, d):
    tiles = view(spark, d, "tile_index").selectExpr(
        "tile_id", "x0 / 4 as x0", "y0 / 4 as y0", "x0 / 4 + 800 as x1", "y0 / 4 + 800 as y1"
    )
    return S.split_contained_edge(tiles, halves(spark, d), cell=800.0).select("tile_id", "contained")


@query(
    "tiles_in_aoi_polygon",
    with_views("tile_index aoi", f"select tile_id, aoi_id from tile_index a join aoi b on {MEET_HALF}"),
)
def _tiles_aoi_polygon(spark, d):
    tiles = view(spark, d, "tile_index")
    return S.tiles_in_aoi(tiles, halves(spark, d), cell=TILE_CELL).select("tile_id", "aoi_id")


@query(
    "make_patches_polygon",
    with_views(
        "units aoi",
        f"""select row_number() over (order by x0, y0) as pid,
 concat('a_128_50_', cast(row_number() over (order by x0, y0) as varchar)) as patch_id, x0, y0, x1, y1
 from p a where exists (select 1 from aoi b where {IN_HALF})""",
        b=BOUNDS,
        cols="""select unnest(range(0, cast(ceil(("right" - "left") / 320e0) as bigint))) as i, * from b""",
        grid="select unnest(range(0, cast(ceil((top - bottom) / 320e0) as bigint))) as j, * from cols",
        p="""select "left" + i * 320e0 as x0, bottom + j * 320e0 as y0, "left" + i * 320e0 + 640e0 as x1,
 bottom + j * 320e0 + 640e0 as y1 from grid""",
    ),
)
def _make_polygon(spark, d):
    grid = S.grid_of(view(spark, d, "units"), 5.0)
    return make_patches(grid, 128, 0.5, halves(spark, d), "a")


@query(
    "clip_polygon",
    with_views(
        "units aoi",
        """select gid, aoi_id, 1 as parts, round((s - r) * (f - p) + (h - r) * (g - f) - h / (2 * w) * (g * g - f * f), 3) as area
 from (select *, least(greatest(least(w * (1 - s / h), q), p), q) as f, least(q, w * (1 - r / h)) as g from c)
 where (s - r) * (f - p) + (h - r) * (g - f) - h / (2 * w) * (g * g - f * f) > 1e-6 and g > p""",
        c=f"""select gid, aoi_id, b.x1 - b.x0 as w, b.y1 - b.y0 as h, greatest(a.x0 - b.x0, 0) as p, least(a.x1, b.x1) - b.x0 as q,
 greatest(a.y0 - b.y0, 0) as r, least(a.y1, b.y1) - b.y0 as s from units a join aoi b on {MEET}""",
    ),
)
def _clip_polygon(spark, d):
    units = view(spark, d, "units").withColumn("geom", box_geom(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    out = S.clip(units, halves(spark, d), cell=800.0, geometry=True)
    return out.select("gid", "aoi_id", F.size("geom").alias("parts"), F.round(area(), 3).alias("area"))
