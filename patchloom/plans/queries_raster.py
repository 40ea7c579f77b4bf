"""Raster, patch and sample queries over the derived pixels."""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame, functions as F

from patchloom.functions.boxes import expand_box
from patchloom.functions.scalar import PATCH_FILL, SLIVER_TOLERANCE, encode_class, scale_rgb
from patchloom.operators import dataset as D, focal as N, patches as P, raster as R, spatial as S
from patchloom.plans.fixtures import SEGMENT_CODES, raster_side, view, with_views
from patchloom.plans.queries_metrics import rounded
from patchloom.plans.registry import query
from patchloom.session import local_table

# In SQL $N stands for the side of the derived raster in pixels and $E for its extent.


def grid(spark, d) -> R.Grid:
    """The derived raster: pixels of 5 units, lower left corner at the origin, a side that grows with the table."""
    n = raster_side(spark, d)
    return R.Grid(0.0, n * 5.0, 5.0, n, n)


def raster(spark, d) -> DataFrame:
    return view(spark, d, "raster")


def band_meta(spark, d, bands="ANR") -> DataFrame:
    g = grid(spark, d)
    return local_table(
        spark,
        [(b, g.left, g.top, g.res, g.res, g.width, g.height, 50.0) for b in bands],
        "image string, left double, top double, res_x double, res_y double, width int, height int, nodata double",
    )


# --- statistics, casts, windows ----------------------------------------------


@query(
    "channel_stats",
    with_views("raster", "select band, count(v) as n, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from raster group by band"),
)
def _stats(spark, d):
    return rounded(R.channel_stats(raster(spark, d), ["band"]), 6, "mean", "std")


@query(
    "normalise",
    with_views(
        "raster",
        """select band as image, px, py, round(case when band = 'A' then v else (v - mean) / std end, 6) as v
 from raster join st using (band)""",
        st="select band, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from raster group by band",
    ),
)
def _normalise(spark, d):
    pixels = raster(spark, d).withColumnRenamed("band", "image")
    stats = rounded(R.channel_stats(pixels), 6, "mean", "std").where("image <> 'A'")
    return rounded(D.normalise(pixels, stats), 6, "v")


@query(
    "minmax_scale",
    with_views(
        "chips",
        """select image, px, py, round((v - lo) / nullif(hi - lo, 0), 6) as v from (
 select *, min(v) over (partition by image) as lo, max(v) over (partition by image) as hi from chips)""",
    ),
)
def _minmax(spark, d):
    out = D.minmax_scale(view(spark, d, "chips").drop("label"))
    return rounded(out, 6, "v")


@query("scale_rgb", with_views("raster", "select band, px, py, round(v / 255e0, 12) as v from raster"))
def _rgb(spark, d):
    return raster(spark, d).withColumn("v", F.round(scale_rgb(F.col("v")), 12))


@query(
    "cast_raster",
    with_views("raster", "select band as image, px, py, cast(nullif(v, 50) as float) as v from raster"),
)
def _cast(spark, d):
    return R.cast_raster(raster(spark, d).withColumnRenamed("band", "image"), band_meta(spark, d))


@query(
    "read_window",
    with_views(
        "raster",
        """select band, min(v) as min, max(v) as max from raster
 where (px + 0.5) * 5 between 300 and 900 and $E - (py + 0.5) * 5 between 200 and 1000 group by band""",
    ),
)
def _window(spark, d):
    return R.value_range(R.read_window(raster(spark, d), grid(spark, d), (300.0, 200.0, 900.0, 1000.0)), ["band"])


# --- burning -------------------------------------------------------------------

BURN_GRID = """select min(x0) - 0.1e0 as w, max(y1) + 0.1e0 as t,
 cast(ceil((max(x1) + 0.1e0 - (min(x0) - 0.1e0)) / 30e0) as bigint) as gw,
 cast(ceil((max(y1) + 0.1e0 - (min(y0) - 0.1e0)) / 30e0) as bigint) as gh from units"""
SPAN = """select gid, code, unnest(range(greatest(cast(floor((x0 - 0.1e0 - w) / 30e0) as bigint), 0),
 least(cast(ceil((x1 + 0.1e0 - w) / 30e0) as bigint), gw))) as px, y0, y1, t, gh from u, g"""
CELLS = """select gid, code, px, unnest(range(greatest(cast(floor((t - y1 - 0.1e0) / 30e0) as bigint), 0),
 least(cast(ceil((t - y0 + 0.1e0) / 30e0) as bigint), gh))) as py from sp"""
CODED = (
    "select *, case symbol " + " ".join(f"when '{s}' then {c}" for s, c in SEGMENT_CODES.items()) + " end as code from units"
)


@query(
    "rasterise",
    with_views(
        "units",
        "select px, py, cast(code as double) as v from (select *, row_number() over (partition by px, py order by gid desc) as r from ce) where r = 1",
        g=BURN_GRID,
        u=CODED,
        sp=SPAN,
        ce=CELLS,
    ),
)
def _rasterise(spark, d):
    units = expand_box(view(spark, d, "units"), SLIVER_TOLERANCE)
    units = units.withColumn("code", encode_class("symbol", SEGMENT_CODES))
    return R.rasterise(units, R.Grid.of(S.grid_of(units, 30.0)), "code")


SYMBOLS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
BURN_FROM = "select *, case symbol " + " ".join(f"when '{x}' then {i + 1}" for i, x in enumerate(SYMBOLS)) + " end as layer from units"
BURN_CELLS = """select layer, px, py from l join r on l.x0 < (px + 1) * 5 and l.x1 > px * 5
 and l.y0 < $E - py * 5 and l.y1 > $E - (py + 1) * 5"""


def _burn_sql(value: str) -> str:
    return with_views(
        "raster units",
        f"""select r.band, r.px, r.py, cast({value} as double) as v from raster r left join (
 select px, py, max(layer) as layer from ce group by px, py) c on c.px = r.px and c.py = r.py""",
        r="select distinct px, py from raster",
        l=BURN_FROM,
        ce=BURN_CELLS,
    )


def _burn(spark, d, binary: bool) -> DataFrame:
    units = view(spark, d, "units")
    layers = [units.where(F.col("symbol") == s) for s in SYMBOLS]
    out, _ = R.burn_layers(layers, [s.lower() for s in SYMBOLS], raster(spark, d), grid(spark, d), binary)
    return out.select("band", "px", "py", "v")


@query("burn_layers", _burn_sql("coalesce(layer, 0)"))
def _burn_numbers(spark, d):
    return _burn(spark, d, False)


@query("burn_layers_binary", _burn_sql("case when layer is null then 0 else 1 end"))
def _burn_binary(spark, d):
    return _burn(spark, d, True)


# --- mosaic and clip -------------------------------------------------------------

# every band is a tile, each shifted 100 pixels east and 40 south of the one before
SHIFT = {"A": 0, "N": 1, "R": 2}


def tile_meta(spark, d) -> DataFrame:
    n = raster_side(spark, d)
    return local_table(
        spark,
        [(b, 500.0 * i, n * 5.0 - 200.0 * i, 5.0, n, n, i) for b, i in SHIFT.items()],
        "image string, left double, top double, res double, width int, height int, tile_order int",
    )


MOSAIC = """select px, py, v from (select px + 100 * o as px, py + 40 * o as py, v,
 row_number() over (partition by px + 100 * o, py + 40 * o order by o) as r from t) where r = 1"""
TILES = "select *, case band when 'A' then 0 when 'N' then 1 else 2 end as o from raster"


@query("mosaic", with_views("raster", MOSAIC, t=TILES))
def _mosaic(spark, d):
    out, _ = R.mosaic(raster(spark, d).withColumnRenamed("band", "image"), tile_meta(spark, d))
    return out


@query(
    "clip_raster",
    with_views(
        "raster aoi",
        """select band, px - cast(floor(w / 5) as bigint) as px, py - cast(floor(($E - n) / 5) as bigint) as py, v
 from raster, ex where exists (select 1 from b where (px + 0.5) * 5 >= x0 and (px + 0.5) * 5 <= x1
  and $E - (py + 0.5) * 5 >= y0 and $E - (py + 0.5) * 5 <= y1)""",
        b="select x0 / 50 + grp as x0, y0 / 50 + 101 as y0, x1 / 50 + grp - 30 as x1, y1 / 50 + 101 as y1 from aoi",
        ex="select min(x0) as w, max(y1) as n from b",
    ),
)
def _clip(spark, d):
    out, _ = R.clip_raster(raster(spark, d), grid(spark, d), clip_areas(spark, d), 100.0)
    return out


def clip_areas(spark, d) -> DataFrame:
    """All areas within the raster, with gaps between them."""
    return view(spark, d, "aoi").selectExpr(
        "x0 / 50 + grp as x0", "y0 / 50 + 101 as y0", "x1 / 50 + grp - 30 as x1", "y1 / 50 + 101 as y1"
    )


# --- neighbourhoods ---------------------------------------------------------------


@query(
    "focal_mean",
    with_views(
        "raster",
        """select band, px, py, round(avg(n.v), 6) as v from raster a join n using (band, px, py) group by band, px, py""",
        o="select dx - 1 as dx, dy - 1 as dy from range(3) x(dx), range(3) y(dy)",
        n="select band, px + dx as px, py + dy as py, v from raster, o",
    ),
)
def _focal_mean(spark, d):
    return rounded(N.focal(raster(spark, d), 3, "mean"), 6, "v")


@query(
    "focal_max_large",
    with_views(
        "raster",
        """select band, px, py, max(n.v) as v from raster a join n using (band, px, py) group by band, px, py""",
        o="select dx - 3 as dx, dy - 3 as dy from range(7) x(dx), range(7) y(dy)",
        n="select band, px + dx as px, py + dy as py, v from raster, o",
    ),
)
def _focal_max(spark, d):
    return N.focal(raster(spark, d), 7, "max", block=64)


@query(
    "focal_user_function",
    with_views(
        "chips",
        """select a.image, a.px, a.py, round(sqrt(max((a.v - b.v) * (a.v - b.v))), 6) as v from chips a join o on true
 join chips b on b.image = a.image and b.px = a.px + dx and b.py = a.py + dy group by a.image, a.px, a.py""",
        o="select dx - 1 as dx, dy - 1 as dy from range(3) x(dx), range(3) y(dy)",
    ),
)
def _focal_user(spark, d):
    def largest_step(w):
        import numpy as np

        return np.nanmax(np.abs(w - w[:, w.shape[1] // 2 :][:, :1]), axis=1)

    chips = view(spark, d, "chips").drop("label")
    return rounded(N.focal(chips, 3, largest_step, ["image"]), 6, "v")


@query(
    "elevation_percentile",
    with_views(
        "chips",
        """select a.image, a.px, a.py, case when count(*) = 9 then round((sum(case when b.v < a.v then 1 else 0 end)
  + (sum(case when b.v = a.v then 1 else 0 end) - 1) / 2) / 8 * 100, 6) end as v from chips a join o on true
 join chips b on b.image = a.image and b.px = a.px + dx and b.py = a.py + dy group by a.image, a.px, a.py""",
        o="select dx - 1 as dx, dy - 1 as dy from range(3) x(dx), range(3) y(dy)",
    ),
)
def _ep(spark, d):
    chips = view(spark, d, "chips").drop("label")
    return rounded(N.elevation_percentile(chips, 3, ["image"]), 6, "v")


SIGMA = 1.0
WEIGHTS = {o: exp(-0.5 * (o / SIGMA) ** 2) for o in range(-4, 5)}
WEIGHT_SQL = "select * from (values " + ", ".join(f"({o}, {w!r}::double)" for o, w in WEIGHTS.items()) + ") t(o, w)"


@query(
    "gaussian",
    with_views(
        "raster",
        """select y.band, y.px, y.py, round(sum(num * w) / sum(den * w), 6) as v from (
  select r.band, r.px, r.py, case when r.py + o < 0 then -1 - r.py - o when r.py + o >= $N then 2 * $N - 1 - r.py - o
   else r.py + o end as sy, w from raster r, wt) y
 join rows x on x.band = y.band and x.px = y.px and x.py = y.sy group by y.band, y.px, y.py""",
        wt=WEIGHT_SQL,
        rows="""select band, px, py, sum(v * w) as num, sum(w) as den from (
  select r.band, r.py, r.v, w, c.px from raster r, wt, (select distinct px from raster) c
  where (case when c.px + o < 0 then -1 - c.px - o when c.px + o >= $N then 2 * $N - 1 - c.px - o else c.px + o end) = r.px)
 group by band, px, py""",
    ),
)
def _gaussian(spark, d):
    return rounded(N.gaussian(raster(spark, d), grid(spark, d), SIGMA), 6, "v")


CUBIC = """case when abs(d) <= 1 then (1.5 * abs(d) - 2.5) * d * d + 1
 when abs(d) < 2 then -0.5 * (((abs(d) - 5) * abs(d) + 8) * abs(d) - 4) else 0 end"""


@query(
    "resample_cubic",
    with_views(
        "raster",
        """select band, ox as px, oy as py, round(sum(wx * wy * v) / sum(wx * wy), 6) as v from (
  select r.band, a.o as ox, b.o as oy, a.w as wx, b.w as wy, r.v, a.near as nx, b.near as ny, r.px, r.py
  from raster r join ax a on a.j = r.px join ax b on b.j = r.py)
 group by band, ox, oy having max(case when px = nx and py = ny then 1 else 0 end) = 1""",
        ax=f"""select o, j, near, {CUBIC} as w from (select o, j, (j + 0.5e0 - (o + 0.5e0) * 1.6e0) / 1.6e0 as d,
 cast(floor((o + 0.5e0) * 1.6e0) as int) as near from (select unnest(range($N * 5 // 8)) as o) x, (select unnest(range($N)) as j) y) where abs(d) < 2""",
    ),
)
def _resample(spark, d):
    out, _ = N.resample(raster(spark, d), grid(spark, d), 8.0, "cubic", block=64)
    return rounded(out, 6, "v")


@query(
    "align",
    with_views(
        "raster",
        """select band, ox as px, oy as py, round(sum(wx * wy * v) / sum(wx * wy), 6) as v from (
  select r.band, a.o as ox, b.o as oy, a.w as wx, b.w as wy, r.v, a.near as nx, b.near as ny, r.px, r.py
  from raster r join ax a on a.j = r.px join ay b on b.j = r.py)
 group by band, ox, oy having max(case when px = nx and py = ny then 1 else 0 end) = 1 and sum(wx * wy) > 0""",
        ax="""select o, j, near, 1 - abs(d) as w from (select o, j, j + 0.5e0 - (20.4e0 + (o + 0.5e0) * 0.6e0) as d,
 cast(floor(20.4e0 + (o + 0.5e0) * 0.6e0) as int) as near from (select unnest(range($N + 44)) as o) x, (select unnest(range($N)) as j) y) where abs(d) < 1""",
        ay="""select o, j, near, 1 - abs(d) as w from (select o, j, j + 0.5e0 - (-8e0 + (o + 0.5e0) * 0.6e0) as d,
 cast(floor(-8e0 + (o + 0.5e0) * 0.6e0) as int) as near from (select unnest(range($N - 56)) as o) x, (select unnest(range($N)) as j) y) where abs(d) < 1""",
    ),
)
def _align(spark, d):
    g = grid(spark, d)
    ref = R.Grid(102.0, g.top + 40.0, 3.0, g.width + 44, g.height - 56)
    return rounded(N.align(raster(spark, d), grid(spark, d), ref, block=64), 6, "v")


# --- patches of pixels --------------------------------------------------------------

# the patch layout shrunk to 64 pixels of 5 units, so that several patches meet the raster
SMALL = "select patch_id, x0 / 4 as x0, y0 / 4 as y0, x1 / 4 as x1, y1 / 4 as y1 from patches"
INSIDE = "x >= x0 and x < x1 and y > y0 and y <= y1"
CENTRES = "select band, px, py, v, (px + 0.5) * 5 as x, $E - (py + 0.5) * 5 as y from raster"


def small_patches(spark, d) -> DataFrame:
    return view(spark, d, "patches").select(
        "patch_id", *[(F.col(c) / 4).alias(c) for c in ("x0", "y0", "x1", "y1")]
    )


def _image_pixels(spark, d) -> DataFrame:
    return raster(spark, d).withColumn("image", F.col("band"))


PLACE = """cast(px - greatest(cast(floor(x0 / 5) as bigint), 0) as bigint) as col,
 cast(py - greatest(cast(floor(($E - y1) / 5) as bigint), 0) as bigint) as row"""


@query(
    "extract_patches",
    with_views(
        "raster patches",
        f"select patch_id, band, {PLACE}, v from c join p on {INSIDE}",
        p=SMALL,
        c=CENTRES,
    ),
)
def _extract(spark, d):
    out = P.extract_patches(_image_pixels(spark, d), band_meta(spark, d), small_patches(spark, d), 160.0)
    return out.select("patch_id", "band", "col", "row", "v")


# shifted by 2 units, so that pixels are cut by the patch border
@query(
    "extract_patches_filled",
    with_views(
        "raster patches",
        f"""select patch_id, band, {PLACE}, case when v is not null and (px + 0.5) * 5 >= x0 and (px + 0.5) * 5 < x1
  and $E - (py + 0.5) * 5 > y0 and $E - (py + 0.5) * 5 <= y1 then v else -999999e0 end as v
 from grid left join raster using (band, px, py)""",
        p="select patch_id, x0 + 3 as x0, y0 + 1 as y0, x1 + 3 as x1, y1 + 1 as y1 from (" + SMALL + ")",
        cols="""select *, unnest(range(greatest(cast(floor(x0 / 5) as bigint), 0),
 least(cast(ceil(x1 / 5) as bigint), $N))) as px from p, (select distinct band from raster)""",
        grid="""select *, unnest(range(greatest(cast(floor(($E - y1) / 5) as bigint), 0),
 least(cast(ceil(($E - y0) / 5) as bigint), $N))) as py from cols""",
    ),
)
def _filled(spark, d):
    moved = small_patches(spark, d).withColumns(
        {"x0": F.col("x0") + 3, "y0": F.col("y0") + 1, "x1": F.col("x1") + 3, "y1": F.col("y1") + 1}
    )
    out = P.extract_patches(_image_pixels(spark, d), band_meta(spark, d), moved, 160.0, fill=PATCH_FILL)
    return out.select("patch_id", "band", "col", "row", "v")


CLASS_NAMES = list(SEGMENT_CODES)
RASTER_SQL = f"""select px, py, code as v from (select *, row_number() over (partition by px, py order by gid desc) as r
 from ce) where r = 1"""
AREA_SQL = "select patch_id, " + ", ".join(
    f"sum(case when v = {c} then 1 else 0 end) / count(*) as \"{n}\"" for n, c in SEGMENT_CODES.items()
) + f""" from (select patch_id, v from g cross join rs join patches on w + (px + 0.5) * 30 >= x0 and w + (px + 0.5) * 30 < x1
 and t - (py + 0.5) * 30 > y0 and t - (py + 0.5) * 30 <= y1) group by patch_id"""


def class_patches(spark, d) -> DataFrame:
    """Pixels of the burned unit classes in every patch."""
    units = expand_box(view(spark, d, "units"), SLIVER_TOLERANCE)
    units = units.withColumn("code", encode_class("symbol", SEGMENT_CODES))
    grid = R.Grid.of(S.grid_of(units, 30.0))
    pixels = R.rasterise(units, grid, "code").withColumns({"image": F.lit("geology"), "band": F.lit(1)})
    meta = local_table(
        spark,
        [("geology", grid.left, grid.top, grid.res, grid.res, grid.width, grid.height)],
        "image string, left double, top double, res_x double, res_y double, width int, height int",
    )
    return P.extract_patches(pixels, meta, view(spark, d, "patches"), 1280.0)


AREA_PARTS = dict(g=BURN_GRID, u=CODED, sp=SPAN, ce=CELLS, rs=RASTER_SQL, ar=AREA_SQL)


@query(
    "patch_areas",
    with_views(
        "units patches",
        "select patch_id, " + ", ".join(f'round("{n}", 6) as "{n}"' for n in CLASS_NAMES) + " from ar",
        **AREA_PARTS,
    ),
)
def _areas(spark, d):
    return rounded(P.patch_areas(class_patches(spark, d), SEGMENT_CODES), 6, *CLASS_NAMES)


@query(
    "patch_labels",
    with_views(
        "units patches",
        "select patch_id, " + ", ".join(f'case when "{n}" > 0 then 1 else 0 end as "{n}"' for n in CLASS_NAMES) + " from ar",
        **AREA_PARTS,
    ),
)
def _labels(spark, d):
    return P.patch_labels(P.patch_areas(class_patches(spark, d), SEGMENT_CODES))


# --- samples ---------------------------------------------------------------------------


def _digit(i: int) -> str:
    return f"(cast('0x' || substr(md5(concat('5:', cast(image as varchar))), {i}, 1) as int))"


TURNED = f"""select image, v, case t when 0 then x when 1 then y when 2 then 7 - x else 7 - y end as px,
 case t when 0 then y when 1 then 7 - x when 2 then 7 - y else x end as py from (
 select image, v, case when {_digit(1)} >= 8 then 7 - px else px end as x,
  case when {_digit(2)} >= 8 then 7 - py else py end as y, {_digit(3)} % 4 as t from chips)"""


@query("augment", with_views("chips", TURNED))
def _augment(spark, d):
    chips = view(spark, d, "chips").drop("label")
    return D.augment(chips, 5, 8, sample="image")


STACK = """select image, list(line order by py) as plane from (
 select image, py, list(v order by px) as line from {0} group by image, py) group by image"""


def _chip_channels(spark, d) -> DataFrame:
    """Two channels per chip: the value and its double."""
    chips = view(spark, d, "chips").select(F.col("image").alias("patch_id"), "px", "py", "v")
    return chips.withColumn("image", F.lit("one")).unionByName(
        chips.withColumns({"image": F.lit("two"), "v": F.col("v") * 2})
    )


MODALITIES = {"pair": ["two", "one"], "single": ["one"]}
TEXT = """string_agg(cast(cast(round(x * 1000000) as bigint) as varchar), ',' order by c, py, px)"""


def _flat_text(channels: str = "channels"):
    """Array values as one text, millionths, for comparison with SQL."""
    flat = F.flatten(F.flatten(channels))
    return F.array_join(F.transform(flat, lambda x: F.round(x * 1000000).cast("long").cast("string")), ",")


SINGLE = "select image, px, py, 0 as c, v as x from chips"
PAIR = "select image, px, py, 0 as c, v * 2 as x from chips union all select image, px, py, 1, v from chips"


@query(
    "stack_channels",
    with_views(
        "chips",
        f"""select image as patch_id, 'single' as modality, {TEXT} as vals from ({SINGLE}) group by image
 union all select image, 'pair', {TEXT} from ({PAIR}) group by image""",
    ),
)
def _stack(spark, d):
    out = D.stack_channels(_chip_channels(spark, d), MODALITIES)
    return out.select("patch_id", "modality", _flat_text().alias("vals"))


@query(
    "modality_report",
    with_views(
        "chips",
        """select 'single' as modality, 1 as c, 8 as h, 8 as w, count(distinct image) as chips, min(v) as min, max(v) as max from chips
 union all select 'pair', 2, 8, 8, count(distinct image), least(min(v), min(v * 2)), greatest(max(v), max(v * 2)) from chips""",
    ),
)
def _modalities(spark, d):
    return D.modality_report(D.stack_channels(_chip_channels(spark, d), MODALITIES))


PAIR_STATS = "select round(avg(v), 6) as m, round(stddev_pop(v), 6) as s, round(avg(v * 2), 6) as m2, round(stddev_pop(v * 2), 6) as s2 from chips"


def _vals(turned: str, by: str) -> str:
    """Normalised, stacked values of both modalities of turned chips as text, thousandths."""
    one, two = "(v - m) / s", "(v * 2 - m2) / s2"
    text = "string_agg(cast(cast(round(x * 1000) as bigint) as varchar), ',' order by c, py, px)"
    return f"""select {by}, 'single' as modality, {text} as vals from (select {by}, 0 as c, py, px, {one} as x from {turned}, st) group by {by}
 union all select {by}, 'pair', {text} from (select {by}, 0 as c, py, px, {two} as x from {turned}, st
  union all select {by}, 1, py, px, {one} from {turned}, st) group by {by}"""


@query(
    "assemble",
    with_views(
        "chips",
        f"""select image as patch_id, modality, label, vals from ({_vals('turned', 'image')})
 join (select vec_id, label from embeddings) e on e.vec_id = image""",
        turned=TURNED,
        st=PAIR_STATS,
    ),
)
def _assemble(spark, d):
    out = _samples(spark, d, _chip_channels(spark, d).select("patch_id").distinct())
    return out.select("patch_id", "modality", "label", "vals")


def _samples(spark, d, ids: DataFrame) -> DataFrame:
    pixels = _chip_channels(spark, d)
    stats = rounded(R.channel_stats(pixels, ["image"]), 6, "mean", "std")
    labels = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("patch_id"), "label")
    out = D.assemble(ids, pixels, MODALITIES, stats, labels, augment_seed=5)
    flat = F.flatten(F.flatten("channels"))
    text = F.array_join(F.transform(flat, lambda x: F.round(x * 1000).cast("long").cast("string")), ",")
    return out.withColumn("vals", text)


DRAWN = """select cast(image as varchar) as sample, image from (select distinct image from chips)
 union all select concat(cast(h.image as varchar), ':rare:', cast(j as varchar)), h.image from (
  select unnest(range(1, (select count(*) from embeddings) - (select count(*) from h) + 1)) as j) d
 join h on h.rn = cast('0x' || substr(md5(concat('111:rare:', cast(j as varchar))), 1, 12) as bigint) % (select count(*) from h) + 1"""


@query(
    "oversample_assemble",
    with_views(
        "chips",
        f"select sample, modality, vals from ({_vals('turned', 'sample')})",
        h="""select vec_id as image, row_number() over (order by md5(concat('111:', cast(vec_id as varchar))), vec_id) as rn
 from embeddings where label = 1""",
        drawn=DRAWN,
        all_chips="select sample, px, py, v from drawn join chips using (image)",
        turned=TURNED.replace("from chips", "from all_chips").replace("image", "sample"),
        st=PAIR_STATS,
    ),
)
def _oversample_assemble(spark, d):
    """Chips of a rare label drawn until there are as many as chips at all; every copy is turned its own way."""
    labels = spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").alias("patch_id"), (F.col("label") == 1).cast("int").alias("rare"), F.lit(1).alias("all")
    )
    ids = D.oversample(labels.select("patch_id"), labels, ["rare"], "all")
    return _samples(spark, d, ids).select("sample", "modality", "vals")


# --- outlines, several projections and resolutions ------------------------------------

HALF_RING = [("x0", "y0"), ("x1", "y0"), ("x0", "y1"), ("x0", "y0")]


def lower_halves(boxes: DataFrame) -> DataFrame:
    """Every box's lower left half as an outline."""
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in HALF_RING])
    return boxes.withColumn("geom", F.array(F.array(ring)))


@query(
    "rasterise_polygon",
    with_views(
        "units",
        """select px, py, cast(code as double) as v from (select *, row_number() over (partition by px, py order by gid desc) as r from (
 select ce.* from ce join u on u.gid = ce.gid, g where (greatest(w + ce.px * 30, u.x0 - 0.1) - (u.x0 - 0.1)) / (u.x1 - u.x0 + 0.2)
  + (greatest(t - (ce.py + 1) * 30, u.y0 - 0.1) - (u.y0 - 0.1)) / (u.y1 - u.y0 + 0.2) < 1)) where r = 1""",
        g=BURN_GRID,
        u=f"select * exclude (x1), x1 - 37.3 as x1 from ({CODED})",
        sp=SPAN,
        ce=CELLS,
    ),
)
def _rasterise_polygon(spark, d):
    # unequal sides, so that no slanted side runs through a corner of cells
    units = expand_box(view(spark, d, "units").withColumn("x1", F.col("x1") - 37.3), SLIVER_TOLERANCE)
    units = lower_halves(units)
    units = units.withColumn("code", encode_class("symbol", SEGMENT_CODES))
    return R.rasterise(units, R.Grid.of(S.grid_of(expand_box(view(spark, d, "units"), SLIVER_TOLERANCE), 30.0)), "code", geometry=True)


@query(
    "clip_raster_polygon",
    with_views(
        "raster aoi",
        """select band, px - cast(floor(w / 5) as bigint) as px, py - cast(floor(($E - n) / 5) as bigint) as py, v
 from raster, ex where exists (select 1 from b where (px + 0.5) * 5 >= x0 and $E - (py + 0.5) * 5 >= y0
  and ((px + 0.5) * 5 - x0) / (x1 - x0) + ($E - (py + 0.5) * 5 - y0) / (y1 - y0) < 1)""",
        b="select x0 / 50 + grp as x0, y0 / 50 + 101 as y0, x1 / 50 + grp - 30 as x1, y1 / 50 + 101 as y1 from aoi",
        ex="select min(x0) as w, max(y1) as n from b",
    ),
)
def _clip_raster_polygon(spark, d):
    out, _ = R.clip_raster(raster(spark, d), grid(spark, d), lower_halves(clip_areas(spark, d)), 100.0, geometry=True)
    return out


@query(
    "mosaic_resampled",
    with_views(
        "raster",
        """select a.o as px, b.o as py, round(sum(a.w * b.w * m.v) / sum(a.w * b.w), 6) as v
 from m join ax a on a.j = m.px join ax b on b.j = m.py
 group by a.o, b.o having max(case when m.px = a.near and m.py = b.near then 1 else 0 end) = 1""",
        t="select band, px, py, v * 2 as v, case band when 'A' then 0 when 'N' then 1 else 2 end as o from raster",
        m=MOSAIC,
        ax="""select o, j, o * 2 + 1 as near, 1 - abs(d) as w from (select o, j, (j + 0.5e0 - (o + 0.5e0) * 2) / 2 as d
 from (select unnest(range(($N + 200) // 2)) as o) x, (select unnest(range($N + 200)) as j) y) where abs(d) < 1""",
    ),
)
def _mosaic_resampled(spark, d):
    tiles = raster(spark, d).withColumnRenamed("band", "image")
    both = tiles.withColumn("band", F.lit(1)).unionByName(tiles.withColumns({"band": F.lit(2), "v": F.col("v") * 2}))
    out, _ = R.mosaic(both, tile_meta(spark, d), band=2, res=10.0)
    return rounded(out, 6, "v")


@query(
    "align_crs",
    with_views(
        "raster",
        """select band, a.o as px, b.o as py, round(sum(a.w * b.w * r.v) / sum(a.w * b.w), 6) as v
 from raster r join ax a on a.j = r.px join ay b on b.j = r.py
 group by band, a.o, b.o having max(case when r.px = a.near and r.py = b.near then 1 else 0 end) = 1 and sum(a.w * b.w) > 1e-9""",
        cx="select o, radians(0.001e0 + (o + 0.5e0) * 0.00004e0) * 6378137e0 / 5 as c from (select unnest(range($N - 56)) as o) x",
        cy="select o, ($E - ln(tan(pi() / 4 + radians($N * 0.00004e0 - (o + 0.5e0) * 0.00004e0) / 2)) * 6378137e0) / 5 as c from (select unnest(range($N - 106)) as o) x",
        ax="select o, j, cast(floor(c) as bigint) as near, 1 - abs(j + 0.5e0 - c) as w from cx, (select unnest(range($N)) as j) y where abs(j + 0.5e0 - c) < 1",
        ay="select o, j, cast(floor(c) as bigint) as near, 1 - abs(j + 0.5e0 - c) as w from cy, (select unnest(range($N)) as j) y where abs(j + 0.5e0 - c) < 1",
    ),
)
def _align_crs(spark, d):
    g = grid(spark, d)
    degrees = R.Grid(0.001, g.width * 0.00004, 0.00004, g.width - 56, g.height - 106)
    out = N.align(raster(spark, d), g, degrees, src_crs="EPSG:3857", dst_crs="EPSG:4326")
    return rounded(out, 6, "v")


@query(
    "focal_mean_nan",
    with_views(
        "raster",
        """select band, px, py, round(avg(n.v), 6) as v from k a join n using (band, px, py) group by band, px, py""",
        k="select * from raster where v > 10",
        o="select dx - 2 as dx, dy - 2 as dy from range(5) x(dx), range(5) y(dy)",
        n="select band, px + dx as px, py + dy as py, v from k, o",
    ),
)
def _focal_nan(spark, d):
    holed = raster(spark, d).withColumn("v", F.when(F.col("v") > 10, F.col("v")).otherwise(F.lit(float("nan"))))
    return rounded(N.focal(holed, 5, "mean"), 6, "v")
