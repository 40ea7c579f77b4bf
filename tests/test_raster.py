import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.functions import geometry as G, polygons
from patchloom.operators import dataset as D, focal as N, patches as P, raster as R
from patchloom.plans import load
from plain_polygons import line_spans, strip_spans

rng = np.random.default_rng(7)


def pixels(spark, a, **keys):
    """Long pixels of an array; NaN cells are left out."""
    rows = [(*keys.values(), int(x), int(y), float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1]) if not np.isnan(a[y, x])]
    names = ", ".join(f"{k} string" for k in keys)
    return spark.createDataFrame(rows, f"{names}, px int, py int, v double" if names else "px int, py int, v double")


def dense(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r["v"] is not None:
            out[r["py"], r["px"]] = r["v"]
    return out


IMAGE = rng.integers(0, 20, (23, 31)).astype(float)
HOLED = IMAGE.copy()
HOLED[5:8, 10:14] = np.nan


def brute_windows(a, size, fn):
    r = size // 2
    padded = np.pad(a, r, constant_values=np.nan)
    out = np.full(a.shape, np.nan)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            if not np.isnan(a[y, x]):
                out[y, x] = fn(padded[y : y + size, x : x + size].ravel())
    return out


@pytest.mark.parametrize("size", [3, 5, 7])
@pytest.mark.parametrize("name", ["mean", "sum", "min", "max", "count"])
def test_focal_reducers(spark, size, name):
    fns = {"mean": np.nanmean, "sum": np.nansum, "min": np.nanmin, "max": np.nanmax, "count": lambda w: (~np.isnan(w)).sum()}
    got = N.focal(pixels(spark, HOLED, band="b"), size, name, block=8)
    np.testing.assert_allclose(dense(got, IMAGE.shape), brute_windows(HOLED, size, fns[name]))


def test_focal_user_function_and_block_independence(spark):
    def spread(w):
        return np.nanmax(w, axis=1) - np.nanmin(w, axis=1)

    p = pixels(spark, HOLED, band="b")
    want = brute_windows(HOLED, 5, lambda w: np.nanmax(w) - np.nanmin(w))
    for block in (4, 16, 256):
        np.testing.assert_allclose(dense(N.focal(p, 5, spread, block=block), IMAGE.shape), want)
    with pytest.raises(ValueError):
        N.focal(p, 4, spread)


def test_elevation_percentile(spark):
    def percentile(w):
        if np.isnan(w).any():
            return np.nan
        c = w[len(w) // 2]
        rank = (w < c).sum() + ((w == c).sum() + 1) / 2
        return (rank - 1) / (len(w) - 1) * 100

    for size in (3, 7):
        got = dense(N.elevation_percentile(pixels(spark, HOLED, band="b"), size, block=8), IMAGE.shape)
        np.testing.assert_allclose(got, brute_windows(HOLED, size, percentile))


def reflect(i, n):
    while i < 0 or i >= n:
        i = -1 - i if i < 0 else 2 * n - 1 - i
    return i


def brute_gaussian(a, sigma):
    w = N.gaussian_weights(sigma)
    r = len(w) // 2
    out = np.full(a.shape, np.nan)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            if np.isnan(a[y, x]):
                continue
            num = den = 0.0
            for i in range(-r, r + 1):
                for j in range(-r, r + 1):
                    v = a[reflect(y + i, a.shape[0]), reflect(x + j, a.shape[1])]
                    if not np.isnan(v):
                        num += w[i + r] * w[j + r] * v
                        den += w[i + r] * w[j + r]
            out[y, x] = num / den
    return out


@pytest.mark.parametrize("sigma,a", [(1.0, HOLED), (0.7, IMAGE), (3.0, IMAGE[:5, :6])])
def test_gaussian(spark, sigma, a):
    grid = R.Grid(0, 0, 1, a.shape[1], a.shape[0])
    got = N.gaussian(pixels(spark, a, band="b"), grid, sigma, block=8)
    np.testing.assert_allclose(dense(got, a.shape), brute_gaussian(a, sigma))


def test_gaussian_keeps_a_constant(spark):
    a = np.full((9, 9), 4.0)
    got = N.gaussian(pixels(spark, a, band="b"), R.Grid(0, 0, 1, 9, 9), 2.0, block=4)
    np.testing.assert_allclose(dense(got, a.shape), a)


def brute_warp(a, src, dst, kernel, support):
    out = np.full((dst.height, dst.width), np.nan)
    ratio = dst.res / src.res
    scale = max(1, ratio)
    for y in range(dst.height):
        for x in range(dst.width):
            cx = (dst.left + (x + 0.5) * dst.res - src.left) / src.res
            cy = (src.top - (dst.top - (y + 0.5) * dst.res)) / src.res
            nx, ny = int(np.floor(cx)), int(np.floor(cy))
            if not (0 <= nx < a.shape[1] and 0 <= ny < a.shape[0]) or np.isnan(a[ny, nx]):
                continue
            wx = kernel((np.arange(a.shape[1]) + 0.5 - cx) / scale)
            wy = kernel((np.arange(a.shape[0]) + 0.5 - cy) / scale)
            w = np.outer(wy, wx) * ~np.isnan(a)
            out[y, x] = (w * np.nan_to_num(a)).sum() / w.sum()
    return out


@pytest.mark.parametrize("method", ["bilinear", "cubic"])
@pytest.mark.parametrize("res", [2.0, 5.0, 13.0])
def test_resample(spark, method, res):
    src = R.Grid(100.0, 300.0, 5.0, 31, 23)
    got, dst = N.resample(pixels(spark, HOLED, band="b"), src, res, method, block=8)
    assert (dst.width, dst.height) == (int(np.ceil(155 / res)), int(np.ceil(115 / res)))
    want = brute_warp(HOLED, src, dst, *N.KERNELS[method])
    np.testing.assert_allclose(dense(got, want.shape), want, atol=1e-9)


def test_align_shifted_and_projected(spark):
    src, ref = R.Grid(0.0, 115.0, 5.0, 31, 23), R.Grid(-7.0, 121.0, 3.0, 70, 50)
    got = N.align(pixels(spark, HOLED, band="b"), src, ref, block=16)
    want = brute_warp(HOLED, src, ref, *N.KERNELS["bilinear"])
    np.testing.assert_allclose(dense(got, want.shape), want, atol=1e-9)
    # near the equator the projection is a plain scaling
    degree = 111319.49079327358
    ll = R.Grid(0.0, 0.023, 0.001, 31, 23)
    ref = R.Grid(0.0, 0.023 * degree, 0.0017 * degree, 18, 13)
    got = N.align(pixels(spark, IMAGE, band="b"), ll, ref, block=8, src_crs="EPSG:4326", dst_crs="EPSG:3857")
    scaled = R.Grid(0.0, 0.023, 0.0017, 18, 13)
    want = brute_warp(IMAGE, ll, scaled, *N.KERNELS["bilinear"])
    np.testing.assert_allclose(dense(got, want.shape), want, atol=1e-3)


def test_rasterise_boxes_equals_polygons(spark):
    rows = [(1, 1, 0.2, 0.2, 3.1, 2.5), (2, 2, 2.5, 1.5, 6.0, 4.0), (3, None, 5.5, 3.5, 7.9, 7.9)]
    units = spark.createDataFrame(rows, "gid int, code int, x0 double, y0 double, x1 double, y1 double")
    shaped = units.withColumn("geom", G.box_geom(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    grid = R.Grid(0.0, 8.0, 1.0, 8, 8)
    a = dense(R.rasterise(units, grid, "code"), (8, 8))
    b = dense(R.rasterise(shaped, grid, "code", geometry=True), (8, 8))
    np.testing.assert_array_equal(a, b)
    assert a[7, 0] == 1 and a[6, 2] == 2 and a[5, 2] == 2 and np.isnan(a[0, 7])
    assert np.isnan(a[4, 5])  # the last feature has no code and clears the cell


def test_listed_cells_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_CELLS", 1000)
    rows = [(i, i, 16.0 * (i % 8), 16.0 * (i // 8), 16.0 * (i % 8) + 16, 16.0 * (i // 8) + 16) for i in range(64)]
    units = spark.createDataFrame(rows, "gid int, code int, x0 double, y0 double, x1 double, y1 double")
    shaped = units.withColumn("geom", G.box_geom(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    grid = R.Grid(0.0, 128.0, 1.0, 128, 128)
    assert R.most_cells(units, grid) == 128 * 128 and R.most_cells(units, grid._replace(width=40)) == 128 * 40
    empty = spark.createDataFrame([(None,), ([],), ([[[]]],)], f"geom {G.GEOM_TYPE}")
    assert 128 * 128 <= R.most_cells(shaped.select("geom").unionAll(empty), grid, True) < 2 * 128 * 128
    thin = [[[[0.0, 0.0], [100.0, 100.0], [100.0, 99.5], [0.0, 0.0]]]]
    assert 100 <= R.most_cells(spark.createDataFrame([(thin,)], f"geom {G.GEOM_TYPE}"), grid, True) < 1000
    for geometry in (False, True):
        cells = R.touched_cells(shaped, grid, ["gid"], geometry).withColumn("task", F.spark_partition_id())
        most = cells.select("task", "py", "px").distinct().groupBy("task").count().agg(F.max("count")).first()[0]
        assert most <= 4000
        assert cells.select("py", "px").distinct().count() == 128 * 128


def test_burned_cells_are_not_broadcast(spark, sf):
    plan = load().QUERIES["burn_layers"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_rasterise_slanted_polygon(spark):
    # all cells whose square meets the triangle with positive extent
    tri = [[[[0.0, 0.0], [6.0, 0.0], [0.0, 6.0], [0.0, 0.0]]]]
    df = G.bbox(spark.createDataFrame([(1, 1, tri)], f"gid int, code int, geom {G.GEOM_TYPE}"))
    got = dense(R.rasterise(df, R.Grid(0.0, 8.0, 1.0, 8, 8), "code", geometry=True), (8, 8))
    for y in range(8):
        for x in range(8):
            low_left = x + (8 - y - 1)  # x + y of the cell's lower left corner
            assert (got[y, x] == 1) == (low_left < 6), (x, y)


def test_extract_fill_and_centre_rule(spark):
    a = np.arange(16, dtype=float).reshape(4, 4)
    a[0, 0] = np.nan
    p = pixels(spark, a, image="i", band="b")
    meta = spark.createDataFrame([("i", 0.0, 4.0, 1.0, 1.0, 4, 4)], "image string, left double, top double, res_x double, res_y double, width int, height int")
    patches = spark.createDataFrame([("p", 0.6, 1.0, 2.6, 4.0), ("q", 3.0, 3.0, 6.0, 6.0)], "patch_id string, x0 double, y0 double, x1 double, y1 double")
    inside = P.extract_patches(p, meta, patches, 2.0)
    got = {(r["patch_id"], r["col"], r["row"]): r["v"] for r in inside.collect()}
    assert got == {("p", 1, r): a[r, 1] for r in range(3)} | {("p", 2, r): a[r, 2] for r in range(3)} | {("q", 0, 0): 3.0}
    full = P.extract_patches(p, meta, patches, 2.0, fill=-999999.0)
    got = {(r["patch_id"], r["col"], r["row"]): r["v"] for r in full.collect()}
    assert len(got) == 9 + 1
    assert got[("p", 0, 0)] == got[("p", 0, 1)] == -999999.0 and got[("p", 1, 0)] == 1.0


def test_burn_and_mosaic(spark):
    ref = pixels(spark, np.array([[1.0, 2.0], [3.0, 4.0]])).withColumn("v", F.when(F.col("v") != 4, F.col("v")))
    one = spark.createDataFrame([(0.0, 0.0, 2.0, 1.5)], "x0 double, y0 double, x1 double, y1 double")
    two = spark.createDataFrame([(1.2, 1.2, 1.8, 1.8)], "x0 double, y0 double, x1 double, y1 double")
    out, names = R.burn_layers([one, two], ["one", "two"], ref, R.Grid(0.0, 2.0, 1.0, 2, 2), binary=False)
    assert names == {"background": 0, "one": 1, "two": 2}
    np.testing.assert_array_equal(dense(out, (2, 2)), [[1, 2], [1, np.nan]])
    tiles = pixels(spark, np.full((2, 2), 1.0), image="a").unionByName(pixels(spark, np.full((2, 2), 2.0), image="b"))
    meta = spark.createDataFrame([("a", 0.0, 2.0, 1.0, 2, 2, 1), ("b", 1.0, 2.0, 1.0, 2, 2, 2)], "image string, left double, top double, res double, width int, height int, tile_order int")
    out, grid = R.mosaic(tiles, meta)
    assert (grid.width, grid.height) == (3, 2)
    np.testing.assert_array_equal(dense(out, (2, 3)), [[1, 1, 2], [1, 1, 2]])
    bands = tiles.withColumn("band", F.lit(1)).unionByName(tiles.withColumns({"band": F.lit(2), "v": F.lit(9.0)}))
    out, grid = R.mosaic(bands, meta, band=1, res=0.5)
    assert (grid.res, grid.width, grid.height) == (0.5, 6, 4)
    np.testing.assert_allclose(dense(out, (4, 6)), [[1, 1, 1, 1.25, 1.75, 2]] * 4)


def test_clip_raster_polygon(spark):
    tri = [[[[0.0, 0.0], [4.0, 0.0], [0.0, 4.0], [0.0, 0.0]]]]
    area = G.bbox(spark.createDataFrame([(tri,)], f"geom {G.GEOM_TYPE}"))
    p = pixels(spark, np.ones((6, 6)), band="b")
    out, grid = R.clip_raster(p, R.Grid(0.0, 6.0, 1.0, 6, 6), area, 2.0, geometry=True)
    assert (grid.top, grid.width, grid.height) == (4.0, 4, 4)
    assert out.count() == 6  # centres with x + y < 4


def star(cx, cy, r, n, turn):
    """A concave ring around a hole, with corners off the grid."""
    a = np.linspace(0, 2 * np.pi, 2 * n, endpoint=False) + turn
    far = np.where(np.arange(2 * n) % 2, 0.45, 1.0) * r
    outer = np.column_stack([cx + far * np.cos(a), cy + far * np.sin(a)])
    hole = np.column_stack([cx + 0.3 * r * np.cos(a[::2]), cy + 0.3 * r * np.sin(a[::2])])
    return [[ring.tolist() + [ring[0].tolist()] for ring in (outer, hole)]]


STARS = [star(9.13, 11.27, 8.4, 5, 0.2), star(20.61, 8.9, 7.7, 7, 1.1), star(20.61, 8.9, 7.7, 7, 1.1), star(2.2, 21.4, 6.3, 3, 0.7)]


def test_scan_lines_of_concave_outlines(spark):
    grid = R.Grid(0.5, 24.0, 0.7, 33, 31)  # cuts some of the outlines off
    units = spark.createDataFrame([(i, i + 1, g) for i, g in enumerate(STARS)], f"gid int, code int, geom {G.GEOM_TYPE}")
    out = R.rasterise(G.bbox(units), grid, "code", geometry=True)
    want = np.full((grid.height, grid.width), np.nan)
    inside = np.zeros(want.shape, dtype=bool)
    for code, g in enumerate(STARS, start=1):
        e = polygons.edges(g)
        for y in range(grid.height):
            top = grid.top - y * grid.res
            for lo, hi in strip_spans(g, top - grid.res, top):
                first, end = np.floor((lo - grid.left) / grid.res), np.ceil((hi - grid.left) / grid.res)
                want[y, int(max(first, 0)) : int(max(end, 0))] = code
            x = grid.left + (np.arange(grid.width) + 0.5) * grid.res
            for lo, hi in line_spans(e, top - grid.res / 2):
                inside[y] |= (x >= lo) & (x < hi)
    np.testing.assert_array_equal(dense(out, want.shape), want)

    p = pixels(spark, np.arange(want.size, dtype=float).reshape(want.shape), band="b")
    clipped, cropped = R.clip_raster(p, grid, G.bbox(units), 4.0, geometry=True)
    assert sorted(r["v"] for r in clipped.collect()) == np.flatnonzero(inside).tolist()
    assert (cropped.left, cropped.top) == (grid.left, grid.top)
    for plan in (out, clipped):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text
        assert not [line for line in text.split("\n") if "Exchange" in line and "geom" in line]


def test_scan_lines_share_borders(spark):
    # neighbours with one slanted border: every cell centre has one of them, corners on centres included
    a = [[[[0.0, 0.0], [6.5, 0.0], [2.5, 8.0], [0.0, 8.0], [0.0, 0.0]]]]
    b = [[[[6.5, 0.0], [9.0, 0.0], [9.0, 8.0], [2.5, 8.0], [6.5, 0.0]]]]
    p = pixels(spark, np.arange(72, dtype=float).reshape(8, 9), band="b")
    grid, got = R.Grid(0.0, 8.0, 1.0, 9, 8), []
    for g in (a, b):
        area = G.bbox(spark.createDataFrame([(g,), (g,), (None,), ([],)], f"geom {G.GEOM_TYPE}"))
        kept, cropped = R.clip_raster(p, grid, area, 2.0, geometry=True)
        got += [r["v"] for r in kept.collect()]
    assert sorted(got) == list(range(72))


def test_augment_forms_agree(spark):
    chips = [(f"s{i}", int(x), int(y), float(i * 100 + y * 4 + x)) for i in range(24) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(chips, "sample string, px int, py int, v double")
    moved = D.augment(df, 9, 4).withColumn("image", F.lit("c"))
    a = D.stack_channels(moved, {"m": ["c"]}, ["sample"])
    b = D.augment_stack(D.stack_channels(df.withColumn("image", F.lit("c")), {"m": ["c"]}, ["sample"]), 9)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    d = D.draws(9, "sample")
    kinds = df.select("sample").distinct().select(*[c.alias(n) for n, c in d.items()]).distinct()
    assert kinds.count() > 6


def test_minmax_of_constant_image(spark):
    df = spark.createDataFrame([("a", 0, 0, 3.0), ("a", 1, 0, 3.0), ("b", 0, 0, 1.0), ("b", 1, 0, 2.0)], "image string, px int, py int, v double")
    got = {(r["image"], r["px"]): r["v"] for r in D.minmax_scale(df).collect()}
    assert got == {("a", 0): None, ("a", 1): None, ("b", 0): 0.0, ("b", 1): 1.0}


def test_all_null_image_statistics(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "image string, v double")
    got = {r["image"]: (r["n"], r["mean"], r["std"]) for r in R.channel_stats(df).collect()}
    assert got == {"a": (0, None, None), "b": (1, 2.0, 0.0)}


def test_assemble_oversampled_ids(spark):
    rows = [(p, c, x, y, float(x + y)) for p in ("p", "q") for c in ("one", "two") for x in range(2) for y in range(2)]
    pix = spark.createDataFrame(rows, "patch_id string, image string, px int, py int, v double")
    ids = spark.createDataFrame([("p", "p:0"), ("p", "p:1"), ("q", "q:0")], "patch_id string, sample string")
    stats = spark.createDataFrame([("two", 1.0, 2.0)], "image string, mean double, std double")
    labels = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0])], "patch_id string, labels array<double>")
    out = D.assemble(ids, pix, {"m": ["two", "one"]}, stats, labels, augment_seed=1).collect()
    assert sorted(r["sample"] for r in out) == ["p:0", "p:1", "q:0"]
    for r in out:
        c = np.array(r["channels"])
        assert c.shape == (2, 2, 2) and sorted(c[0].ravel()) == [-0.5, 0, 0, 0.5] and sorted(c[1].ravel()) == [0, 1, 1, 2]
        assert len(r["labels"]) == 2


def test_pixels_meet_patches_the_same_way_without_broadcast(spark, sf, monkeypatch):
    import __spark_entry__ as entry
    from patchloom.operators import spatial

    query = entry.queries()["extract_patches"]
    want = query(spark, sf).collect()
    monkeypatch.setattr(spatial, "BROADCAST_CELLS", 0)
    got = query(spark, sf)
    assert sorted(got.collect()) == sorted(want)
    assert "__salt" in got._jdf.queryExecution().optimizedPlan().toString()
