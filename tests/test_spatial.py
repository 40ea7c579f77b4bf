import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_polygons as Pg
from patchloom.functions import boxes, geometry as G
from patchloom.functions.polygons import clip_to
from patchloom.operators.areas import area_join
from patchloom.operators import dataset as D, patches as P, spatial as S, tables as T

BOX = "id int, x0 double, y0 double, x1 double, y1 double"


def table(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], BOX)


EDGE_CASES = [
    # a, b, intersects, overlaps, within, touches
    ((0, 0, 2, 2), (0, 0, 2, 2), True, False, True, False),
    ((0, 0, 2, 2), (2, 0, 4, 2), True, False, False, True),
    ((0, 0, 2, 2), (2, 2, 4, 4), True, False, False, True),
    ((0, 0, 2, 2), (1, 1, 3, 3), True, True, False, False),
    ((1, 1, 2, 2), (0, 0, 4, 4), True, False, True, False),
    ((0, 0, 2, 2), (0, 0, 4, 4), True, False, True, False),
    ((0, 0, 4, 4), (1, 1, 2, 2), True, False, False, False),
    ((0, 0, 2, 2), (5, 5, 6, 6), False, False, False, False),
    ((0, 0, 4, 2), (1, -1, 2, 3), True, True, False, False),
]


def ring(b):
    x0, y0, x1, y1 = map(float, b)
    return [[[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]]


@pytest.mark.parametrize("case", EDGE_CASES)
def test_predicates_of_boxes_and_polygons(spark, case):
    a, b, *want = case
    names = ["intersects", "overlaps", "within", "touches"]
    df = table(spark, [a]).crossJoin(table(spark, [b]).toDF("j", "bx0", "by0", "bx1", "by1"))
    row = df.select(*[boxes.PREDICATES[n](boxes.box(), boxes.box("b")).alias(n) for n in names]).first()
    assert [row[n] for n in names] == want
    rel = Pg.relation(ring(a), ring(b))
    assert [rel[n] for n in names] == want


def random_boxes(n, seed, side=30):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = rng.randrange(-200, 200), rng.randrange(-200, 200)
        out.append((x, y, x + rng.randrange(1, side), y + rng.randrange(1, side)))
    return out


@pytest.mark.parametrize("predicate", ["intersects", "overlaps", "within", "touches"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_grid_join_equals_theta_join(spark, monkeypatch, predicate, broadcast):
    if not broadcast:
        monkeypatch.setattr(S, "BROADCAST_CELLS", 0)
        monkeypatch.setattr(S, "SPREAD_CELLS", 3)
    left = table(spark, random_boxes(150, 1))
    right = table(spark, random_boxes(150, 2) + random_boxes(150, 1)[:20] + [(-300, -300, 300, 300)])
    other = right.toDF("rid", "bx0", "by0", "bx1", "by1")
    test = boxes.PREDICATES[predicate](boxes.box(), boxes.box("b"))
    want = sorted(map(tuple, left.join(other, test).select("id", "rid").collect()))
    got = S.spatial_join(left, right, predicate, "inner", 25.0)
    assert sorted(map(tuple, got.select("id", "id_right").collect())) == want
    hit = {i for i, _ in want}
    for how, ids in (("left_semi", hit), ("left_anti", set(range(150)) - hit)):
        out = S.spatial_join(left, right, predicate, how, 25.0)
        assert sorted(r["id"] for r in out.collect()) == sorted(ids)
        assert out.columns == left.columns


def test_no_pairwise_plan(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_CELLS", 0)
    left, right = table(spark, random_boxes(50, 1)), table(spark, random_boxes(50, 2))
    for how in ("inner", "left_semi", "left_anti"):
        plan = S.spatial_join(left, right, "intersects", how, 25.0)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_different_crs_raises(spark):
    a = table(spark, [(0, 0, 1, 1)]).withColumn("crs", F.lit("EPSG:1"))
    b = table(spark, [(0, 0, 1, 1)]).withColumn("crs", F.lit("EPSG:2"))
    assert S.spatial_join(a, a, "intersects", cell=1.0).count() == 1
    with pytest.raises(Exception, match="coordinate systems"):
        S.spatial_join(a, b, "intersects", cell=1.0).collect()
    with pytest.raises(ValueError):
        S.spatial_join(a, b.drop("crs"), "intersects", cell=1.0)


def polygons(spark, geoms):
    df = spark.createDataFrame(list(enumerate(geoms)), f"id int, geom {G.GEOM_TYPE}")
    return G.bbox(df)


L_SHAPE = [[[[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [2.0, 2.0], [2.0, 4.0], [0.0, 4.0], [0.0, 0.0]]]]


def test_polygon_join_is_exact(spark):
    # the second box lies in the notch of the L: its box meets, its shape does not
    small = polygons(spark, [ring((0.5, 0.5, 1.5, 1.5)), ring((2.5, 2.5, 3.5, 3.5)), ring((3, 1, 5, 3)), ring((4, 0, 6, 2))])
    area = polygons(spark, [L_SHAPE])
    for predicate, ids in (("within", [0]), ("overlaps", [2]), ("touches", [3]), ("intersects", [0, 2, 3])):
        out = S.spatial_join(small, area, predicate, "left_semi", 2.0, exact_geometry=True)
        assert sorted(r["id"] for r in out.collect()) == ids
    out = S.spatial_join(small, area, "intersects", "left_anti", 2.0, exact_geometry=True)
    assert [r["id"] for r in out.collect()] == [1]


def test_hole_counts_as_outside():
    holed = [[ring((0, 0, 10, 10))[0][0], ring((4, 4, 6, 6))[0][0]]]
    assert not Pg.relation(ring((4.5, 4.5, 5.5, 5.5)), holed)["intersects"]
    assert not Pg.relation(ring((3, 3, 7, 7)), holed)["within"]
    assert Pg.relation(ring((1, 1, 2, 2)), holed)["within"]


def test_clip_boxes_and_convex_polygons(spark):
    area = table(spark, [(0, 0, 10, 10)])
    got = S.clip(table(spark, [(-5, -5, 5, 5), (10, 0, 12, 2), (2, 2, 3, 3)]), area, 5.0)
    assert sorted(tuple(r)[:5] for r in got.collect()) == [(0, 0, 0, 5, 5), (2, 2, 2, 3, 3)]
    triangle = [[[[0.0, 0.0], [8.0, 0.0], [0.0, 8.0], [0.0, 0.0]]]]
    got = S.clip(polygons(spark, [ring((0, 0, 6, 6))]), polygons(spark, [triangle]), 4.0, geometry=True).first()
    e = Pg.edges(got["geom"])
    assert abs((e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]).sum() / 2) == pytest.approx(36 - 4 * 4 / 2)


U_SHAPE = [[[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [7.0, 10.0], [7.0, 3.0], [3.0, 3.0], [3.0, 10.0], [0.0, 10.0], [0.0, 0.0]]]]


def star(rng, cx, cy):
    n = rng.randrange(4, 12)
    angles = [(i + rng.random() * 0.9) * 2 * math.pi / n for i in range(n)]
    radii = [rng.uniform(1, 5) for _ in range(n)]
    points = [[cx + r * math.cos(t), cy + r * math.sin(t)] for t, r in zip(angles, radii)]
    return [[[*points, points[0]]]]


def test_clip_splits_a_concave_feature(spark):
    half_plane = ring((-5, 5, 15, 20))
    for geom, mask in ((U_SHAPE, half_plane), (half_plane, U_SHAPE)):
        got = S.clip(polygons(spark, [geom]), polygons(spark, [mask]), 4.0, geometry=True)
        row = got.select("geom", G.area().alias("area"), *boxes.SIDES).first()
        assert len(row["geom"]) == 2 and row["area"] == 30.0
        assert [row[c] for c in boxes.SIDES] == [0, 5, 10, 10]


def test_clip_of_concave_outlines_covers_what_both_cover():
    rng = random.Random(5)
    for _ in range(60):
        a, b = star(rng, 0, 0), star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3))
        got = clip_to(a, b)
        points = np.array([[rng.uniform(-6, 6), rng.uniform(-6, 6)] for _ in range(300)])
        want = (Pg.locate(points, Pg.edges(a)) == 1) & (Pg.locate(points, Pg.edges(b)) == 1)
        inside = Pg.locate(points, Pg.edges(got)) == 1 if got else np.zeros(300, bool)
        assert (want == inside).all()


def test_boxes_against_outlines(spark):
    rng = random.Random(8)
    holed = [[ring((0, 0, 40, 40))[0][0], ring((10, 10, 20, 20))[0][0]], *ring((50, 50, 60, 60))]
    shapes = [holed, U_SHAPE, L_SHAPE, *[star(rng, rng.uniform(0, 40), rng.uniform(0, 40)) for _ in range(12)]]
    rows = [(rng.randrange(0, 60), rng.randrange(0, 60), rng.choice([1, 3, 9])) for _ in range(300)]
    tiles = table(spark, [(x, y, x + s, y + s) for x, y, s in rows])
    areas = polygons(spark, shapes).withColumnRenamed("id", "aoi")
    for predicate in ("within", "intersects"):
        got = area_join(tiles, areas, predicate, "inner", 7.0, "id")
        want = {
            (i, j)
            for i, (x, y, s) in enumerate(rows)
            for j, shape in enumerate(shapes)
            if Pg.relation(ring((x, y, x + s, y + s)), shape)[predicate]
        }
        assert {(r["id"], r["aoi"]) for r in got.collect()} == want


def test_patches_within_a_triangle(spark):
    area = polygons(spark, [[[[[0.0, 0.0], [100.0, 0.0], [0.0, 100.0], [0.0, 0.0]]]]])
    assert P.make_patches(S.grid_of(area, 1.0), 10, 0.0, area).count() == 45


def test_long_outline_is_not_copied(spark):
    n = 10_000
    points = [[50 + 40 * math.cos(2 * math.pi * i / n), 50 + 40 * math.sin(2 * math.pi * i / n)] for i in range(n)]
    area = polygons(spark, [[[[*points, points[0]]]]])
    tiles = table(spark, [(x, y, x + 5, y + 5) for x in range(0, 100, 5) for y in range(0, 100, 5)])
    joined = area_join(tiles, area, "within", "left_semi", 5.0, "id")
    far = [(x, y) for x in range(0, 100, 5) for y in range(0, 100, 5)
           if max(math.hypot(a - 50, b - 50) for a in (x, x + 5) for b in (y, y + 5)) < 39.99]
    assert joined.count() == len(far)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        assert "Join" not in line or "geom" not in line


def test_reassign_by_longest_border(spark):
    rows = [(0, "x", 0, 0, 2, 2), (1, "a", 2, 0, 3, 2), (2, "b", 0, 2, 1, 3), (3, "c", 9, 9, 10, 10), (4, "x", 20, 20, 21, 21)]
    units = spark.createDataFrame([(g, s, *map(float, b)) for g, s, *b in rows], "gid int, symbol string, x0 double, y0 double, x1 double, y1 double")
    got = {r["gid"]: r["symbol"] for r in S.reassign_symbol(units, ["x"], 2.0).collect()}
    assert got == {0: "a", 1: "a", 2: "b", 3: "c", 4: "x"}
    shaped = units.withColumn("geom", G.box_geom(*[F.col(c) for c in boxes.SIDES]))
    got = {r["gid"]: r["symbol"] for r in S.reassign_symbol(shaped, ["x"], 2.0, geometry=True).collect()}
    assert got == {0: "a", 1: "a", 2: "b", 3: "c", 4: "x"}


def test_crs_round_trip(spark):
    df = polygons(spark, [L_SHAPE]).withColumn("crs", F.lit("EPSG:4326"))
    there = G.to_crs(df, "EPSG:4326", "EPSG:3857")
    assert there.first()["x1"] == pytest.approx(math.radians(4) * 6378137)
    back = G.to_crs(there, "EPSG:3857", "EPSG:4326").first()
    assert back["crs"] == "EPSG:4326"
    assert [back[c] for c in boxes.SIDES] == pytest.approx([0, 0, 4, 4], abs=1e-9)
    with pytest.raises(ValueError):
        G.to_crs(df, "EPSG:4326", "EPSG:27700")


def test_patch_layout(spark):
    grid = spark.createDataFrame([(0.0, 0.0, 50.0, 50.0, 1.0)], "left double, bottom double, right double, top double, res double")
    area = table(spark, [(0, 0, 40, 40)])
    rows = P.make_patches(grid, 20, 0.5, area).orderBy("pid").collect()
    assert len(rows) == 9
    assert rows[0]["patch_id"] == "20_50_1" and (rows[0]["x0"], rows[0]["y0"]) == (0, 0)
    assert (rows[1]["x0"], rows[1]["y0"]) == (0, 10)
    assert (rows[8]["x0"], rows[8]["y0"]) == (20, 20)
    # the percentage is truncated, not rounded
    assert P.make_patches(grid, 20, 0.29, area, "w").first()["patch_id"].startswith("w_20_28_")


def test_split_is_spatially_independent(spark):
    rows = [(i * 10, j * 10, i * 10 + 20, j * 10 + 20) for i in range(20) for j in range(20)]
    patches = table(spark, rows).withColumn("patch_id", F.concat(F.lit("p"), "id"))
    out = D.train_val_test(patches, 20, 10, cell=20.0)
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes["test"] == 20 and sizes["val"] == 10 and 0 < sizes["train"] < 370
    assert out.select("patch_id").distinct().count() == out.count()
    drawn, rest = out.where("split = 'test'"), out.where("split <> 'test'")
    assert S.spatial_join(rest, drawn, "overlaps", "left_semi", 20.0, "patch_id").count() == 0


def test_oversample(spark):
    labels = spark.createDataFrame([(f"p{i}", int(i < 3), int(i < 50)) for i in range(60)], "patch_id string, rare int, common int")
    ids = labels.select("patch_id").where("patch_id <> 'p0'")
    out = D.oversample(ids, labels, ["rare"], "common").cache()
    assert out.count() == 59 + 49 - 2
    extra = out.where("source = 'rare'")
    assert {r["patch_id"] for r in extra.collect()} <= {"p1", "p2"}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, D.oversample(ids, labels, ["rare"], "common").collect()), key=str)
    with pytest.raises(ValueError):
        D.oversample(ids, labels, ["common"], "rare")


def test_tables(spark):
    meta = spark.createDataFrame([("a", 1), ("a", 1), ("t", 1)], "image string, width int")
    with pytest.raises(ValueError, match="more than once"):
        T.check_alignment(meta, "t", columns=["width"])
    once = meta.dropDuplicates()
    assert T.check_alignment(once, "t", columns=["width"]).where("aligned").count() == 2
    with pytest.raises(Exception, match="no image named"):
        T.check_alignment(once, "z", columns=["width"]).collect()
    stats = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0), ("b", 3.0, 4.0)], "path string, mean double, std double")
    assert T.norm_params(stats, {"m": ["a"]}).first()["means"] == [1.0]
    for wrong in ("b", "c"):
        with pytest.raises(Exception, match="not exactly one"):
            T.norm_params(stats, {"m": ["a", wrong]}).collect()
    ids = spark.createDataFrame([("p",), (None,)], "patch_id string")
    rows = spark.createDataFrame([("p",), ("q",)], "patch_id string")
    assert [r[0] for r in T.exclude_ids(rows, ids).collect()] == ["q"]


def crowded_boxes(n, seed):
    """A third in one spot of a cell, some larger than a cell, the rest anywhere."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        near = i % 3 == 0
        x, y = (rng.uniform(0, 12), rng.uniform(0, 12)) if near else (rng.uniform(-200, 200), rng.uniform(-200, 200))
        side = 0.5 if near else rng.choice([1, 5, 90])
        out.append((x, y, x + rng.uniform(0, side), y + rng.uniform(0, side)))
    return out


@pytest.mark.parametrize("predicate,tol", [("intersects", 0.0), ("overlaps", 0.0), ("within", 0.25), ("intersects", 1.5)])
def test_crowded_cells_are_cut_and_pairs_stay(spark, monkeypatch, predicate, tol):
    monkeypatch.setattr(S, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(S, "CROWDED", 20)
    a, b = crowded_boxes(300, 1), crowded_boxes(300, 2)
    # equal corners on the lines of finer cells, and copies that no cut separates
    a, b = a + [(12.5, 12.5, 12.5, 12.5)] * 30, b + [(12.5, 12.5, 25.0, 25.0)] * 30
    left, right = table(spark, a), table(spark, b).withColumnRenamed("id", "j")
    plain = left.crossJoin(right.toDF("j", "bx0", "by0", "bx1", "by1")).where(
        boxes.PREDICATES[predicate](boxes.box(), boxes.box("b"), tol)
    )
    want = sorted(map(tuple, plain.select("id", "j").collect()))
    got = S.spatial_join(left, right, predicate, cell=50.0, tol=tol).select("id", "j").collect()
    assert sorted(map(tuple, got)) == want
    assert len(want) > 100
    met = {i for i, _ in want}
    for how in ("left_semi", "left_anti"):
        ids = [r["id"] for r in S.spatial_join(left, right, predicate, how, 50.0, tol=tol).collect()]
        assert sorted(ids) == [i for i in range(len(a)) if (i in met) == (how == "left_semi")]


def test_leaves_of_a_crowded_cell_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(S, "CROWDED", 50)
    rng = random.Random(5)
    spots = [[(x := rng.uniform(0, 5), y := rng.uniform(0, 5), x + 0.01, y + 0.01) for _ in range(2000)] for _ in range(2)]
    left, right = (table(spark, rows) for rows in spots)
    lists = S.leaf_lists(left, right, 50.0, 0.0, ["id"], ["id"])
    counts = [df.groupBy(*S.LEAF).count() for df in lists]
    both = counts[0].join(counts[1].withColumnRenamed("count", "m"), S.LEAF)
    worst = both.select(F.max(F.least("count", "m")).alias("n"), F.max("lv").alias("lv")).first()
    assert worst["n"] <= 50 and worst["lv"] > 3
    # boxes as large as the cell stay where they are
    large = table(spark, [(0, 0, 49, 49)] * 200)
    assert S.leaf_lists(large, large, 50.0, 0.0, ["id"], ["id"])[0].select(F.max("lv")).first()[0] == 0
