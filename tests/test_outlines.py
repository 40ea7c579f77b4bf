"""Joins of outlines with outlines against a vertex-by-vertex form."""

import numpy as np
import plain_polygons as plain
import pytest
from pyspark.sql import functions as F

from patchloom.functions import geometry as G
from patchloom.operators import outlines as O, spatial as S
from patchloom.session import written_count


def closed(points):
    points = [[float(x), float(y)] for x, y in points]
    return [*points, points[0]]


def star(rng, at, size, n, step=1.0):
    """A ring around a centre, often concave, with corners on a lattice so that borders meet."""
    angle = np.sort(rng.choice(24, n, replace=False)) * np.pi / 12
    reach = rng.uniform(0.3, 1, n) * size
    points = np.round((np.c_[np.cos(angle), np.sin(angle)] * reach[:, None] + at) / step) * step
    kept = [p for i, p in enumerate(points.tolist()) if p != points.tolist()[i - 1]]
    return closed(kept) if len({tuple(p) for p in kept}) > 3 else closed([(0, 0), (1, 2), (2, 0)])


def shapes(seed, count):
    rng = np.random.default_rng(seed)
    out = [[[star(rng, rng.uniform(0, 16, 2), 6, 9, 0.25)]] for _ in range(count)]
    square, hole = closed([(0, 0), (8, 0), (8, 8), (0, 8)]), closed([(2, 2), (6, 2), (6, 6), (2, 6)])
    slant = [(0, 0), (6, 3), (4, 7), (-2, 4)]
    out += [[[square, hole]], [[hole]], [[closed([(3, 3), (5, 3), (5, 5), (3, 5)])]], [[square]], [[closed(slant)]],
            [[closed([(6, 3), (12, 6), (10, 10), (4, 7)])]], [[closed([(3, 1.5), (6, 3), (9, -3)])]],
            [[closed([(8, 8), (9, 8), (9, 9)])], [closed([(20, 20), (22, 20), (20, 22)])]],
            [[closed([(2, 2), (6, 2), (6, 6), (2, 6)])], [closed([(30, 0), (31, 0), (31, 1)])]],
            [[closed([(0, 0), (8, 0), (8, 8), (7, 8), (7, 1), (1, 1), (1, 8), (0, 8)])]]]
    return out


def table_of(spark, geoms):
    return G.bbox(spark.createDataFrame(list(enumerate(geoms)), f"id long, geom {G.GEOM_TYPE}"))


@pytest.mark.parametrize("cell", [1.7, 50.0])
def test_relations_of_slanted_concave_and_holed_outlines(spark, cell):
    geoms = shapes(3, 14)
    df = table_of(spark, geoms)
    one, two = df.select(F.col("id").alias(O.LEFT), "geom"), df.select(F.col("id").alias(O.RIGHT), "geom")
    names = ["intersects", "within", "overlaps", "touches"]
    got = {(r[O.LEFT], r[O.RIGHT]): [r[n] for n in names] for r in O.relate_outlines(one, two, cell).collect()}
    seen = set()
    for i, a in enumerate(geoms):
        for j, b in enumerate(geoms):
            want = plain.relation(a, b)
            assert got.get((i, j), [False] * 4) == [want[n] for n in names], (i, j, a, b)
            seen |= {n for n in names if want[n]}
    assert seen == set(names)


def test_shared_borders_add_up(spark):
    geoms = shapes(5, 14)
    df = table_of(spark, geoms)
    one, two = df.select(F.col("id").alias(O.LEFT), "geom"), df.select(F.col("id").alias(O.RIGHT), "geom")
    got = {(r[O.LEFT], r[O.RIGHT]): r["shared"] for r in O.shared_borders(one, two, 3.0).collect()}
    for i, a in enumerate(geoms):
        for j, b in enumerate(geoms):
            assert got.get((i, j), 0.0) == pytest.approx(plain.shared_length(a, b), abs=1e-6), (i, j)
    assert sum(v > 1 for (i, j), v in got.items() if i != j) > 4


def test_reassignment_by_slanted_borders(spark):
    middle = closed([(0, 0), (10, 5), (8, 9), (-2, 4)])
    rows = [
        (0, "water", [[middle]]),
        (1, "clay", [[closed([(0, 0), (4, 2), (4, -3)])]]),
        (2, "sand", [[closed([(4, 2), (10, 5), (12, 0)])], [closed([(40, 40), (41, 40), (40, 41)])]]),
        (3, "rock", [[closed([(8, 9), (10, 5), (14, 9)])]]),
        (4, "water", [[closed([(100, 100), (101, 100), (100, 101)])]]),
    ]
    units = G.bbox(spark.createDataFrame(rows, f"gid long, symbol string, geom {G.GEOM_TYPE}"))
    found = S.reassign_symbol(units, ["water"], 3.0, geometry=True)
    assert {r.gid: r.symbol for r in found.collect()} == {0: "sand", 1: "clay", 2: "sand", 3: "rock", 4: "water"}


def test_rows_beside_outlines(spark):
    """Copies on the right are pairs of their own, columns keep their names, empty sides give nothing."""
    df = table_of(spark, shapes(1, 0)[4:6]).withColumn("crs", F.lit("EPSG:3857"))
    both = df.unionAll(df.where("id = 1"))
    out = S.spatial_join(df, both, "touches", cell=2.0, exact_geometry=True)
    assert out.columns == [*df.columns, *(f"{c}_right" for c in df.columns if c != "crs")]
    assert sorted((r.id, r.id_right) for r in out.collect()) == [(0, 1), (0, 1), (1, 0)]
    none = df.where("false")
    assert S.spatial_join(df, none, "intersects", "left_anti", 2.0, exact_geometry=True).count() == 2
    assert S.spatial_join(none, df, "intersects", cell=2.0, exact_geometry=True).count() == 0


def test_no_outline_meets_python(spark):
    df = table_of(spark, shapes(1, 2))
    for out in (
        S.spatial_join(df, df, "overlaps", cell=2.0, exact_geometry=True),
        S.reassign_symbol(df.withColumn("symbol", F.col("id").cast("string")), ["1"], 2.0, unit_id="id", geometry=True),
    ):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_several_predicates_relate_outlines_once(spark):
    square = [[[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]]]
    moved = {"over": (2.0, 2.0), "in": (1.0, 1.0), "beside": (4.0, 0.0), "far": (9.0, 9.0)}
    rows = [(k, [[[[x + p[0] / 2, y + p[1] / 2] for p in square[0][0]]]]) for k, (x, y) in moved.items()]
    left = G.bbox(spark.createDataFrame([*rows, (None, square)], f"id string, geom {G.GEOM_TYPE}"))
    right = G.bbox(spark.createDataFrame([(1, square), (1, square)], f"no int, geom {G.GEOM_TYPE}"))
    related = O.outline_relations(left, right, 3.0, "id")
    before = written_count()
    for p in ("intersects", "overlaps", "within", "touches"):
        shared = S.spatial_join(left, right, p, cell=3.0, exact_geometry=True, related=related)
        assert written_count() == before
        alone = S.spatial_join(left, right, p, cell=3.0, exact_geometry=True)
        before = written_count()
        got = [sorted(map(repr, df.select("id", "no").collect())) for df in (shared, alone)]
        assert got[0] == got[1]
        assert ("in" in {r.id for r in shared.collect()}) == (p in ("intersects", "within"))
