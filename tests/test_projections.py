import pytest
from pyspark.sql import functions as F

from patchloom.functions import geometry as G
from patchloom.functions.projections import ConformalConic, Ellipsoid, GRS80, TransverseMercator, projection


def through(spark, steps, x, y):
    df = spark.createDataFrame([(float(x), float(y))], "x double, y double")
    for stage in steps:
        df = df.select(*[c.alias(n) for c, n in zip(stage(F.col("x"), F.col("y")), ("x", "y"))])
    return tuple(df.first())


# Published worked examples: system, degrees, plane coordinates.
EXAMPLES = [
    (
        TransverseMercator(-2.0, 49.0, 0.9996012717, 400000.0, -100000.0, Ellipsoid(6377563.396, 299.32496)),
        (0.5, 50.5),
        (577274.99, 69740.50),
    ),
    (
        ConformalConic(
            -99.0, 27 + 50 / 60, 28 + 23 / 60, 30 + 17 / 60, 2000000.0, 0.0, Ellipsoid(20925832.164, 294.97870)
        ),
        (-96.0, 28.5),
        (2963503.91, 254759.80),
    ),
]


@pytest.mark.parametrize("system,degrees,plane", EXAMPLES)
def test_worked_examples(spark, system, degrees, plane):
    assert through(spark, system.forward(), *degrees) == pytest.approx(plane, abs=0.02)
    assert through(spark, system.inverse(), *plane) == pytest.approx(degrees, abs=2e-7)


@pytest.mark.parametrize("crs,lon,lat", [("EPSG:32631", 3, 50), ("EPSG:32719", -69, -33), ("EPSG:3089", -85, 38), ("EPSG:3034", 10, 52), ("EPSG:26916", -87, 37)])
def test_round_trips_below_a_millimetre(spark, crs, lon, lat):
    rows = [(i, [[[[lon + a * 0.7, lat + b * 0.9] for a in range(-3, 4) for b in range(-3, 4)]]]) for i in range(2)]
    rows += [(2, None), (3, [])]
    df = spark.createDataFrame(rows, f"id int, geom {G.GEOM_TYPE}").withColumn("crs", F.lit("EPSG:4326"))
    back = G.to_crs(G.to_crs(df, "EPSG:4326", crs), crs, "EPSG:4326").orderBy("id").collect()
    for (_, want), got in zip(rows, back):
        assert got["crs"] == "EPSG:4326"
        if not want:
            assert got["geom"] == want
            continue
        for a, b in zip(want[0][0], got["geom"][0][0]):
            assert a == pytest.approx(b, abs=5e-9)  # half a millimetre of latitude


def test_a_box_holds_its_bent_sides(spark):
    df = spark.createDataFrame([(1, -88.0, 37.0, -83.0, 39.0), (2, None, None, None, None)], "id int, x0 double, y0 double, x1 double, y1 double")
    box, empty = G.to_crs(df, "EPSG:4269", "EPSG:3089", geom=None).orderBy("id").collect()
    system = projection("EPSG:3089")
    corners = [through(spark, system.forward(), x, y) for x in (-88, -83) for y in (37, 39)]
    lowest = through(spark, system.forward(), -85.75, 37)
    assert lowest[1] < min(y for _, y in corners)  # the southern side bends down between its corners
    assert abs(box["y0"] - lowest[1]) < 50 and box["x0"] == pytest.approx(min(x for x, _ in corners))
    assert empty["x0"] is None


def test_unknown_systems_and_parallels(spark):
    assert projection("EPSG:32661") is None and projection("EPSG:26924") is None
    with pytest.raises(ValueError, match="no transform"):
        G.stages("EPSG:4326", "EPSG:27700")
    one = ConformalConic(-77.0, 18.0, 18.0, 18.0, 250000.0, 150000.0, GRS80)
    x, y = through(spark, one.forward(), -77.0, 18.0)
    assert (x, y) == pytest.approx((250000.0, 150000.0), abs=1e-6)
    south = ConformalConic(20.0, -30.0, -25.0, -35.0, 0.0, 0.0, GRS80)
    assert through(spark, south.inverse(), *through(spark, south.forward(), 25.0, -28.0)) == pytest.approx((25.0, -28.0), abs=1e-9)
