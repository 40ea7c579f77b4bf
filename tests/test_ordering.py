import random

import pytest
from pyspark.sql import Window, functions as F

from patchloom.operators import lookup, ordering as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(("hot" if rng.random() < 0.6 else f"g{i % 5}"), rng.randrange(400), i) for i in range(6000)]
    return spark.createDataFrame(data, "g string, x int, id int").cache()


@pytest.mark.parametrize("size", [None, 50, 700])
def test_row_number_equals_window(rows, size):
    got = O.row_number_by(rows, ["x", "id"], "rn", ["g"], rows_per_bucket=size)
    w = Window.partitionBy("g").orderBy("x", "id")
    want = rows.withColumn("rn", F.row_number().over(w).cast("long"))
    assert got.select("id", "rn").exceptAll(want.select("id", "rn")).count() == 0
    assert got.count() == 6000


def test_buckets_split_the_hot_group(rows):
    cut = O.range_buckets(rows, ["g"], ["x", "id"], 200)
    sizes = cut.df.where("g = 'hot'").groupBy(O.BUCKET).count()
    assert sizes.count() > 5
    assert sizes.agg(F.max("count")).first()[0] < 3600 / 2


def test_hot_first_column_is_split_by_the_whole_key(spark):
    df = spark.range(4000).select(
        F.lit("g").alias("g"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50).alias("x"), "id"
    )
    cut = O.range_buckets(df, ["g"], ["x", "id"], 100)
    assert cut.df.where("x = 7").select(O.BUCKET).distinct().count() > 5
    got = O.row_number_by(df, ["x", "id"], "rn", ["g"], rows_per_bucket=100)
    w = Window.partitionBy("g").orderBy("x", "id")
    want = df.withColumn("rn", F.row_number().over(w).cast("long"))
    assert got.select("id", "rn").exceptAll(want.select("id", "rn")).count() == 0


def test_null_and_nan_keys_keep_their_order(spark):
    values = [None, float("nan"), float("inf"), -float("inf")] + [float(i % 97) for i in range(1000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, id int")
    got = O.row_number_by(df, ["x", "id"], "rn", rows_per_bucket=50)
    want = df.withColumn("rn", F.row_number().over(Window.orderBy("x", "id")).cast("long"))
    assert got.select("id", "rn").exceptAll(want.select("id", "rn")).count() == 0


def test_copies_of_one_key_stay_together(spark):
    same = spark.range(3000).select(F.lit("g").alias("g"), F.lit(7).alias("x"))
    cut = O.range_buckets(same, ["g"], ["x"], 100)
    assert cut.df.select(O.BUCKET).distinct().count() == 1


@pytest.mark.parametrize("size", [None, 60])
def test_running_extremes(rows, size):
    cut = O.range_buckets(rows, ["g"], ["x", "id"], size)
    got = O.running_extreme_before(cut, ["g"], ["x", "id"], {"lo": ("min", "id"), "hi": ("max", "id")})
    w = Window.partitionBy("g").orderBy("x", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumns({"lo": F.min("id").over(w), "hi": F.max("id").over(w)})
    cols = ["id", "lo", "hi"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_sample_is_exact_and_repeatable(rows):
    order = [O.hash_key(5, "id"), "id"]
    for n in (0, 1, 37, 2500, 6000):
        got = {r["id"] for r in O.sample_n(rows, n, 5, "id").collect()}
        want = {r["id"] for r in rows.orderBy(*order).limit(n).collect()}
        assert got == want and len(got) == n


def test_sample_narrows_down_over_several_levels(rows, monkeypatch):
    monkeypatch.setattr(O, "DRAW_DIGITS", 1)
    got = {r["id"] for r in O.sample_n(rows, 2500, 5, "id", rows_per_bucket=3).collect()}
    assert got == {r["id"] for r in rows.orderBy(O.hash_key(5, "id"), "id").limit(2500).collect()}


@pytest.mark.parametrize("size", [100, 1500, 50_000])
def test_hash_buckets_follow_the_row_count(rows, size):
    cut = O.hash_buckets(rows.withColumn("h", O.hash_key(1, "id")), "h", size)
    assert cut.single == (size >= 6000)
    assert cut.df.groupBy(O.BUCKET).count().agg(F.max("count")).first()[0] <= size * 1.5


def test_sample_too_large(rows):
    with pytest.raises(ValueError):
        O.sample_n(rows, 6001, 5, "id")


def test_batches(rows):
    kept = O.assign_batches(rows, 64, "id", seed=1)
    sizes = {r["batch"]: r["count"] for r in kept.groupBy("batch").count().collect()}
    assert set(sizes.values()) == {64} and len(sizes) == 6000 // 64
    every = O.assign_batches(rows, 64, "id", drop_last=False)
    assert every.count() == 6000
    assert every.where("id = 63").first()["batch"] == 0 and every.where("id = 64").first()["batch"] == 1


@pytest.mark.parametrize("limit", [10, 1000])
def test_attach_small_and_salted(rows, limit):
    """The salted way beyond the size limit gives the same rows as the broadcast."""
    sums = rows.groupBy("x").agg(F.count("*").alias("n"))
    got = lookup.attach(rows, sums, ["x"], ["id"], limit=limit)
    want = rows.join(sums, "x")
    assert got.select("id", "n").exceptAll(want.select("id", "n")).count() == 0
    assert got.count() == 6000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("__salt" in plan) == (limit == 10)


def test_offsets_in_three_levels(spark, monkeypatch):
    monkeypatch.setattr(O, "FAN_OUT", 4)
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 10)
    df = spark.range(600).select("id", (F.col("id") % 3 == 0).alias("g"))
    for part in ([], ["g"]):
        got = O.hash_row_number(df, "id", 7, part=part)
        order = Window.partitionBy(*part).orderBy(O.hash_key(7, "id"), "id")
        wrong = got.withColumn("want", F.row_number().over(order)).where("rn is null or rn <> want")
        assert wrong.count() == 0 and got.count() == 600
    cut = O.hash_buckets(df.withColumn("h", O.hash_key(7, "id")), "h")
    assert cut.buckets > 4**3
    sums = {"n": F.count(F.lit(1))}
    down = O.offsets(cut.df, [], sums, descending=True, buckets=cut.buckets).collect()
    up = O.offsets(cut.df, [], sums, buckets=cut.buckets).collect()
    own = {r[O.BUCKET]: r["count"] for r in cut.df.groupBy(O.BUCKET).count().collect()}
    above = {r[O.BUCKET]: r["__off_n"] for r in down}
    assert all(r["__off_n"] + own[r[O.BUCKET]] + above[r[O.BUCKET]] == 600 for r in up) and len(up) == len(own)
