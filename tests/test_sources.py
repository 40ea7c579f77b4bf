import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.functions import geometry as G
from patchloom.operators import ml
from patchloom.operators.raster import channel_stats
from patchloom.operators.runlog import running_best
from patchloom.sources import geojson, logs, tables, writers
from patchloom.streaming import best, stats


def test_geojson_round_trip(spark, tmp_path):
    square = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    doc = {
        "type": "FeatureCollection",
        "crs": {"type": "name", "properties": {"name": "EPSG:3857"}},
        "features": [
            {"type": "Feature", "properties": {"Symbol": "Qal", "n": 1}, "geometry": {"type": "Polygon", "coordinates": square}},
            {"type": "Feature", "properties": {"Symbol": None, "n": 2}, "geometry": {"type": "MultiPolygon", "coordinates": [square, [[[5.0, 5.0], [7.0, 5.0], [7.0, 9.0], [5.0, 5.0]]]]}},
        ],
    }
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=1))
    df = geojson.read_geojson(spark, str(tmp_path / "a.geojson"), "Symbol string, n int")
    rows = {r["n"]: r for r in df.collect()}
    assert rows[1]["Symbol"] == "Qal" and rows[1]["geom"] == [square] and rows[1]["crs"] == "EPSG:3857"
    assert rows[2]["geometry_type"] == "MultiPolygon" and (rows[2]["x1"], rows[2]["y1"]) == (7.0, 9.0)
    assert G.explode_parts(df).count() == 3
    geojson.write_geojson(df, str(tmp_path / "out"), ["Symbol", "n"])
    again = geojson.read_geojson_lines(spark, str(tmp_path / "out"), "Symbol string, n int")
    assert {r["n"]: r["geom"] for r in again.collect()} == {n: r["geom"] for n, r in rows.items()}
    for line in (tmp_path / "out").glob("part-*"):
        for text in line.read_text().splitlines():
            assert json.loads(text)["type"] == "Feature"


def test_geojson_documents_are_read_once(spark, tmp_path):
    ring = [[0.1, 1e-7], [12345678.123456789, 3], [0.30000000000000004, 5e300], [0.1, 1e-7]]
    features = [
        {"type": "Feature", "properties": {"n": i}, "geometry": {"type": "Polygon", "coordinates": [ring]}} for i in range(2000)
    ]
    path = tmp_path / "many.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))

    def bytes_read():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    before = bytes_read()
    rows = geojson.read_geojson(spark, str(path), "n int").collect()
    assert bytes_read() - before <= 2 * path.stat().st_size
    assert sorted(r["n"] for r in rows) == list(range(2000)) and all(r["geom"] == [[ring]] for r in rows)


def test_small_text_sources(spark, tmp_path):
    (tmp_path / "stats.csv").write_text("path,mean,std\ndem.tif,5.5,2.0\n")
    got = tables.read_table_csv(spark, str(tmp_path / "stats.csv"), tables.STATS_SCHEMA).first()
    assert tuple(got) == ("dem.tif", 5.5, 2.0)
    (tmp_path / "256_50_1_labels.csv").write_text("1.0\n0.0\n1.0\n")
    (tmp_path / "256_50_2_labels.csv").write_text("0 1 0\n")
    got = {r["patch_id"]: r["labels"] for r in tables.read_label_vectors(spark, str(tmp_path)).collect()}
    assert got == {"256_50_1": [1, 0, 1], "256_50_2": [0, 1, 0]}
    (tmp_path / "codes.json").write_text(json.dumps({"af1": 1, "Qal": 2}))
    got = tables.read_class_codes(spark, str(tmp_path / "codes.json"))
    assert {(r["symbol"], r["code"]) for r in got.collect()} == {("af1", 1), ("Qal", 2)}
    assert tables.first_match(spark, f"{tmp_path}/*_labels.csv").endswith("256_50_1_labels.csv")
    assert tables.discover(spark, f"{tmp_path}/*_labels.csv").count() == 2


def test_run_metadata(spark, tmp_path):
    record = {
        "NAME": "r1",
        "MODALITIES": {"modalities": {"dem": ["dem.tif"]}, "normalization values": {"dem": [[5.0], [2.0]]}},
        "HYPERPARAMETERS": {"batch size": 32, "alpha": [[0.1, 0.2]], "gamma": 2, "momentum": None},
        "TRAINING": {"training loss": [3.0, 2.0], "training accuracy": [1.0, 2.0], "validation loss": [4.0, 3.0], "validation accuracy": [5.0, 6.0]},
    }
    (tmp_path / "m.json").write_text(json.dumps(record, indent=2))
    runs = tables.read_run_metadata(spark, str(tmp_path / "*.json"))
    r = runs.first()
    assert r["MODALITIES"]["normalization values"]["dem"] == [[5.0], [2.0]]
    assert r["HYPERPARAMETERS"]["alpha"] == [[0.1, 0.2]] and r["HYPERPARAMETERS"]["momentum"] is None
    curves = tables.training_curves(runs)
    assert {(x["epoch"], x["validation_loss"]) for x in curves.collect()} == {(1, 4.0), (2, 3.0)}


def epoch_text(number, phases, saved):
    lines = [f"Epoch {number}/4"]
    lines += [f"{p} -- Loss: {x}  |  Accuracy: {a}%  |  Time: {t} mins." for p, x, a, t in phases]
    return "\n".join(lines + [f"New best model saved with {s}..." for s in saved])


def log_text():
    """A run that was started again in its first epoch; all figures are made up."""
    epochs = [
        epoch_text(1, [], []),
        epoch_text(1, [("TRAINING  ", 6.25, 11.5, 2.5), ("VALIDATION", 5.5, 20.25, 0.75)], ["loss 5.5", "accuracy 20.25%"]),
        epoch_text(2, [("TRAINING  ", 4.0, 31.0, 2.0), ("VALIDATION", 4.75, 18.5, 0.5)], ["loss 4.75"]),
        epoch_text(3, [("TRAINING  ", 3.5, 44.0, 2.25), ("VALIDATION", 4.75, 35.0, 0.25)], ["accuracy 35.0%"]),
    ]
    return "\n\n".join(epochs)


def test_training_log(spark, tmp_path):
    (tmp_path / "run.txt").write_text(log_text())
    df = logs.read_training_log(spark, str(tmp_path / "*.txt"))
    rows = {r["epoch"]: r for r in df.collect()}
    assert sorted(rows) == [1, 2, 3]
    assert (rows[1]["train_loss"], rows[1]["val_accuracy"], rows[1]["val_minutes"]) == (6.25, 20.25, 0.75)
    flags = running_best(df.withColumnsRenamed({"val_loss": "loss", "val_accuracy": "accuracy"}))
    for r in flags.collect():
        assert r["new_best"] == bool(r["saved_best_loss"]), r
        assert r["new_best_accuracy"] == bool(r["saved_best_accuracy"]), r


def test_writers(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    writers.write_once(df, str(tmp_path / "t"))
    writers.write_once(df.limit(3), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10
    table = spark.read.parquet(str(tmp_path / "t"))
    writers.overwrite_in_place(table.withColumn("v", F.col("v") + 1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.sum("v")).first()[0] == 100
    writers.write_report(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == ["id", "v"]
    chips = spark.createDataFrame([(f"p{i}", im, 0, 0, 1.0) for i in range(20) for im in ("a", "b")], "patch_id string, image string, col int, row int, v double")
    writers.write_patches(chips, str(tmp_path / "p"), buckets=4)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 40 and back.where("image = 'a' and patch_name = 'p3_a'").count() == 1


def stream_of(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))


def test_stream_stats_equal_batch(spark, tmp_path):
    schema = "image string, v double"
    parts = [[("a", float(i)), ("b", None), ("b", float(i * i))] for i in range(4)]
    stream = stream_of(spark, tmp_path, parts, schema)
    got = {r["image"]: (r["n"], r["mean"], r["std"]) for r in stats.stats_of_stream(stream, ["image"]).collect()}
    batch = channel_stats(spark.createDataFrame([r for p in parts for r in p], schema))
    for r in batch.collect():
        assert got[r["image"]] == pytest.approx((r["n"], r["mean"], r["std"]))


RECORDS = "run string, epoch bigint, loss double, accuracy double"
PARTS = [
    [("a", 2, 2.0, 60.0), ("a", 1, 3.0, 50.0), ("b", 1, 1.0, 10.0)],
    [("a", 3, 2.0, 61.0), ("a", 4, 1.5, 40.0)],
    [("a", 5, 1.4, 40.0), ("b", 2, 1.0, 11.0), ("a", 1, 0.1, 99.0)],  # the last one is late
]


def expected_flags(spark):
    rows = [r for p in PARTS for r in p][:-1]
    return {(r["run"], r["epoch"]): (r["new_best"], r["new_best_accuracy"]) for r in running_best(spark.createDataFrame(rows, RECORDS)).collect()}


def test_stream_best_state(spark, tmp_path):
    stream = stream_of(spark, tmp_path, PARTS, RECORDS)
    q = (
        best.stream_running_best(stream)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    out = spark.read.schema(best.OUTPUT).parquet(str(tmp_path / "out")).collect()
    assert {(r["run"], r["epoch"]): (r["new_best"], r["new_best_accuracy"]) for r in out} == expected_flags(spark)


def test_stream_best_batches(spark, tmp_path):
    stream = stream_of(spark, tmp_path, PARTS, RECORDS)
    out = best.best_of_stream(stream).collect()
    assert {(r["run"], r["epoch"]): (r["new_best"], r["new_best_accuracy"]) for r in out} == expected_flags(spark)


LATE_PARTS = [
    [("a", 2, 2.0, 60.0)],
    [("a", 1, 0.5, 90.0), ("a", 3, 1.0, 70.0)],  # the first is late and better
    [("a", 4, 0.4, 80.0), ("a", 2, 3.0, 1.0)],
]


def test_stream_best_state_keeps_late_records(spark, tmp_path):
    stream = best.stream_running_best(stream_of(spark, tmp_path, LATE_PARTS, RECORDS), ignore_late=False)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(best.OUTPUT_LATE).parquet(str(tmp_path / "out")).collect()
    got = sorted((r["epoch"], r["loss"], r["new_best"], r["new_best_accuracy"], r["late"]) for r in out)
    assert got == [
        (1, 0.5, None, None, True), (2, 2.0, True, True, False), (2, 3.0, None, None, True),
        (3, 1.0, False, False, False), (4, 0.4, True, False, False),
    ]


def test_stream_best_batches_keep_late_records(spark, tmp_path):
    stream = stream_of(spark, tmp_path, LATE_PARTS, RECORDS)
    table = str(tmp_path / "best")
    best.start_best(stream, table, str(tmp_path / "ck"), ignore_late=False).awaitTermination()
    late = spark.read.parquet(f"{table}/late").collect()
    assert sorted((r["epoch"], r["loss"]) for r in late) == [(1, 0.5), (2, 3.0)]
    flags = spark.read.parquet(f"{table}/flags").collect()
    got = sorted((r["epoch"], r["new_best"], r["new_best_accuracy"]) for r in flags)
    assert got == [(2, True, True), (3, False, False), (4, True, False)]


def test_stream_best_batches_keep_records_without_epoch(spark, tmp_path):
    parts = [[("a", 1, 2.0, 60.0)], [("a", None, 0.1, 99.0), ("a", 2, 1.0, 70.0)]]
    table = str(tmp_path / "best")
    best.start_best(stream_of(spark, tmp_path, parts, RECORDS), table, str(tmp_path / "ck")).awaitTermination()
    assert [(r["epoch"], r["loss"]) for r in spark.read.parquet(f"{table}/late").collect()] == [(None, 0.1)]
    flags = spark.read.parquet(f"{table}/flags").collect()
    assert sorted((r["epoch"], r["new_best"]) for r in flags) == [(1, True), (2, True)]


def test_score_checks_the_model(spark):
    df = spark.range(5).select(F.col("id").alias("sid"), F.array(F.lit(1.0), F.lit(0.0)).alias("t"))
    out = ml.score(df, lambda b: np.zeros((len(b), 2)), 2, "sid", "t")
    assert {(r["k"], r["y"], r["score"]) for r in out.collect()} == {(0, 1, 0.5), (1, 0, 0.5)}
    with pytest.raises(Exception, match="model gave"):
        ml.score(df, lambda b: np.zeros((len(b), 3)), 2, "sid").collect()


def test_fit_finds_separable_labels(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), int(x > 0.6), int(x < 0.3)) for i, x in enumerate(rng.random(200))]
    df = spark.createDataFrame(rows, "patch_id int, x double, hi int, lo int")
    models = ml.fit_multilabel(df, ["x"], ["hi", "lo"], {"hi": 2.0}, reg=0.0)
    out = ml.predict_multilabel(models, df, ["x"], "patch_id")
    right = out.select(((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("double").alias("ok"))
    assert right.agg(F.avg("ok")).first()[0] > 0.95


def test_joint_fit_equals_one_fit_per_label(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3)) * [1, 50, 0.02] + [0, 200, -1]
    logit = x @ [1.0, 0.04, -30.0] - 38
    y = [(rng.random(600) < 1 / (1 + np.exp(-z))).astype(int) for z in (logit, -logit, 0 * logit - 2)]
    rows = [(i, *map(float, r), *map(int, t)) for i, (r, t) in enumerate(zip(x, np.array(y).T))]
    df = spark.createDataFrame(rows, "pid int, a double, b double, c double, u int, v int, w int").repartition(5)
    passes = []
    one = ml._pass
    monkeypatch.setattr(ml, "_pass", lambda *args: passes.append(len(args[2])) or one(*args))
    models = ml.fit_multilabel(df, ["a", "b", "c"], ["u", "v", "w"], {"w": 3.0}, reg=0.01)
    assert passes[0] == 3 and len(passes) < 60  # all labels share a pass
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(df)
    for label, model in models.items():
        weight = F.when(F.col(label) > 0, 3.0 if label == "w" else 1.0).otherwise(1.0)
        plain = LogisticRegression(
            featuresCol="x", labelCol=label, weightCol="h", regParam=0.01, standardization=False, maxIter=500, tol=1e-12
        ).fit(rows.withColumn("h", weight))
        assert model.coefficients == pytest.approx(list(plain.coefficients), rel=1e-3, abs=1e-4)
        assert model.intercept == pytest.approx(plain.intercept, rel=1e-3, abs=2e-3)
    report = ml.fit_report(models, df, ["a", "b", "c"], "pid", {"w": 3.0}, reg=0.01).collect()
    assert len(report) == 3 and all(r["gradient"] < 1e-3 for r in report)


def test_fit_refuses_what_is_not_a_number(spark):
    bad = spark.createDataFrame([(1, 1.0, 0), (2, None, 1)], "patch_id int, x double, t int")
    with pytest.raises(ValueError, match="finite"):
        ml.fit_multilabel(bad, ["x"], ["t"])
    with pytest.raises(ValueError, match="no rows"):
        ml.fit_multilabel(bad.limit(0), ["x"], ["t"])
