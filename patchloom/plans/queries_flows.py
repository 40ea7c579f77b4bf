"""Text sources, streams and models over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.operators import labels as L, ml
from patchloom.plans.fixtures import CLASSES, table, view, with_views
from patchloom.plans.queries_metrics import rounded
from patchloom.plans.queries_tables import PRESENT, WIDE, presence
from patchloom.plans.registry import query
from patchloom.sources.logs import parse_training_log
from patchloom.sources.tables import parse_label_vectors
from patchloom.functions.geometry import box_geom
from patchloom.session import shared_dir, written
from patchloom.sources.geojson import feature_text, read_geojson, read_geojson_lines, write_geojson
from patchloom.sources.tables import (
    discover,
    first_match,
    read_class_codes,
    read_run_metadata,
    read_table_csv,
    training_curves,
)
from patchloom.sources.writers import overwrite_in_place, write_once, write_patches, write_report
from patchloom.streaming.best import best_of_stream, stream_running_best
from patchloom.streaming.stats import stats_of_stream


@query(
    "label_vectors",
    with_views(
        "class_area",
        "select cast(patch as varchar) as patch_id, " + " + ".join(f'"{c}" * {10 ** i}' for i, c in enumerate(CLASSES))
        + " as code from p",
        wide=WIDE,
        p=PRESENT,
    ),
)
def _vectors(spark, d):
    files = presence(spark, d).select(
        F.concat(F.lit("/labels/"), "patch", F.lit("_labels.csv")).alias("name"),
        F.concat(*[x for c in CLASSES for x in (F.col(f"`{c}`").cast("string"), F.lit("\n"))]).alias("value"),
    )
    parsed = parse_label_vectors(files)
    code = sum(F.get(F.col("labels"), F.lit(i)) * 10**i for i in range(len(CLASSES)))
    return parsed.select("patch_id", code.cast("int").alias("code"))


@query(
    "training_log",
    with_views(
        "runlog",
        """select run, cast(epoch as int) as epoch, round(loss, 4) as train_loss, round(loss / 2, 4) as val_loss,
 round(epoch % 100 + 0.25e0, 2) as val_accuracy, epoch % 3 = 0 as saved_best_loss from runlog""",
    ),
)
def _log(spark, d):
    log = view(spark, d, "runlog")
    loss = F.format_string("%.4f", F.round("loss", 4))
    half = F.format_string("%.4f", F.round(F.col("loss") / 2, 4))
    acc = F.format_string("%.2f", F.col("epoch") % 100 + 0.25)
    text = F.array(
        F.concat(F.lit("Epoch "), "epoch", F.lit("/100000")),
        F.concat(F.lit("TRAINING   -- Loss: "), loss, F.lit("  |  Accuracy: "), acc, F.lit("%  |  Time: 1.5 mins.")),
        F.concat(F.lit("VALIDATION -- Loss: "), half, F.lit("  |  Accuracy: "), acc, F.lit("%  |  Time: 0.5 mins.")),
        F.when(F.col("epoch") % 3 == 0, F.concat(F.lit("New best model saved with loss "), half, F.lit("...")))
        .otherwise(F.lit("")),
    )
    lines = log.select("run", "epoch", F.posexplode(text).alias("i", "value")).select(
        "run", (F.col("epoch") * 4 + F.col("i")).alias("pos"), "value"
    )
    out = parse_training_log(lines)
    return out.select("run", "epoch", "train_loss", "val_loss", "val_accuracy", "saved_best_loss")


def _stream(spark, d, name):
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")


@query(
    "stream_channel_stats",
    "select l_returnflag as band, count(*) as n, round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as std from lineitem group by l_returnflag",
)
def _stream_stats(spark, d):
    pixels = _stream(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("band"), F.col("l_quantity").alias("v")
    )
    return rounded(stats_of_stream(pixels, ["band"]), 6, "mean", "std")


STREAM_BEST = """select event_type as run, event_id as epoch, coalesce(value < min(value) over w, true) as new_best,
 coalesce(100 - value > max(100 - value) over w, 100 - value > 0) as new_best_accuracy from events
 window w as (partition by event_type order by event_id rows between unbounded preceding and 1 preceding)"""


@query("stream_running_best", STREAM_BEST)
def _stream_best(spark, d):
    log = _stream(spark, d, "events").select(
        F.col("event_type").alias("run"),
        F.col("event_id").alias("epoch"),
        F.col("value").alias("loss"),
        (100 - F.col("value")).alias("accuracy"),
    )
    return best_of_stream(log).select("run", "epoch", "new_best", "new_best_accuracy")


WEIGHTS = [[((i * 7 + k * 3) % 11 - 5) / 5 for k in range(3)] for i in range(64)]


@query(
    "score",
    """select vec_id as sid, k, label % 2 as y, round(1 / (1 + exp(-dot)), 6) as score from (
 select vec_id, label, k, sum(cast(x as double) * (((pos - 1) * 7 + k * 3) % 11 - 5) / 5) as dot from (
  select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings), range(3) r(k)
 group by vec_id, label, k)""",
)
def _score(spark, d):
    weights = WEIGHTS

    def model(batch):
        import numpy as np

        return np.stack(batch["embedding"].to_numpy()).astype(float) @ np.array(weights)

    samples = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sid"), "embedding", F.array_repeat((F.col("label") % 2).cast("double"), 3).alias("targets")
    )
    return rounded(ml.score(samples, model, 3, "sid", "targets"), 6, "score")


@query(
    "fit_multilabel",
    """select k, count(*) as n, cast(sum(case when label % (k + 2) = 0 then 1 else 0 end) as bigint) as targets,
 true as beats_constant, true as settled from embeddings, (select unnest([0, 1]) as k) ks group by k""",
)
def _fit(spark, d):
    """Fit on chip statistics; per label the counts, and whether the fit has settled and is better than a constant."""
    chips = view(spark, d, "chips").select(
        F.col("image").alias("patch_id"), F.concat(F.lit("row"), "py").alias("image"), "v"
    )
    channels = [f"row{i}" for i in range(8)]
    labels = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("patch_id"),
        *[(F.pmod("label", F.lit(m)) == 0).cast("int").alias(f"l{m}") for m in (2, 3)],
    )
    names = ["l2", "l3"]
    columns = [f"{c}_{s}" for c in channels for s in ("mean", "std")]
    features = written(ml.chip_features(chips, channels).join(labels, "patch_id"))
    weights = {r["class"]: r["weight"] for r in L.class_weights(labels, names, scale=False).collect()}
    models = ml.fit_multilabel(features, columns, names, weights)
    report = ml.fit_report(models, features, columns, "patch_id", weights)
    return report.select(
        "k", "n", "targets", (F.col("loss") < F.col("constant_loss")).alias("beats_constant"),
        (F.col("gradient") < 1e-3).alias("settled"),
    )


ROWS = [(i, s, f) for i in range(8) for s, f in (("mean", "avg"), ("std", "stddev_pop"))]


@query(
    "chip_features",
    with_views(
        "chips",
        "select image as patch_id, " + ", ".join(f"round({f}(case when py = {i} then v end), 6) as row{i}_{s}" for i, s, f in ROWS)
        + " from chips group by image",
    ),
)
def _chip_features(spark, d):
    chips = view(spark, d, "chips").select(
        F.col("image").alias("patch_id"), F.concat(F.lit("row"), "py").alias("image"), "v"
    )
    out = ml.chip_features(chips, [f"row{i}" for i in range(8)])
    return rounded(out, 6, *[c for c in out.columns if c != "patch_id"])


# --- sinks, read back -----------------------------------------------------------


@query("csv_round_trip", "select c_custkey as patch_id, c_acctbal as mean, c_mktsegment as path from customer")
def _csv(spark, d):
    path = shared_dir(spark)
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("patch_id"), F.col("c_acctbal").alias("mean"), F.col("c_mktsegment").alias("path")
    )
    write_report(rows, path)
    return read_table_csv(spark, path, "patch_id bigint, mean double, path string")


@query(
    "geojson_round_trip",
    with_views("units", "select gid, symbol, 'Polygon' as geometry_type, x0, y0, x1, y1 from units"),
)
def _geojson(spark, d):
    path = shared_dir(spark)
    units = view(spark, d, "units").withColumn(
        "geom", box_geom(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    )
    write_geojson(units, path, ["gid", "symbol"])
    return read_geojson_lines(spark, path, "gid bigint, symbol string").drop("geom")


@query("write_once", "select o_orderkey as sid, o_custkey as patch from orders")
def _once(spark, d):
    path = shared_dir(spark)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("sid"), F.col("o_custkey").alias("patch"))
    write_once(orders, path)
    write_once(orders.withColumn("patch", F.lit(-1).cast("bigint")), path)  # must not replace it
    return spark.read.schema(orders.schema).parquet(path)


@query("overwrite_in_place", "select o_orderkey as sid, o_totalprice * 2 as price from orders where o_totalprice > 1000")
def _in_place(spark, d):
    path = shared_dir(spark)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("sid"), F.col("o_totalprice").alias("price"))
    orders.write.parquet(path)
    stored = spark.read.schema(orders.schema).parquet(path)
    overwrite_in_place(stored.where("price > 1000").withColumn("price", F.col("price") * 2), path)
    return spark.read.schema(orders.schema).parquet(path)


@query(
    "write_patches",
    with_views("chips", "select concat(cast(image as varchar), '_chip') as patch_name, px, py, v from chips"),
)
def _write_patches(spark, d):
    path = shared_dir(spark)
    chips = view(spark, d, "chips").select(
        F.col("image").alias("patch_id"), F.lit("chip").alias("image"), "px", "py", "v"
    )
    write_patches(chips, path, buckets=8)
    return spark.read.parquet(path).where("image = 'chip'").select("patch_name", "px", "py", "v")


# --- sources: whole documents, records, path discovery ------------------------------


@query(
    "feature_collection",
    with_views("units", "select 'EPSG:26916' as crs, gid, symbol, 'Polygon' as geometry_type, x0, y0, x1, y1 from units"),
)
def _feature_collection(spark, d):
    """One collection per symbol, written as a document of its own and read again."""
    path = shared_dir(spark)
    units = view(spark, d, "units").withColumn("geom", box_geom(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    lines = units.select("symbol", feature_text(["gid", "symbol"], "geom").alias("f"))
    head = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"EPSG:26916"}},"features":['
    document = F.concat(F.lit(head), F.array_join(F.collect_list("f"), ","), F.lit("]}"))
    documents = lines.groupBy(F.col("symbol").alias("part")).agg(document.alias("value"))
    documents.write.partitionBy("part").text(path)
    return read_geojson(spark, f"{path}/part=*", "gid bigint, symbol string").drop("geom")


@query(
    "class_codes",
    """select c_mktsegment as symbol, cast(c_nationkey as varchar) as source, cast(count(*) as int) as code
 from customer group by c_mktsegment, c_nationkey""",
)
def _class_codes(spark, d):
    """A JSON map of symbols to codes per nation."""
    path = shared_dir(spark)
    counts = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").cast("int").alias("n"))
    entries = F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n")))
    maps = counts.groupBy("c_nationkey").agg(F.to_json(entries).alias("value"))
    maps.write.partitionBy("c_nationkey").text(path)
    codes = read_class_codes(spark, f"{path}/c_nationkey=*")
    return codes.select("symbol", F.regexp_extract("source", r"c_nationkey=(\d+)", 1).alias("source"), "code")


@query(
    "run_records",
    with_views("runlog", "select run, cast(epoch as int) as epoch, loss as training_loss, loss / 2 as validation_loss from runlog"),
)
def _run_records(spark, d):
    """Training curves out of one nested JSON record per run."""
    path = shared_dir(spark)
    log = F.array_sort(F.collect_list(F.struct("epoch", "loss")))
    runs = view(spark, d, "runlog").groupBy("run").agg(log.alias("l"))
    loss = F.transform("l", lambda e: e["loss"])
    half = F.transform("l", lambda e: e["loss"] / 2)
    training = F.struct(loss.alias("training loss"), half.alias("validation loss"))
    records = runs.select("run", F.to_json(F.struct(F.col("run").alias("NAME"), training.alias("TRAINING"))).alias("value"))
    records.write.partitionBy("run").text(path)
    curves = training_curves(read_run_metadata(spark, f"{path}/run=*"))
    return curves.select("run", "epoch", "training_loss", "validation_loss")


@query(
    "discover",
    """select c_mktsegment as symbol, c_mktsegment = min(c_mktsegment) over () as first from (select distinct c_mktsegment from customer)""",
)
def _discover(spark, d):
    """Files found by pattern below the folders of a partitioned table, and the first of them."""
    path = shared_dir(spark)
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("symbol"), "c_custkey")
    rows.repartition("symbol").write.partitionBy("symbol").parquet(path)
    pattern = f"{path}/symbol=*/*.parquet"
    first = first_match(spark, pattern)
    found = discover(spark, pattern).groupBy(F.regexp_extract("path", "symbol=([^/]+)", 1).alias("symbol"))
    return found.agg(F.bool_or(F.col("path") == first).alias("first"))


@query("stream_best_stateful", STREAM_BEST)
def _stream_stateful(spark, d):
    """The stateful operator over several micro-batches: one file of later epochs after the other."""
    path, out = shared_dir(spark), shared_dir(spark)
    events = table(spark, d, "events").select(
        F.col("event_type").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("loss"),
        (100 - F.col("value")).alias("accuracy"),
    )
    last = events.agg(F.max("epoch")).first()[0] or 0
    for quarter in range(4):
        events.where(F.floor(F.col("epoch") * 4 / (last + 1)) == quarter).coalesce(1).write.mode("append").parquet(path)
    log = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    flags = stream_running_best(log).writeStream.outputMode("append").option("checkpointLocation", f"{out}/checkpoint")
    flags.trigger(availableNow=True).start(f"{out}/flags").awaitTermination()
    return spark.read.parquet(f"{out}/flags").select("run", "epoch", "new_best", "new_best_accuracy")
