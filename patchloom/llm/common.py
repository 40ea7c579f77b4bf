"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchloom.session import written

MAX_ROUNDS = 60
#: Records of an Arrow batch of texts. Spark's default of 10,000 may be gigabytes where texts are long.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Words of 64 bits in the filter that ``sift`` broadcasts.
SIFT_WORDS = 1 << 17


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of ``BATCH_ROWS``, unless the session asks for smaller ones."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components: one row per node that is in an edge between two nodes.

    ``edges`` has two long columns ``u`` and ``v``; the result has ``node`` and
    ``component`` (the smallest node reachable).
    """
    links = stars(edges)
    return links.union(links.select("component").distinct().select("component", "component"))


def stars(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars, as in ``components`` without the smallest nodes.

    Every round is a few aggregates and equi-joins
    whose output is written to the shared folder, so the lineage stays short and
    no node's neighbours have to fit in one task: minima are combined before
    they are shuffled and large join partitions can be split. Rounds end when only
    stars are left, which no further round would change.
    """
    pairs = edges.where("u is not null and v is not null and u <> v")
    links = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if _only_stars(links):
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        links = written(small.union(low.select("u", F.col("low").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _only_stars(links: DataFrame) -> bool:
    """Whether every ``u`` of the distinct links has one ``v`` and no ``v`` is a ``u``."""
    up = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = up.union(links.select("v", F.lit(0), F.lit(1))).groupBy("node")
    ends = ends.agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up > 1 or up = 1 and down = 1").agg(F.count("*")).first()[0]


def sift(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``key`` may be among ``ids``, and those where it is not.

    ``ids`` has the one column ``key``, of the same type. A Bloom filter decides,
    which is at most ``SIFT_WORDS`` rows whatever the size of ``ids``, so broadcasting
    it is bounded; the more ids, the more rows of the first part are not among
    them. A join with ``ids`` must follow on the first part. The second part needs
    none, so its texts are not shuffled.
    """
    h = F.xxhash64(key, F.lit(3))
    word = F.pmod(h, F.lit(SIFT_WORDS)).cast("int").alias("_word")
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.pmod(F.shiftright(h, n), F.lit(64)).cast("int")) for n in (32, 48)]
    mask = bits[0].bitwiseOR(bits[1])
    held = ids.select(word, mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_held"))
    tested = rows.withColumn("_word", word).join(F.broadcast(held), "_word", "left")
    maybe = F.coalesce(F.col("_held").bitwiseAND(mask) == mask, F.lit(False))
    return tested.where(maybe).select(*rows.columns), tested.where(~maybe).select(*rows.columns)


def add_columns(docs: DataFrame, inputs: list[str], ddl: str, start, rows: int = 256) -> DataFrame:
    """``docs`` with columns computed from Arrow batches.

    ``start()`` is called once per task and returns a function from the lists of
    the ``inputs`` columns to the new columns' values, in the order of ``ddl``.
    Columns of the same name are replaced. Batches are cut to ``rows`` rows, so
    that what Python holds beside the texts stays small.
    """
    small_batches(docs.sparkSession)
    added = T.StructType.fromDDL(ddl)
    docs = docs.drop(*(f.name for f in added if f.name not in inputs))
    kept = [f for f in docs.schema if f.name not in added.names]
    schema = T.StructType(kept + added.fields)
    names, types = [f.name for f in kept], [f.type for f in to_arrow_schema(added)]

    def run(batches):
        make = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = make(*(part.column(c).to_pylist() for c in inputs))
                new = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(found, types)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *new], names + added.names)

    return docs.mapInArrow(run, schema)


def span_list(spans: Column | str, kinds: tuple[str, ...], keep=None) -> Column:
    """``kind:start:end`` of all spans, comma-joined; ``keep`` chooses among them."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    names = F.array(*(F.lit(k) for k in kinds))
    spans = spans if keep is None else F.filter(spans, keep)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def count_kind(spans: str, kind: int, keep=None) -> Column:
    """How many spans have the kind; ``keep`` chooses among them."""
    held = F.col(spans) if keep is None else F.filter(spans, keep)
    # one parameter only: Spark gives a second one the place of the element
    return F.size(F.filter(held, lambda x: x["kind"] == kind)).cast("long")
