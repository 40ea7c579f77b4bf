"""Derived tables over the benchmark parquet, in SQL that Spark and DuckDB share.

Each table is one projection or aggregate of the given tables, so its size
follows theirs.  ``view`` gives the Spark DataFrame and ``with_views`` the same
tables as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from patchloom.operators.ordering import row_number_by

PATCHES = """select p_partkey as pid, concat('256_50_', cast(p_partkey + 1 as string)) as patch_id,
 floor(p_partkey / 50) * 640e0 as x0, (p_partkey % 50) * 640e0 as y0,
 floor(p_partkey / 50) * 640e0 + 1280e0 as x1, (p_partkey % 50) * 640e0 + 1280e0 as y1 from part"""

TILE_INDEX = """select concat('T', cast(s_suppkey as string)) as tile_id, s_acctbal as balance,
 case when s_suppkey % 2 = 0 then 'ky_dem_index' else 'ky_aerial_index' end as layer,
 concat('http://x/', cast(s_suppkey as string), case when s_suppkey % 3 = 0 then '.tif'
  when s_suppkey % 3 = 1 then '.zip' else '.pdf' end) as url,
 floor(s_suppkey / 10) * 3200e0 as x0, (s_suppkey % 10) * 3200e0 as y0,
 floor(s_suppkey / 10) * 3200e0 + 3200e0 as x1, (s_suppkey % 10) * 3200e0 + 3200e0 as y1 from supplier"""

AOI = """select s_suppkey as aoi_id, s_nationkey % 5 as grp,
 floor(s_suppkey / 10) * 5000e0 as x0, (s_suppkey % 10) * 5000e0 as y0,
 floor(s_suppkey / 10) * 5000e0 + 5000e0 as x1, (s_suppkey % 10) * 5000e0 + 5000e0 as y1 from supplier"""

UNITS = """select c_custkey as gid, c_mktsegment as symbol,
 floor(c_custkey / 40) * 400e0 as x0, (c_custkey % 40) * 400e0 as y0,
 floor(c_custkey / 40) * 400e0 + 400e0 as x1, (c_custkey % 40) * 400e0 + 400e0 as y1 from customer"""

# side of the raster: a tile of 256 pixels holds about 60,000 rows of the table
SIDE = "select 256 * greatest(1, cast(round(sqrt(count(*) / 60000e0)) as bigint)) as n from lineitem"

RASTER = """select band, px, py, max(l_quantity) as v from (
 select l_returnflag as band, l_orderkey % $N as px, l_partkey % $N as py, l_quantity from lineitem) group by band, px, py"""

CLASS_AREA = """select o_custkey as patch, o_orderpriority as class, count(*) as n
 from orders group by o_custkey, o_orderpriority"""

# five labels per order, listed by an array so that neither engine needs a cross join
PRED = """select sid, k, y, score from (
 select o_orderkey as sid, o_custkey as cust, explode(array(0, 1, 2, 3, 4)) as k from orders) o
 lateral view inline(array(struct(
  case when sid % (k + 2) = 0 then 1 else 0 end as y,
  (case when sid % (k + 2) = 0 then $S else 0 end + (cust * (k * 7 + 13) + sid * 31) % (3 * $S)) / (4e0 * $S) as score))) s
 as y, score"""

# a quarter of the number of different scores of a label
STEPS = "select greatest(1, cast(count(*) / 60 as bigint)) as s from orders"

PRED_DUCK = """select o_orderkey as sid, k, case when o_orderkey % (k + 2) = 0 then 1 else 0 end as y,
 (case when o_orderkey % (k + 2) = 0 then $S else 0 end + (o_custkey * (k * 7 + 13) + o_orderkey * 31) % (3 * $S)) / (4e0 * $S) as score
 from orders cross join (select 0 as k union all select 1 union all select 2 union all select 3 union all select 4) ks"""

RUNLOG_DUCK = """select event_type as run, row_number() over (partition by event_type order by ts, event_id) as epoch,
 value as loss from events"""

IMAGE_META = """select concat('img', cast(s_suppkey as string)) as image,
 concat('/data/r', cast(s_suppkey % 4 as string), '/img', cast(s_suppkey as string), '.tif') as path,
 case when s_suppkey % 7 = 3 then 10e0 else 5e0 end as resolution_x, 5e0 as resolution_y,
 256 + cast(s_suppkey % 2 as int) as width, 256 as height,
 0e0 as `left`, 0e0 as bottom, 1280e0 as `right`, 1280e0 as top from supplier"""

CHIPS = """select vec_id as image, label, cast(floor(pos / 8) as int) as py, cast(pos % 8 as int) as px,
 cast(col as double) as v from (select vec_id, label, posexplode(embedding) from embeddings)"""

CHIPS_DUCK = """select vec_id as image, label, cast(floor(pos / 8) as int) as py, cast(pos % 8 as int) as px,
 cast(col as double) as v from (select vec_id, label, unnest(embedding) as col,
 generate_subscripts(embedding, 1) - 1 as pos from embeddings)"""

_SPARK = {
    "patches": (PATCHES, ["part"]),
    "tile_index": (TILE_INDEX, ["supplier"]),
    "aoi": (AOI, ["supplier"]),
    "units": (UNITS, ["customer"]),
    "raster": (RASTER, ["lineitem"]),
    "class_area": (CLASS_AREA, ["orders"]),
    "pred": (PRED, ["orders"]),
    "image_meta": (IMAGE_META, ["supplier"]),
    "chips": (CHIPS, ["embeddings"]),
}
_DUCK = {n: s for n, (s, _) in _SPARK.items()} | {
    "pred": PRED_DUCK,
    "runlog": RUNLOG_DUCK,
    "chips": CHIPS_DUCK,
}

#: Order priorities stand in for classes, market segments for map-unit symbols.
CLASSES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENT_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "MACHINERY": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a DataFrame."""
    if name == "runlog":
        events = table(spark, sf_dir, "events").select(
            F.col("event_type").alias("run"), "ts", "event_id", F.col("value").alias("loss")
        )
        return row_number_by(events, ["ts", "event_id"], "epoch", ["run"]).select("run", "epoch", "loss")
    sql, sources = _SPARK[name]
    if "$N" in sql:
        sql = sql.replace("$N", str(raster_side(spark, sf_dir)))
    if "$S" in sql:
        sql = sql.replace("$S", str(_scalar(spark, sf_dir, STEPS, "orders")))
    return spark.sql(
        sql.replace(f"from {sources[0]}", "from {source}"), source=table(spark, sf_dir, sources[0])
    )


def _scalar(spark: SparkSession, sf_dir: str, sql: str, source: str) -> int:
    return spark.sql(sql.replace(f"from {source}", "from {source}"), source=table(spark, sf_dir, source)).first()[0]


def raster_side(spark: SparkSession, sf_dir: str) -> int:
    """Pixels on a side of the derived raster, from the table's row count."""
    return _scalar(spark, sf_dir, SIDE, "lineitem")


def with_views(names: str, body: str, **extra: str) -> str:
    """DuckDB SQL: ``body`` after the named derived tables and extra expressions."""
    parts = [f"side as materialized ({SIDE})", f"steps as materialized ({STEPS})"]
    parts += [f"{n} as ({_duck(_DUCK[n])})" for n in names.split()]
    parts += [f"{n} as ({s})" for n, s in extra.items()]
    sql = f"with {', '.join(parts)} {body}"
    for mark, value in (("$N", "n from side"), ("$E", "n * 5 from side"), ("$S", "s from steps")):
        sql = sql.replace(mark, f"(select {value})")
    return sql


def _duck(sql: str) -> str:
    return sql.replace("`", '"').replace(" as string)", " as varchar)")
