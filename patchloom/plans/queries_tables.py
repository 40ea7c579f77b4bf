"""Queries over class tables, tile indexes, image metadata and drawn sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patchloom.functions.scalar import encode_class, image_name, round_half_even
from patchloom.operators import dataset as D, labels as L, tables as T
from patchloom.operators.ordering import sample_n
from patchloom.plans.fixtures import CLASSES, SEGMENT_CODES, table, view, with_views
from patchloom.plans.queries_metrics import rounded
from patchloom.plans.registry import query

QUOTED = ", ".join(f'"{c}"' for c in CLASSES)
WIDE = "select patch, " + ", ".join(
    f"cast(sum(case when class = '{c}' then n else 0 end) as bigint) as \"{c}\"" for c in CLASSES
) + " from class_area group by patch"
PRESENT = "select patch, " + ", ".join(
    f'case when "{c}" > 0 then 1 else 0 end as "{c}"' for c in CLASSES
) + " from wide"
LONG_SHARES = """select patch, class as unit, n / sum(n) over (partition by patch) as proportion from class_area"""
TOTAL = " + ".join(f'"{c}"' for c in CLASSES)
SHARES = "select patch, " + ", ".join(f'"{c}" / ({TOTAL}) as "{c}"' for c in CLASSES) + " from wide"


def wide(spark, d) -> DataFrame:
    return L.wide_classes(view(spark, d, "class_area"), CLASSES)


def presence(spark, d) -> DataFrame:
    w = wide(spark, d)
    return w.select("patch", *[(F.col(f"`{c}`") > 0).cast("int").alias(c) for c in CLASSES])


def shares(spark, d) -> DataFrame:
    w = wide(spark, d)
    total = sum((F.col(f"`{c}`") for c in CLASSES[1:]), F.col(f"`{CLASSES[0]}`"))
    return w.select("patch", *[F.try_divide(F.col(f"`{c}`"), total).alias(c) for c in CLASSES])


# --- tile index and metadata ------------------------------------------------


@query(
    "select_layers",
    with_views(
        "tile_index",
        """select tile_id, layer, case when contains(lower(layer), 'dem') then 'dem' else 'aerial' end as kind
 from tile_index where contains(lower(layer), 'dem') or contains(lower(layer), 'aerial')""",
    ),
)
def _layers(spark, d):
    return T.select_layers(view(spark, d, "tile_index")).select("tile_id", "layer", "kind")


ROUTE = "case right(url, 3) when 'tif' then 'tif' when 'zip' then 'zip' else 'reject' end as route"


@query(
    "download_plan",
    with_views(
        "tile_index",
        f"select tile_id, url, {ROUTE} from tile_index t where not exists (select 1 from here h where h.tile_id = t.tile_id)",
        here="select tile_id from tile_index where balance < 0",
    ),
)
def _plan(spark, d):
    index = view(spark, d, "tile_index")
    here = index.where("balance < 0").select("tile_id")
    return T.download_plan(index, here).select("tile_id", "url", "route")


@query(
    "download_plan_substring",
    with_views(
        "tile_index",
        f"select tile_id, url, {ROUTE} from tile_index t where not exists (select 1 from here h where contains(h.tile_id, t.tile_id))",
        here="select tile_id from tile_index where balance < 0",
    ),
)
def _plan_sub(spark, d):
    index = view(spark, d, "tile_index")
    here = index.where("balance < 0").select("tile_id")
    return T.download_plan(index, here, substring=True).select("tile_id", "url", "route")


@query(
    "image_name",
    with_views("image_meta", "select path, regexp_replace(regexp_replace(path, '.*/', ''), '\\.[^.]*$', '') as image from image_meta"),
)
def _name(spark, d):
    return view(spark, d, "image_meta").select("path", image_name("path").alias("image"))


@query(
    "check_alignment",
    with_views(
        "image_meta",
        """select m.image, m.resolution_x, m.width, (m.resolution_x = t.resolution_x and m.resolution_y = t.resolution_y
 and m.width = t.width and m.height = t.height and m."left" = t."left" and m.bottom = t.bottom
 and m."right" = t."right" and m.top = t.top) as aligned from image_meta m, (select * from image_meta where image = 'img0') t""",
    ),
)
def _align(spark, d):
    out = T.check_alignment(view(spark, d, "image_meta"), "img0")
    return out.select("image", "resolution_x", "width", "aligned")


@query(
    "encode_class",
    with_views(
        "units",
        "select gid, case symbol " + " ".join(f"when '{s}' then {c}" for s, c in SEGMENT_CODES.items())
        + " end as code from units",
    ),
)
def _encode(spark, d):
    return view(spark, d, "units").select("gid", encode_class("symbol", SEGMENT_CODES).alias("code"))


# --- label and area tables --------------------------------------------------


@query("wide_classes", with_views("class_area", f"select * from wide", wide=WIDE))
def _wide(spark, d):
    return wide(spark, d)


@query(
    "filter_ids",
    with_views("class_area", "select w.* from wide w where patch in (select c_custkey from customer where c_acctbal > 0)", wide=WIDE),
)
def _filter(spark, d):
    ids = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("patch"))
    return T.filter_ids(wide(spark, d), ids, "patch")


@query(
    "exclude_ids",
    with_views("class_area", "select w.* from wide w where patch not in (select c_custkey from customer where c_acctbal > 0)", wide=WIDE),
)
def _exclude(spark, d):
    ids = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("patch"))
    return T.exclude_ids(wide(spark, d), ids, "patch")


@query(
    "attach_labels",
    with_views(
        "class_area",
        "select o_orderkey as sid, o_custkey as patch, p.* exclude (patch) from orders left join p on o_custkey = patch",
        wide=WIDE,
        p=PRESENT,
    ),
)
def _attach(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("sid"), F.col("o_custkey").alias("patch"))
    return T.attach_labels(ids, presence(spark, d), "patch")


@query(
    "class_counts",
    with_views("class_area", "select class, count(*) as n from class_area group by class"),
)
def _counts(spark, d):
    return L.class_counts(presence(spark, d), CLASSES)


@query(
    "classes_per_patch",
    with_views("class_area", "select patch, count(*) as n_classes from class_area group by patch"),
)
def _per_patch(spark, d):
    return L.classes_per_patch(presence(spark, d), CLASSES).select("patch", "n_classes")


@query(
    "class_count_histogram",
    with_views(
        "class_area",
        "select n_classes, count(*) as n from (select count(*) as n_classes from class_area group by patch) group by n_classes",
    ),
)
def _hist_counts(spark, d):
    return L.class_count_histogram(presence(spark, d), CLASSES)


@query(
    "area_histogram",
    with_views(
        "class_area",
        """select unit, bin, count(*) as n, round(count(*) * 100e0 / any_value(t), 6) as percent from (
 select unit, len(list_filter(range(0, 10), lambda i: proportion >= lo + i * ((hi - lo) / 10))) as bin, t from (
  select *, min(proportion) over (partition by unit) as lo, max(proportion) over (partition by unit) as hi,
   count(*) over (partition by unit) as t from m)) group by unit, bin""",
        wide=WIDE,
        s=SHARES,
        m=f"unpivot s on {QUOTED} into name unit value proportion",
    ),
)
def _area_hist(spark, d):
    long = T.to_long(shares(spark, d), ["patch"])
    return rounded(L.histogram(long), 6, "percent")


@query(
    "box_stats",
    with_views(
        "class_area",
        """select unit, any_value(n) as n, round(any_value(q1), 6) as q1, round(any_value(med), 6) as median,
 round(any_value(q3), 6) as q3, round(min(case when proportion >= q1 - 1.5 * (q3 - q1) then proportion end), 6) as whisker_low,
 round(max(case when proportion <= q3 + 1.5 * (q3 - q1) then proportion end), 6) as whisker_high from m join q using (unit) group by unit""",
        wide=WIDE,
        s=SHARES,
        m=f"unpivot s on {QUOTED} into name unit value proportion",
        q="""select unit, count(*) as n, quantile_cont(proportion, 0.25) as q1, quantile_cont(proportion, 0.5) as med,
 quantile_cont(proportion, 0.75) as q3 from m group by unit""",
    ),
)
def _box(spark, d):
    out = L.box_stats(T.to_long(shares(spark, d), ["patch"]))
    return rounded(out, 6, "q1", "median", "q3", "whisker_low", "whisker_high")


@query(
    "to_long",
    with_views(
        "class_area",
        "select patch, unit, round(proportion, 6) as proportion from m",
        wide=WIDE,
        s=SHARES,
        m=f"unpivot s on {QUOTED} into name unit value proportion",
    ),
)
def _long(spark, d):
    return rounded(T.to_long(shares(spark, d), ["patch"]), 6, "proportion")


@query(
    "concat_areas",
    """select 'suppliers' as area, s_name as name, s_acctbal as balance, null as segment from supplier
 union all select 'customers', c_name, c_acctbal, c_mktsegment from customer""",
)
def _concat(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_name as name", "s_acctbal as balance")
    c = table(spark, d, "customer").selectExpr("c_name as name", "c_acctbal as balance", "c_mktsegment as segment")
    return T.concat_areas({"suppliers": s, "customers": c})


@query(
    "append_ids",
    "select o_custkey as patch from orders union all select c_custkey from customer where c_acctbal > 0",
)
def _append(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("patch"))
    more = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("patch"))
    return T.append_ids(ids, more)


def _weights_sql(body: str) -> str:
    return with_views(
        "class_area",
        body,
        w=f"""select class, (select count(distinct patch) from class_area) * {len(CLASSES)}e0 / count(*) as w
 from class_area group by class""",
    )


@query(
    "class_weights",
    _weights_sql("select class, round(sqrt(w) / sum(sqrt(w)) over (), 6) as weight from w"),
)
def _weights(spark, d):
    return rounded(L.class_weights(presence(spark, d), CLASSES), 6, "weight")


@query(
    "class_weights_scale_first",
    _weights_sql("select class, round(sqrt(w / sum(w) over ()), 6) as weight from w"),
)
def _weights_first(spark, d):
    return rounded(L.class_weights(presence(spark, d), CLASSES, scale_first=True), 6, "weight")


SPLIT = """select c_custkey as patch, case when c_acctbal < 0 then 'test' when c_acctbal < 2000 then 'val' else 'train' end
 as split from customer"""


def splits(spark, d) -> DataFrame:
    return table(spark, d, "customer").selectExpr(
        "c_custkey as patch",
        "case when c_acctbal < 0 then 'test' when c_acctbal < 2000 then 'val' else 'train' end as split",
    )


@query(
    "class_distribution_counts",
    with_views(
        "class_area",
        "select split, class, count(*) as n from class_area join sp using (patch) group by split, class",
        sp=SPLIT,
    ),
)
def _dist_counts(spark, d):
    counts, _ = L.class_distribution(splits(spark, d), presence(spark, d), shares(spark, d), CLASSES, on="patch")
    return counts


@query(
    "class_distribution_areas",
    with_views(
        "class_area",
        "select split, patch, unit, round(proportion, 6) as proportion from m join sp using (patch)",
        wide=WIDE,
        s=SHARES,
        m=f"unpivot s on {QUOTED} into name unit value proportion",
        sp=SPLIT,
    ),
)
def _dist_areas(spark, d):
    _, areas = L.class_distribution(splits(spark, d), presence(spark, d), shares(spark, d), CLASSES, on="patch")
    return rounded(areas, 6, "proportion")


@query(
    "split_summary",
    f"""select split, count(*) as n, cast(trunc(count(*) * 100 / sum(count(*)) over ()) as int) as percent
 from ({SPLIT}) group by split""",
)
def _summary(spark, d):
    return L.split_summary(splits(spark, d))


@query(
    "round_half_even",
    "select p_partkey, round_even(cast(p_retailprice / 8 as decimal(18, 4)), 2)::double as price from part",
)
def _bround(spark, d):
    price = round_half_even((F.col("p_retailprice") / 8).cast("decimal(18,4)"), 2).cast("double")
    return table(spark, d, "part").select("p_partkey", price.alias("price"))


# --- draws -------------------------------------------------------------------


@query(
    "sample_n",
    """select o_orderkey as sid from orders
 order by md5(concat('111:', cast(o_orderkey as varchar))), o_orderkey limit 1000""",
)
def _sample(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("sid"))
    return sample_n(ids, 1000, 111, "sid")


RARE = ["2-HIGH", "4-NOT SPECIFIED"]
TARGET = "all"


@query(
    "oversample",
    with_views(
        "class_area",
        """select patch, cast(null as varchar) as source from ids union all
 select h.patch, d.class from dr d join h on h.class = d.class and h.rn = d.rn""",
        ids="select c_custkey as patch from customer where c_acctbal > 0",
        lab="select patch, class from class_area where patch in (select patch from ids)",
        h=f"""select patch, class, row_number() over (partition by class
 order by md5(concat('111:', cast(patch as varchar))), patch) as rn from lab where class in ('2-HIGH', '4-NOT SPECIFIED')""",
        sz="select class, count(*) as c, (select count(distinct patch) * 2 from lab) as t from h group by class",
        dr="""select class, cast('0x' || substr(md5(concat('111:', class, ':', cast(j as varchar))), 1, 12) as bigint) % c + 1 as rn
 from (select class, c, unnest(range(1, t - c + 1)) as j from sz)""",
    ),
)
def _oversample(spark, d):
    ids = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("patch"))
    # the target column counts every labelled patch twice, so all classes are below it
    labels = presence(spark, d).withColumn(TARGET, F.lit(2))
    return D.oversample(ids, labels, RARE, TARGET, 111, "patch").select("patch", "source")


# --- normalisation -----------------------------------------------------------


@query(
    "norm_params",
    with_views(
        "raster",
        """select 'rn' as modality, [round((select m from s where path = 'R'), 6), round((select m from s where path = 'N'), 6)] as means,
 [round((select d from s where path = 'R'), 6), round((select d from s where path = 'N'), 6)] as stds
 union all select 'a', [round((select m from s where path = 'A'), 6)], [round((select d from s where path = 'A'), 6)]""",
        s="select band as path, avg(v) as m, stddev_pop(v) as d from raster group by band",
    ),
)
def _norm(spark, d):
    from patchloom.operators.raster import channel_stats

    stats = channel_stats(view(spark, d, "raster"), ["band"]).withColumnRenamed("band", "path")
    out = T.norm_params(rounded(stats, 6, "mean", "std"), {"rn": ["R", "N"], "a": ["A"]})
    return out
