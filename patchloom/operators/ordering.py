"""Ranks and running totals whose groups may be far larger than one task.

A plain window runs each partition key in one task.  Here rows are first cut
into consecutive ranges ("buckets") of the wanted order, a small table of
per-bucket totals carries the offsets, and windows run per bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, isqrt, log
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType, TimestampType

from patchloom.operators.lookup import attach

#: Rows of a bucket; many small ones spread evenly over tasks.
ROWS_PER_BUCKET = 50_000
#: Upper bound on buckets over all groups, so the offset table stays small.
MAX_BUCKETS = 16_384
#: Most totals that one window task adds up; more buckets are added up in levels.
FAN_OUT = 16_384
#: Draws of one first-column value beyond which it is split by the whole key.
MAX_DRAWN = 4
#: Hex digits of the hash by which a sample narrows down its cut at a time (16**3 counts).
DRAW_DIGITS = 3

BUCKET = "__bucket"


class Cut(NamedTuple):
    """Rows with a bucket number below ``buckets``; ``single`` when all rows share bucket 0."""

    df: DataFrame
    single: bool
    buckets: int = MAX_BUCKETS


def hash_key(seed: int | str, *cols: str) -> Column:
    """``md5('<seed>:<col>:...')`` as a repeatable random sort key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def range_buckets(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    rows_per_bucket: int | None = None,
) -> Cut:
    """Add a bucket number that grows with ``order`` inside each ``part`` group.

    Splitters are the order keys whose hash falls in a fixed residue class, so
    they are the same in every run and recomputation, copies of one key count
    once, and every group gets buckets in proportion to its distinct keys.
    Small inputs get a single bucket and no extra pass except the row count.
    """
    part, order = list(part), list(order)
    keys = df.select(*part, *order)
    rows = keys.count()
    step = max(rows_per_bucket or ROWS_PER_BUCKET, rows // MAX_BUCKETS, 1)
    if rows <= step:
        return Cut(df.withColumn(BUCKET, F.lit(0)), True)
    drawn = keys.where(F.pmod(F.xxhash64(*part, *order), F.lit(step)) == 0)
    if isinstance(keys.schema[order[0]].dataType, (NumericType, TimestampType)):
        found = _first_values(drawn, order)
        if found is not None:
            return Cut(_number_buckets(df, found, order[0]), False)
    return Cut(_key_buckets(df, drawn, part, order, max(isqrt(rows // step), 4)), False)


def _first_values(drawn: DataFrame, order: Sequence[str]) -> list[float] | None:
    """Splitters from the first sort column alone, about ``MAX_BUCKETS`` numbers.

    None when one value of it was drawn often with different further columns: its
    rows are too many for one bucket and must be split by the whole key.
    """
    value = F.col(order[0]).cast("double")
    keys = drawn.select(value.alias("__s"), *order).distinct()
    found = keys.where(F.col("__s").isNotNull()).groupBy("__s").count().collect()
    if len(order) > 1 and any(r["count"] > MAX_DRAWN for r in found):
        return None
    return sorted(r["__s"] for r in found if abs(r["__s"]) < float("inf"))


def _number_buckets(df: DataFrame, inner: list[float], order: str) -> DataFrame:
    """Buckets of a number: all groups share the splitters, found by binary search."""
    if not inner:
        return df.withColumn(BUCKET, F.lit(0))
    value = F.col(order).cast("double")
    splits = [-float("inf"), *inner, float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="__x", outputCol="__b", handleInvalid="keep")
    # a NULL key sorts first
    return (
        cutter.transform(df.withColumn("__x", value))
        .withColumn(BUCKET, F.when(F.col("__x").isNull(), 0).otherwise(F.col("__b")).cast("int"))
        .drop("__x", "__b")
    )


def _key_buckets(
    df: DataFrame, drawn: DataFrame, part: Sequence[str], order: Sequence[str], chunk: int
) -> DataFrame:
    """Buckets of a composite key: sorted splitters per group, searched in two levels."""
    key = F.struct(*[F.col(c) for c in order])
    splitters = drawn.groupBy(*part).agg(F.array_sort(F.collect_set(key)).alias("__keys"))
    # find the chunk by its first key, then look inside it
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("__keys") - 1) / chunk).cast("int")),
        lambda i: F.slice("__keys", i * chunk + 1, chunk),
    )
    splitters = splitters.select(
        *part,
        chunks.alias("__chunks"),
        F.transform(chunks, lambda c: F.element_at(c, 1)).alias("__heads"),
    )
    low = F.size(F.filter("__heads", lambda h: h <= F.col("__key")))
    inner = F.size(F.filter(F.element_at("__chunks", F.col("__low")), lambda s: s <= F.col("__key")))
    bucket = F.when(F.coalesce(F.col("__low"), F.lit(0)) < 1, F.lit(0)).otherwise(
        (F.col("__low") - 1) * chunk + inner
    )
    keyed = df if part else df.withColumn("__all", F.lit(0))
    on = list(part) or ["__all"]
    lookup = splitters if part else splitters.withColumn("__all", F.lit(0))
    return (
        attach(keyed, lookup, on, order)
        .withColumn("__key", key)
        .withColumn("__low", low)
        .withColumn(BUCKET, bucket.cast("int"))
        .drop("__key", "__low", "__chunks", "__heads", "__all")
    )


def hash_buckets(df: DataFrame, key_col: str, rows_per_bucket: int | None = None) -> Cut:
    """Bucket number from leading hex digits of an md5 column (even by design), as many as the row count asks for."""
    buckets = df.count() / (rows_per_bucket or ROWS_PER_BUCKET)
    digits = ceil(log(buckets, 16)) if buckets > 1 else 0
    if not digits:
        return Cut(df.withColumn(BUCKET, F.lit(0)), True)
    bucket = F.conv(F.substring(key_col, 1, digits), 16, 10).cast("long")
    return Cut(df.withColumn(BUCKET, bucket), False, 16**digits)


def offsets(
    df: DataFrame,
    part: Sequence[str],
    totals: dict[str, Column],
    descending: bool = False,
    buckets: int = MAX_BUCKETS,
) -> DataFrame:
    """Per (part, bucket) sums of everything in earlier buckets, ``__off_<name>``.

    ``buckets`` bounds the bucket numbers. Windows run over at most ``FAN_OUT`` totals.
    """
    per_bucket = df.groupBy(*part, BUCKET).agg(*[c.alias(n) for n, c in totals.items()])
    return _sums_before(per_bucket, list(part), list(totals), descending, buckets)


def _sums_before(
    sums: DataFrame, part: list[str], names: list[str], descending: bool, buckets: int
) -> DataFrame:
    """Sums of earlier buckets of the same parent, and those of earlier parents by the same rule."""
    order = F.col(BUCKET).desc() if descending else F.col(BUCKET)
    top = buckets <= FAN_OUT
    if not top:
        sums = sums.withColumn("__up", F.floor(F.col(BUCKET) / FAN_OUT))
    within = [*part] if top else [*part, "__up"]
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = sums.select(
        *within, BUCKET, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__off_{n}") for n in names]
    )
    if top:
        return found
    parents = sums.groupBy(*within).agg(*[F.sum(n).alias(n) for n in names]).withColumnRenamed("__up", BUCKET)
    above = _sums_before(parents, part, names, descending, ceil(buckets / FAN_OUT)).withColumnsRenamed(
        {BUCKET: "__up", **{f"__off_{n}": f"__above_{n}" for n in names}}
    )
    return found.join(above, within).select(
        *part, BUCKET, *[(F.col(f"__off_{n}") + F.col(f"__above_{n}")).alias(f"__off_{n}") for n in names]
    )


def ranked(
    cut: Cut, part: Sequence[str], order: Sequence[Column | str], spread: Sequence[str], out: str
) -> DataFrame:
    """Row number ``1..n`` of bucketed rows inside ``part`` in ``order``."""
    inside = Window.partitionBy(*part, BUCKET).orderBy(*order)
    local = cut.df.withColumn(out, F.row_number().over(inside).cast("long"))
    if cut.single:
        return local.drop(BUCKET)
    off = offsets(cut.df, part, {"n": F.count(F.lit(1))}, buckets=cut.buckets)
    return (
        attach(local, off, [*part, BUCKET], spread)
        .withColumn(out, F.col("__off_n") + F.col(out))
        .drop("__off_n", BUCKET)
    )


def row_number_by(
    df: DataFrame,
    order: Sequence[str],
    out: str = "rn",
    part: Sequence[str] = (),
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """``row_number() over (partition by part order by order)`` for groups of any size."""
    cut = range_buckets(df, part, order, rows_per_bucket)
    return ranked(cut, part, list(order), list(order), out)


def hash_row_number(
    df: DataFrame, id_col: str, seed: int | str, out: str = "rn", part: Sequence[str] = ()
) -> DataFrame:
    """Row number in the random order ``md5('<seed>:<id>'), id`` inside ``part``."""
    cut = hash_buckets(df.withColumn("__h", hash_key(seed, id_col)), "__h")
    return ranked(cut, part, ["__h", id_col], [id_col], out).drop("__h")


def running_sums(
    df: DataFrame,
    part: Sequence[str],
    order: str,
    sums: dict[str, str],
    before: DataFrame | None,
    descending: bool = False,
) -> DataFrame:
    """Cumulative sums (``{output: input}``) over bucketed rows, current row included.

    ``before`` holds the ``offsets`` of the same outputs, or None for one bucket.
    """
    by = F.col(order).desc() if descending else F.col(order)
    inside = (
        Window.partitionBy(*part, BUCKET).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = df.withColumns({o: F.sum(i).over(inside) for o, i in sums.items()})
    if before is None:
        return local
    joined = attach(local, before, [*part, BUCKET], [order])
    return joined.withColumns({o: F.col(o) + F.col(f"__off_{o}") for o in sums}).drop(
        *[f"__off_{o}" for o in sums]
    )


def running_extreme_before(
    cut: Cut, part: Sequence[str], order: Sequence[str], extremes: dict[str, tuple[str, str]]
) -> DataFrame:
    """Running ``min``/``max`` over all earlier rows: ``{output: (kind, input)}``."""
    fn = {"min": (F.min, F.least), "max": (F.max, F.greatest)}
    inside = Window.partitionBy(*part, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.df.withColumns({o: fn[k][0](i).over(inside) for o, (k, i) in extremes.items()})
    if cut.single:
        return local.drop(BUCKET)
    before = Window.partitionBy(*part).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = cut.df.groupBy(*part, BUCKET).agg(
        *[fn[k][0](i).alias(o) for o, (k, i) in extremes.items()]
    )
    off = per_bucket.select(
        *part, BUCKET, *[fn[k][0](o).over(before).alias(f"__off_{o}") for o, (k, _) in extremes.items()]
    )
    joined = attach(local, off, [*part, BUCKET], order)
    return joined.withColumns(
        {o: fn[k][1](o, f"__off_{o}") for o, (k, _) in extremes.items()}
    ).drop(*[f"__off_{o}" for o in extremes], BUCKET)


def sample_n(df: DataFrame, n: int, seed: int | str, id_col: str, rows_per_bucket: int | None = None) -> DataFrame:
    """``n`` rows without replacement: the first in ``md5('<seed>:<id>'), id`` order.

    Counts by leading digits tell in which range of hashes the cut lies, and the
    same again inside that range until it holds few rows: all lower ones are kept
    by a filter alone and only that range is sorted. Asking for more rows than
    there are raises.
    """
    hashed = df.withColumn("__h", hash_key(seed, id_col))
    before, cut, size = 0, "", None
    while size is None or size > (rows_per_bucket or ROWS_PER_BUCKET) and len(cut) < 32:
        digits = F.substring("__h", 1, len(cut) + DRAW_DIGITS)
        counts = hashed.where(F.col("__h").startswith(cut)).groupBy(digits.alias("d")).count().collect()
        if size is None and n > sum(r["count"] for r in counts):
            raise ValueError(f"sample of {n} from {sum(r['count'] for r in counts)} rows")
        for cut, size in sorted(map(tuple, counts)):
            if before + size >= n:
                break
            before += size
        size = size or 0
    edge = hashed.where(F.col("__h").startswith(cut)).orderBy("__h", id_col).limit(n - before)
    return hashed.where(F.col("__h") < cut).unionByName(edge).drop("__h")


def head_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in a fixed order (a trial subset)."""
    return df.orderBy(*order).limit(n)


def assign_batches(
    df: DataFrame, batch_size: int, id_col: str, seed: int | str | None = None, drop_last: bool = True
) -> DataFrame:
    """Number batches of ``batch_size`` rows; with a seed the rows are shuffled first."""
    if seed is None:
        numbered = row_number_by(df, [id_col], out="__pos")
    else:
        numbered = hash_row_number(df, id_col, seed, out="__pos")
    out = numbered.withColumn("batch", F.floor((F.col("__pos") - 1) / batch_size))
    if drop_last:
        out = out.where(F.col("batch") < df.count() // batch_size)
    return out.drop("__pos")


def top_by(df: DataFrame, part: Sequence[str], score: str, value: str, tie: str, out: str) -> DataFrame:
    """``value`` of the highest ``score`` per group; the lowest ``tie`` wins ties.

    The best score comes first, by hash aggregation, and only its rows go on: a
    single ``max_by`` over a struct would sort every partition.
    """
    best = df.groupBy(*part).agg(F.max(score).alias("__best"))
    ties = attach(df, best, part, [tie], how="inner").where(F.col(score) == F.col("__best"))
    return ties.groupBy(*part).agg(F.min_by(value, tie).alias(out))
