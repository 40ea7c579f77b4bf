"""Table operators: membership, layers, unions, reshaping, alignment, downloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.operators.lookup import attach
from patchloom.session import local_table

# Metadata columns that must agree for images to be aligned.
ALIGNMENT_COLUMNS = (
    "resolution_x",
    "resolution_y",
    "width",
    "height",
    "left",
    "bottom",
    "right",
    "top",
)


def filter_ids(df: DataFrame, ids: DataFrame, on: str = "patch_id") -> DataFrame:
    """Rows whose id is in the list."""
    return df.join(ids.select(on).distinct(), on, "left_semi")


def exclude_ids(df: DataFrame, ids: DataFrame, on: str = "patch_id") -> DataFrame:
    """Rows whose id is not in the list; a NULL id in the list excludes nothing."""
    return df.join(ids.select(on).distinct(), on, "left_anti")


def select_layers(
    df: DataFrame,
    kinds: Sequence[str] = ("dem", "aerial"),
    layer: str = "layer",
    first_only: bool = False,
) -> DataFrame:
    """Keep layers whose lower-cased name contains a kind; the first match names it.

    With ``first_only`` one layer per kind is kept, the first by name.
    """
    kind: Column | None = None
    for k in kinds:
        hit = F.lower(layer).contains(k)
        kind = F.when(hit, F.lit(k)) if kind is None else kind.when(hit, F.lit(k))
    found = df.withColumn("kind", kind).where(F.col("kind").isNotNull())
    if not first_only:
        return found
    first = found.groupBy("kind").agg(F.min(layer).alias(layer))  # one row per kind
    return found.join(F.broadcast(first), ["kind", layer], "left_semi")


def download_plan(
    index: DataFrame,
    present: DataFrame,
    id_col: str = "tile_id",
    url_col: str = "url",
    substring: bool = False,
) -> DataFrame:
    """Tiles not yet present, routed by the last three characters of the url.

    ``present`` holds file names (without extension) in ``id_col``.  With
    ``substring`` a tile also counts as present when its id is a part of a name;
    candidates then come from an equi-join on the parts of the names that are as
    long as some id.
    """
    if substring:
        # no part of another length than an id's can match
        lengths = [r[0] for r in index.select(F.length(id_col)).distinct().collect() if r[0]]
        name = F.col("__name")

        def of_length(n):
            starts = F.sequence(F.lit(1), F.length(name) - n + 1)
            return F.when(F.length(name) >= n, F.transform(starts, lambda i: F.substring(name, i, F.lit(n))))

        none = F.array().cast("array<string>")
        found = F.flatten(F.array(none, *[F.coalesce(of_length(n), none) for n in sorted(lengths)]))
        parts = present.select(F.col(id_col).alias("__name")).select(F.explode(found).alias(id_col))
        missing = index.join(parts.distinct(), id_col, "left_anti")
    else:
        missing = index.join(present.select(id_col).distinct(), id_col, "left_anti")
    ext = F.right(F.col(url_col), F.lit(3))
    route = F.when(ext == "tif", "tif").when(ext == "zip", "zip").otherwise("reject")
    return missing.withColumn("route", route)


def to_long(
    df: DataFrame,
    ids: Sequence[str] = ("patch_id",),
    name: str = "unit",
    value: str = "proportion",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Wide class columns to (unit, proportion) rows."""
    columns = list(columns or [c for c in df.columns if c not in ids])
    return df.unpivot(list(ids), columns, name, value)


def concat_areas(named: Mapping[str, DataFrame], column: str = "area") -> DataFrame:
    """Union tables of several areas by column name; missing columns are NULL."""
    out: DataFrame | None = None
    for label, df in named.items():
        df = df.withColumn(column, F.lit(label))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables to concatenate")
    return out


def append_ids(ids: DataFrame, extra: DataFrame) -> DataFrame:
    """Append oversampled ids; duplicates stay."""
    return ids.unionByName(extra)


def attach_labels(ids: DataFrame, labels: DataFrame, on: str = "patch_id") -> DataFrame:
    """Left merge of labels on the id; duplicate ids stay, unknown ids get NULLs."""
    return ids.join(labels, on, "left")


def check_alignment(
    meta: DataFrame,
    target: str,
    image: str = "image",
    columns: Sequence[str] = ALIGNMENT_COLUMNS,
) -> DataFrame:
    """Flag images that equal the target image in every alignment column.

    Image names must be unique: a repeated name raises when the result is
    computed, and so does a missing target.
    """
    reference = meta.where(F.col(image) == target).agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(f"__t_{c}") for c in columns]
    )
    repeated = meta.groupBy(image).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"image name {repeated[0][image]} occurs more than once")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__t_{c}"))
    missing = F.raise_error(F.lit(f"no image named {target}")).cast("boolean")
    return (
        attach(meta, reference, [], [image])
        .withColumn("aligned", F.when(F.col("__n") == 1, same).otherwise(missing))
        .drop("__n", *[f"__t_{c}" for c in columns])
    )


def norm_params(stats: DataFrame, modalities: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per modality the channel means and deviations in declared order.

    Every channel must match exactly one row of the statistics table.
    """
    spark = stats.sparkSession
    rows = [(m, i, c) for m, channels in modalities.items() for i, c in enumerate(channels)]
    wanted = local_table(spark, rows, "modality string, pos int, path string")
    matched = (
        stats.join(F.broadcast(wanted.select("path").distinct()), "path", "left_semi")
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("__n"), F.first("mean").alias("mean"), F.first("std").alias("std"))
    )
    found = F.broadcast(wanted).join(matched, "path", "left")
    bad = F.raise_error(F.concat(F.lit("not exactly one statistics row for "), F.col("path")))
    checked = found.withColumn(
        "mean", F.when(F.col("__n") == 1, F.col("mean")).otherwise(bad.cast("double"))
    )
    entry = F.array_sort(F.collect_list(F.struct("pos", "mean", "std")))
    return checked.groupBy("modality").agg(entry.alias("__e")).select(
        "modality",
        F.transform("__e", lambda e: e["mean"]).alias("means"),
        F.transform("__e", lambda e: e["std"]).alias("stds"),
    )
