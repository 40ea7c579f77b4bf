"""Sinks: reports, patch pixels, conditional and in-place writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from patchloom.session import file_system, hadoop_path


def write_report(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header and without an index column."""
    df.write.mode(mode).csv(path, header=True)


def write_once(df: DataFrame, path: str) -> None:
    """Write parquet only when the target does not exist yet."""
    df.write.mode("ignore").parquet(path)


def write_patches(df: DataFrame, path: str, buckets: int = 64, mode: str = "error") -> None:
    """Patch pixels by image and hash bucket of the patch id.

    One file per patch would mean millions of small files; here a patch is found
    through its bucket, and ``patch_name`` keeps the ``<patch_id>_<image>`` name.
    """
    bucket = F.pmod(F.xxhash64("patch_id"), F.lit(buckets)).cast("int")
    named = df.withColumn("patch_bucket", bucket).withColumn(
        "patch_name", F.concat_ws("_", "patch_id", "image")
    )
    # rebalancing splits an image and bucket that holds too much over several tasks
    spread = named.hint("rebalance", F.col("image"), F.col("patch_bucket"))
    spread.sortWithinPartitions("image", "patch_bucket", "patch_id").write.mode(mode).partitionBy(
        "image", "patch_bucket"
    ).parquet(path)


def overwrite_in_place(df: DataFrame, path: str) -> None:
    """Replace the table at ``path`` with ``df``, which may be computed from it.

    The result is written beside the target, which is only renamed away once the
    new table is complete; a failure before that leaves the old one as it was.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    target, fresh, old = (hadoop_path(spark, path.rstrip("/") + end) for end in ("", f".new-{mark}", f".old-{mark}"))
    files = file_system(spark, target)
    try:
        df.write.parquet(fresh.toString())
    except Exception:
        files.delete(fresh, True)
        raise
    if files.exists(target) and not files.rename(target, old):
        raise OSError(f"cannot move {path} away")
    if not files.rename(fresh, target):
        if files.exists(old):
            files.rename(old, target)
        raise OSError(f"cannot move the new table to {path}")
    files.delete(old, True)
