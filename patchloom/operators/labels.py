"""Class statistics over label and area tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from patchloom.operators.lookup import attach
from patchloom.operators.ordering import BUCKET, offsets, range_buckets, running_sums
from patchloom.session import written


def class_counts(labels: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Patches per class: column sums of presence, as (class, n) rows."""
    sums = labels.agg(*[F.sum(c).cast("long").alias(c) for c in classes])
    return sums.unpivot([], list(classes), "class", "n")


def classes_per_patch(labels: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Number of classes in each patch."""
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return labels.withColumn("n_classes", total.cast("long"))


def class_count_histogram(labels: DataFrame, classes: Sequence[str]) -> DataFrame:
    """How many patches have 1, 2, ... classes."""
    return classes_per_patch(labels, classes).groupBy("n_classes").agg(F.count(F.lit(1)).alias("n"))


def histogram(
    long: DataFrame, bins: int = 10, by: Sequence[str] = ("unit",), value: str = "proportion"
) -> DataFrame:
    """Equal-width histogram per group in percent; the last bin is closed."""
    by = list(by)
    known = long.where(F.col(value).isNotNull())
    ends = known.groupBy(*by).agg(
        F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(F.lit(1)).alias("__total")
    )
    # a constant column gets a unit-wide range around its value
    flat = F.col("__lo") == F.col("__hi")
    lo = F.when(flat, F.col("__lo") - 0.5).otherwise(F.col("__lo"))
    hi = F.when(flat, F.col("__hi") + 0.5).otherwise(F.col("__hi"))
    edges = ends.withColumns({"__lo": lo, "__step": (hi - lo) / bins})
    # the bin is decided by its printed edges lo + i * step, the division only guesses it
    v, guess = F.col(value), F.col("__i")
    low_edge = F.col("__lo") + guess * F.col("__step")
    high_edge = F.col("__lo") + (guess + 1) * F.col("__step")
    place = F.when(v < low_edge, guess - 1).when(v >= high_edge, guess + 1).otherwise(guess)
    counted = (
        attach(known, edges, by, [value])
        .withColumn("__i", F.floor((v - F.col("__lo")) / F.col("__step")))
        .groupBy(*by, (F.least(place, F.lit(bins - 1)) + 1).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("__total").alias("__total"))
    )
    return counted.withColumn("percent", F.col("n") * 100.0 / F.col("__total")).drop("__total")


def value_ranks(
    long: DataFrame, by: Sequence[str], value: str, rows_per_bucket: int | None = None
) -> DataFrame:
    """Distinct values per group with their count ``n`` and cumulative count ``upto``.

    A table of more than one bucket is written to the shared folder, because the
    callers read it several times.
    """
    by = list(by)
    known = long.select(*by, value).where(F.col(value).isNotNull())
    cut = range_buckets(known, by, [value], rows_per_bucket)
    n = F.count(F.lit(1))
    counts = cut.df.groupBy(*by, BUCKET, value).agg(n.alias("n"))
    before = None if cut.single else offsets(cut.df, by, {"upto": n})
    ranks = running_sums(counts, by, value, {"upto": "n"}, before).drop(BUCKET)
    return ranks if cut.single else written(ranks)


def exact_quantiles(
    ranks: DataFrame, totals: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles from ``value_ranks``: aggregates only, no group sort."""
    by = list(by)
    joined = attach(ranks, totals, by, [value])
    aggs = []
    for name, p in probs.items():
        at = (F.col("__total") - 1) * F.lit(p)
        aggs.append(F.min(F.when(F.col("upto") > F.floor(at), F.col(value))).alias(f"__lo_{name}"))
        aggs.append(F.min(F.when(F.col("upto") > F.ceil(at), F.col(value))).alias(f"__hi_{name}"))
    ends = joined.groupBy(*by).agg(F.first("__total").alias("__total"), *aggs)
    out = []
    for name, p in probs.items():
        at = (F.col("__total") - 1) * F.lit(p)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return ends.select(*by, F.col("__total").alias("n"), *out)


def box_stats(
    long: DataFrame,
    by: Sequence[str] = ("unit",),
    value: str = "proportion",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Quartiles and whiskers (farthest points within 1.5 IQR) per group."""
    by = list(by)
    ranks = value_ranks(long, by, value, rows_per_bucket)
    totals = ranks.groupBy(*by).agg(F.sum("n").alias("__total"))
    quart = exact_quantiles(ranks, totals, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low = F.min(F.when(F.col(value) >= F.col("q1") - reach, F.col(value)))
    high = F.max(F.when(F.col(value) <= F.col("q3") + reach, F.col(value)))
    return (
        attach(ranks.select(*by, value), quart, by, [value])
        .groupBy(*by, "n", "q1", "median", "q3")
        .agg(low.alias("whisker_low"), high.alias("whisker_high"))
    )


def split_summary(splits: DataFrame, split: str = "split") -> DataFrame:
    """Size of each split and its truncated percentage."""
    sizes = splits.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # one row per split
    share = F.col("n") * 100.0 / F.sum("n").over(everything)
    return sizes.withColumn("percent", share.cast("int"))


def class_distribution(
    splits: DataFrame,
    labels: DataFrame,
    areas: DataFrame,
    classes: Sequence[str],
    split: str = "split",
    on: str = "patch_id",
) -> tuple[DataFrame, DataFrame]:
    """Per split: class counts as (split, class, n), and areas as (split, unit, proportion)."""
    members = splits.select(on, split).distinct()
    found = members.join(labels, on)
    sums = found.groupBy(split).agg(*[F.sum(c).cast("long").alias(c) for c in classes])
    counts = sums.unpivot([split], list(classes), "class", "n")
    long = members.join(areas, on).unpivot([split, on], list(classes), "unit", "proportion")
    return counts, long


def class_weights(
    labels: DataFrame,
    classes: Sequence[str],
    sqrt: bool = True,
    scale: bool = True,
    scale_first: bool = False,
) -> DataFrame:
    """Inverse class frequency ``n * K / count``, its root, scaled to sum 1."""
    sums = labels.agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).cast("double").alias(c) for c in classes]
    )
    raw = sums.unpivot(["__n"], list(classes), "class", "__sum").select(
        "class", F.try_divide(F.col("__n") * F.lit(float(len(classes))), F.col("__sum")).alias("weight")
    )
    steps = (["scale"] if scale and scale_first else []) + (["sqrt"] if sqrt else [])
    steps += ["scale"] if scale and not scale_first else []
    everything = Window.partitionBy()  # one row per class
    for step in steps:
        w = F.col("weight")
        raw = raw.withColumn("weight", F.sqrt(w) if step == "sqrt" else w / F.sum(w).over(everything))
    return raw


def wide_classes(
    long: DataFrame, classes: Sequence[str], by: str = "patch", name: str = "class", value: str = "n"
) -> DataFrame:
    """Class rows per patch to one column per class, zero where absent."""
    wide = long.groupBy(by).pivot(name, list(classes)).agg(F.sum(value))
    return wide.fillna(0, list(classes))
