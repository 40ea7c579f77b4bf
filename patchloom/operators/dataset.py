"""Drawing patch sets and assembling multimodal samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.operators.lookup import attach, salted_join
from patchloom.operators.ordering import hash_key, hash_row_number, sample_n
from patchloom.operators.spatial import spatial_join
from patchloom.session import local_table, written


def independent_split(
    patches: DataFrame, n: int, seed: int = 111, id_col: str = "patch_id", cell: float = 1280.0
) -> tuple[DataFrame, DataFrame]:
    """Draw ``n`` patches; the rest without every patch that overlaps a drawn one.

    The draw is written once: the anti join, the spatial join and the caller all read it.
    """
    selected = written(sample_n(patches, n, seed, id_col))
    others = patches.join(selected.select(id_col), id_col, "left_anti")
    remaining = spatial_join(others, selected, "overlaps", "left_anti", cell, id_col)
    return selected, remaining.select(*patches.columns)


def train_val_test(
    patches: DataFrame,
    n_test: int,
    n_val: int,
    seed: int = 111,
    id_col: str = "patch_id",
    cell: float = 1280.0,
) -> DataFrame:
    """One table with a ``split`` column: test from all, then val, the rest is train.

    What is left after the test draw is written to the shared folder, because
    the validation draw reads it several times.
    """
    test, rest = independent_split(patches, n_test, seed, id_col, cell)
    rest = written(rest)
    val, train = independent_split(rest, n_val, seed, id_col, cell)
    parts = [d.withColumn("split", F.lit(s)) for s, d in (("test", test), ("val", val), ("train", train))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def draw_index(seed: int | str, size: Column, *cols: str) -> Column:
    """Repeatable draw ``1..size`` from 48 bits of ``md5('<seed>:<cols>')``."""
    number = F.conv(F.substring(hash_key(seed, *cols), 1, 12), 16, 10).cast("long")
    return number % size + 1


def oversample(
    ids: DataFrame,
    labels: DataFrame,
    rare: Sequence[str],
    target: str,
    seed: int = 111,
    on: str = "patch_id",
) -> DataFrame:
    """Ids plus, per rare class, draws with replacement up to the target class count.

    The draws of a class come from the listed patches that have it.  A class
    that is already larger than the target raises.  The result has the columns
    ``(patch_id, source, sample)``: ``source`` is NULL for original rows, else the
    class, and ``sample`` tells the copies of a patch apart, as ``assemble`` and
    ``augment`` need it (``<id>`` or ``<id>:<class>:<number of the draw>``).
    """
    listed = labels.join(ids.select(on).distinct(), on, "left_semi")
    have = F.explode(
        F.filter(
            F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in rare]), lambda c: c.isNotNull()
        )
    )
    holders = listed.select(on, have.alias("source"))
    # one row: the target count and the number of holders of every rare class
    sizes = listed.agg(
        F.sum(target).cast("long").alias("__target"),
        *[F.count_if(F.col(c) > 0).alias(f"__n_{c}") for c in rare],
    ).first()
    wanted = {c: int((sizes["__target"] or 0) - sizes[f"__n_{c}"]) for c in rare}
    for c, m in wanted.items():
        if m < 0:
            raise ValueError(f"class {c} is larger than {target} by {-m}")
        if m > 0 and not sizes[f"__n_{c}"]:
            raise ValueError(f"no patch has class {c}")
    spark = ids.sparkSession
    numbered = hash_row_number(holders, on, seed, "__rn", ["source"])
    picks: DataFrame | None = None
    for c, m in wanted.items():
        draws = spark.range(1, m + 1).select(F.lit(c).alias("source"), F.col("id").alias("__j"))
        index = draw_index(seed, F.lit(sizes[f"__n_{c}"]), "source", "__j")
        one = draws.select("source", index.alias("__rn"), "__j")
        picks = one if picks is None else picks.unionByName(one)
    own = F.col(on).cast("string")
    out = ids.select(on, F.lit(None).cast("string").alias("source"), own.alias("sample"))
    if picks is None:
        return out
    copy = F.concat_ws(":", own, "source", F.col("__j").cast("string")).alias("sample")
    return out.unionByName(picks.join(numbered, ["source", "__rn"]).select(on, "source", copy))


# --- pixels of samples ------------------------------------------------------


def normalise(pixels: DataFrame, stats: DataFrame, on: Sequence[str] = ("image",)) -> DataFrame:
    """``(v - mean) / std`` by channel; channels without parameters pass through."""
    joined = attach(pixels, stats.select(*on, "mean", "std"), on, ["px", "py"])
    scaled = F.try_divide(F.col("v") - F.col("mean"), F.col("std"))
    known = F.col("mean").isNotNull() & F.col("std").isNotNull()
    return joined.withColumn("v", F.when(known, scaled).otherwise(F.col("v"))).drop("mean", "std")


def minmax_scale(chips: DataFrame, by: Sequence[str] = ("image",)) -> DataFrame:
    """Scale every image to 0..1; a constant image becomes NULL."""
    ends = chips.groupBy(*by).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    scaled = F.try_divide(F.col("v") - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    return attach(chips, ends, by, ["px", "py"]).withColumn("v", scaled).drop("__lo", "__hi")


def draws(seed: int | str, sample: str) -> dict[str, Column]:
    """Per-sample augmentation draws: two flips and a number of quarter turns.

    They are the first three hex digits of ``md5('<seed>:<sample>')``.
    """
    h = hash_key(seed, sample)

    def digit(i: int) -> Column:
        return F.conv(F.substring(h, i, 1), 16, 10).cast("int")

    return {"hflip": digit(1) >= 8, "vflip": digit(2) >= 8, "turns": digit(3) % 4}


def augment(chips: DataFrame, seed: int | str, size: int, sample: str = "sample") -> DataFrame:
    """Flips and a counter-clockwise quarter-turn rotation of square chips.

    The draws depend on the sample alone, so all its modalities move together.
    """
    d = draws(seed, sample)
    last = size - 1
    flipped = chips.withColumns(
        {
            "px": F.when(d["hflip"], last - F.col("px")).otherwise(F.col("px")),
            "py": F.when(d["vflip"], last - F.col("py")).otherwise(F.col("py")),
        }
    )
    x, y, t = F.col("px"), F.col("py"), d["turns"]
    return flipped.withColumns(
        {
            "px": F.when(t == 0, x).when(t == 1, y).when(t == 2, last - x).otherwise(last - y),
            "py": F.when(t == 0, y).when(t == 1, last - x).when(t == 2, last - y).otherwise(x),
        }
    )


def stack_channels(
    pixels: DataFrame,
    modalities: Mapping[str, Sequence[str]],
    by: Sequence[str] = ("patch_id",),
    channel: str = "image",
) -> DataFrame:
    """Dense ``[C, H, W]`` arrays per sample and modality, channels in declared order.

    A group is one chip of fixed size: its pixels are gathered once, sorted by
    channel, row and column, and cut into rows.  A chip with missing pixels
    raises.
    """
    spark = pixels.sparkSession
    rows = [(c, m, i, len(cs)) for m, cs in modalities.items() for i, c in enumerate(cs)]
    order = local_table(spark, rows, f"{channel} string, modality string, __c int, __n int")
    chips = (
        pixels.join(F.broadcast(order), channel)
        .groupBy(*by, "modality", "__n")
        .agg(
            F.array_sort(F.collect_list(F.struct("__c", "py", "px", "v"))).alias("__a"),
            (F.max("px") + 1).cast("int").alias("__w"),
            (F.max("py") + 1).cast("int").alias("__h"),
        )
    )
    w, h, n = F.col("__w"), F.col("__h"), F.col("__n")

    def line(c: Column, y: Column) -> Column:
        return F.transform(F.slice("__a", (c * h + y) * w + 1, w), lambda p: p["v"])

    channels = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda c: F.transform(F.sequence(F.lit(0), h - 1), lambda y: line(c, y)),
    )
    missing = F.raise_error(F.lit("a chip has missing or repeated pixels")).cast("array<array<array<double>>>")
    return chips.select(*by, "modality", F.when(F.size("__a") == n * h * w, channels).otherwise(missing).alias("channels"))


def _flip_rows(plane: Column) -> Column:
    return F.transform(plane, lambda r: F.reverse(r))


def _quarter_turn(plane: Column, size: Column) -> Column:
    # row i of the result is column (size - 1 - i) of the input
    return F.transform(
        F.sequence(F.lit(0), size - 1), lambda i: F.transform(plane, lambda r: F.get(r, size - 1 - i))
    )


def augment_stack(samples: DataFrame, seed: int | str, sample: str = "sample") -> DataFrame:
    """``augment`` on dense ``channels`` arrays."""
    d = draws(seed, sample)
    size = F.size(F.get(F.col("channels"), F.lit(0)))

    def move(plane: Column) -> Column:
        p = F.when(d["hflip"], _flip_rows(plane)).otherwise(plane)
        return F.when(d["vflip"], F.reverse(p)).otherwise(p)

    def turn(plane: Column) -> Column:
        return (
            F.when(d["turns"] == 0, plane)
            .when(d["turns"] == 1, _quarter_turn(plane, size))
            .when(d["turns"] == 2, F.reverse(_flip_rows(plane)))
            .otherwise(F.reverse(_flip_rows(_quarter_turn(plane, size))))
        )

    moved = samples.withColumn("channels", F.transform("channels", move))
    return moved.withColumn("channels", F.transform("channels", turn))


def assemble(
    ids: DataFrame,
    pixels: DataFrame,
    modalities: Mapping[str, Sequence[str]],
    stats: DataFrame | None = None,
    labels: DataFrame | None = None,
    augment_seed: int | str | None = None,
    on: str = "patch_id",
) -> DataFrame:
    """Samples as stacked, normalised and augmented arrays with their label vector.

    Chips are stacked once per patch and then joined to the id list, so an
    oversampled patch costs a copy of its arrays and not of its pixels.  Copies
    of one patch get separate draws through ``sample`` when ``ids`` has it.
    """
    wanted = pixels.join(ids.select(on).distinct(), on, "left_semi")
    if stats is not None:
        wanted = normalise(wanted, stats)
    stacked = stack_channels(wanted, modalities, [on])
    if "sample" not in ids.columns:
        ids = ids.withColumn("sample", F.col(on))
    # a rare patch may be drawn very often, so its copies are spread over several tasks
    samples = salted_join(ids, stacked, [on], ["sample"], "inner")
    if augment_seed is not None:
        samples = augment_stack(samples, augment_seed)
    if labels is not None:
        samples = samples.join(labels, on, "left")
    return samples


def modality_report(samples: DataFrame) -> DataFrame:
    """Per modality: number of chips, shape, smallest and largest value."""
    first = F.get(F.col("channels"), F.lit(0))
    values = F.flatten(F.flatten("channels"))
    per_chip = samples.select(
        "modality",
        F.size("channels").alias("c"),
        F.size(first).alias("h"),
        F.size(F.get(first, F.lit(0))).alias("w"),
        F.array_min(values).alias("lo"),
        F.array_max(values).alias("hi"),
    )
    return per_chip.groupBy("modality", "c", "h", "w").agg(
        F.count(F.lit(1)).alias("chips"), F.min("lo").alias("min"), F.max("hi").alias("max")
    )
