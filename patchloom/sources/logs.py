"""Training log text as a table of epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patchloom.operators.ordering import range_buckets, running_extreme_before

HEADER = r"^Epoch (\d+)/(\d+)$"
PHASE = r"^(TRAINING|VALIDATION)\s*-- Loss: ([0-9.]+)\s*\|\s*Accuracy: ([0-9.]+)%\s*\|\s*Time: ([0-9.]+) mins\.$"
BEST = r"^New best model saved with (loss|accuracy) ([0-9.]+)%?\.\.\.$"


def parse_training_log(lines: DataFrame, run: str = "run", pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per (run, epoch) from numbered log lines.

    Lines belong to the last header before them: the header with the largest
    position so far, carried along by a running maximum over position ranges.  A
    header repeated after a restart starts the same epoch again, and its last
    figures count.
    """
    text = F.trim(value)

    def number(pattern: str, group: int, type_: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast(type_)

    head = F.when(
        text.rlike(HEADER),
        F.struct(pos, number(HEADER, 1, "int").alias("epoch"), number(HEADER, 2, "int").alias("epochs")),
    )
    read = lines.select(
        run,
        pos,
        head.alias("__own"),
        F.regexp_extract(text, PHASE, 1).alias("phase"),
        number(PHASE, 2, "double").alias("loss"),
        number(PHASE, 3, "double").alias("accuracy"),
        number(PHASE, 4, "double").alias("minutes"),
        F.regexp_extract(text, BEST, 1).alias("best"),
    )
    cut = range_buckets(read, [run], [pos])
    marked = running_extreme_before(cut, [run], [pos], {"__before": ("max", "__own")})
    current = F.coalesce("__own", "__before")
    marked = marked.withColumns({"epoch": current["epoch"], "epochs": current["epochs"]})

    def figure(phase: str, column: str) -> Column:
        return F.max_by(F.when(F.col("phase") == phase, F.col(column)), F.when(F.col("phase") == phase, F.col(pos)))

    names = {"TRAINING": "train", "VALIDATION": "val"}
    aggs = [
        figure(p, c).alias(f"{short}_{c}")
        for p, short in names.items()
        for c in ("loss", "accuracy", "minutes")
    ]
    marks = [F.bool_or(F.col("best") == b).alias(f"saved_best_{b}") for b in ("loss", "accuracy")]
    return marked.where(F.col("epoch").isNotNull()).groupBy(run, "epoch", "epochs").agg(*aggs, *marks)


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """Epoch table of every matching log file; ``run`` is its path."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("run"), F.posexplode(F.split("value", "\n")).alias("pos", "value")
    )
    return parse_training_log(files)
