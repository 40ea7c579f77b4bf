"""Best-so-far over training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.operators.lookup import attach
from patchloom.operators.ordering import range_buckets, running_extreme_before


def running_best(
    log: DataFrame, run: str = "run", epoch: str = "epoch", rows_per_bucket: int | None = None
) -> DataFrame:
    """Flag rows that beat everything before them in their run.

    ``new_best`` compares ``loss`` (lower is better, strictly); when the log has
    an ``accuracy`` column ``new_best_accuracy`` compares that (higher is better,
    from a start of zero).  Columns ``start_loss`` and ``start_accuracy``, if
    present, hold the best of earlier records that are not in the table.
    """
    has_accuracy = "accuracy" in log.columns
    wanted = {"__loss": ("min", "loss")} | ({"__acc": ("max", "accuracy")} if has_accuracy else {})
    cut = range_buckets(log, [run], [epoch], rows_per_bucket)
    out = running_extreme_before(cut, [run], [epoch], wanted)

    def start(name: str) -> Column:
        return F.col(name) if name in log.columns else F.lit(None).cast("double")

    before = F.least("__loss", start("start_loss"))
    out = out.withColumn("new_best", before.isNull() | (F.col("loss") < before))
    if has_accuracy:
        before = F.coalesce(F.greatest("__acc", start("start_accuracy")), F.lit(0.0))
        out = out.withColumn("new_best_accuracy", F.col("accuracy") > before)
    return out.drop("__loss", "__acc", "start_loss", "start_accuracy")


def best_epochs(log: DataFrame, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """The last new best per run, which is the first epoch with the extreme value."""
    goals = {"loss": F.min} | ({"accuracy": F.max} if "accuracy" in log.columns else {})
    ends = log.groupBy(run).agg(*[fn(c).alias(f"best_{c}") for c, fn in goals.items()])
    reached = attach(log, ends, [run], [epoch], how="inner")
    names = {"loss": "best_epoch", "accuracy": "best_accuracy_epoch"}
    aggs = []
    for c in goals:
        at = F.when(F.col(c) == F.col(f"best_{c}"), F.col(epoch))
        aggs += [F.min(at).alias(names[c]), F.first(f"best_{c}").alias(f"best_{c}")]
    return reached.groupBy(run).agg(*aggs)
