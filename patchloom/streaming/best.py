"""Running best loss and accuracy over a stream of epoch records."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from patchloom.operators.lookup import attach
from patchloom.operators.runlog import running_best
from patchloom.session import shared_dir

OUTPUT = "run string, epoch bigint, loss double, accuracy double, new_best boolean, new_best_accuracy boolean"
#: With late records in the output; their flags are null.
OUTPUT_LATE = f"{OUTPUT}, late boolean"
STATE = "best_loss double, best_accuracy double, epoch bigint"
STATE_TABLE = "run string, start_loss double, start_accuracy double, last bigint"


def _advance(
    key: tuple, frames: Iterable[pd.DataFrame], state: GroupState, ignore_late: bool = True
) -> Iterator[pd.DataFrame]:
    """New records of one run in epoch order; epochs not after the last are late.

    Of new records with one epoch the one with the lowest loss, then accuracy,
    counts. Late ones are left out, or else come out with null flags, and their
    values go into the best that later records are compared with.
    """
    best_loss, best_acc, last = state.get if state.exists else (float("inf"), 0.0, -1)
    rows = pd.concat(list(frames), ignore_index=True)
    is_late = rows["epoch"] <= last
    late, rows = rows[is_late], rows[~is_late].sort_values(["epoch", "loss", "accuracy"])
    rows = rows.drop_duplicates("epoch", keep="first")
    if ignore_late:
        late = late[:0]
    if rows.empty and late.empty:
        return
    if len(late):
        best_loss = float(min(best_loss, late["loss"].fillna(float("inf")).min()))
        best_acc = float(max(best_acc, late["accuracy"].fillna(0.0).max()))
    loss_before = rows["loss"].cummin().shift(fill_value=float("inf")).clip(upper=best_loss)
    acc_before = rows["accuracy"].cummax().shift(fill_value=0.0).clip(lower=best_acc)
    out = pd.DataFrame(
        {
            "run": key[0],
            "epoch": rows["epoch"],
            "loss": rows["loss"],
            "accuracy": rows["accuracy"],
            "new_best": rows["loss"] < loss_before,
            "new_best_accuracy": rows["accuracy"] > acc_before,
        }
    )
    if len(rows):
        best_loss = float(min(best_loss, rows["loss"].min()))
        best_acc = float(max(best_acc, rows["accuracy"].max()))
        last = int(rows["epoch"].max())
    state.update((best_loss, best_acc, last))
    if not ignore_late:
        flags = {"new_best": None, "new_best_accuracy": None, "late": True}
        late = late[["epoch", "loss", "accuracy"]].assign(run=key[0], **flags)
        parts = [part for part in (out.assign(late=False), late[[*out.columns, "late"]]) if len(part)]
        out = pd.concat([part.astype({f: object for f in flags}) for part in parts], ignore_index=True)
    yield out


def stream_running_best(log: DataFrame, ignore_late: bool = True) -> DataFrame:
    """Flag new bests as records ``(run, epoch, loss, accuracy)`` arrive.

    The state is three numbers per run.  Inside a micro-batch records are taken
    in epoch order; a record that is not newer than the state's epoch is late. Late
    records are ignored, or with ``ignore_late=False`` kept: the output then has a
    column ``late``, late records come out with null flags, and count for the
    bests of records after them.  One task holds a run's records of one
    micro-batch: for live logs that is little; use ``start_best`` where a batch
    may be large.
    """
    advance = _advance if ignore_late else partial(_advance, ignore_late=False)
    return log.groupBy("run").applyInPandasWithState(
        advance, OUTPUT if ignore_late else OUTPUT_LATE, STATE, "append", GroupStateTimeout.NoTimeout
    )


def start_best(
    log: DataFrame, table: str, checkpoint: str, ignore_late: bool = True, **trigger
) -> StreamingQuery:
    """The same flags for micro-batches of any size, as a table ``<table>/flags``.

    Each batch runs the distributed ``running_best`` on its records, seeded with
    a state table that has one row per run.  Flags and state are written per
    batch number, so a repeated batch replaces its own output.  Records whose epoch
    is not after the state's are late and go to ``<table>/late`` as they came. They
    have no flags; with ``ignore_late=False`` they count for the bests of the
    records that are flagged in their batch and after it.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            best = F.min(F.struct("loss", "accuracy")).alias("__r")  # the rule of ``_advance``
            fresh = batch.groupBy("run", "epoch").agg(best).select("run", "epoch", "__r.*")
            late = batch.where("false")
            if number > 0:
                state = spark.read.schema(STATE_TABLE).parquet(f"{table}/state/batch={number - 1}")
                newer = F.col("last").isNull() | (F.col("epoch") > F.col("last"))
                newer = F.coalesce(newer, F.lit(False))  # a record without an epoch is late in a run that has begun
                late = attach(batch, state, ["run"], ["epoch"]).where(~newer).select(*batch.columns)
                if not ignore_late:
                    state = _lowered(state, late)
                fresh = attach(fresh, state, ["run"], ["epoch"]).where(newer).drop("last")
            late.write.mode("overwrite").parquet(f"{table}/late/batch={number}")
            flags = running_best(fresh)
            flags.write.mode("overwrite").parquet(f"{table}/flags/batch={number}")
            seen = fresh.select(
                "run",
                F.col("loss").alias("start_loss"),
                F.col("accuracy").alias("start_accuracy"),
                F.col("epoch").alias("last"),
            )
            if number > 0:
                seen = seen.unionByName(state)
            best = seen.groupBy("run").agg(
                F.min("start_loss").alias("start_loss"),
                F.max("start_accuracy").alias("start_accuracy"),
                F.max("last").alias("last"),
            )
            best.write.mode("overwrite").parquet(f"{table}/state/batch={number}")
        finally:
            batch.unpersist()

    return (
        log.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _lowered(state: DataFrame, late: DataFrame) -> DataFrame:
    """The state with late records in its bests; its last epochs stay."""
    more = late.select(
        "run", F.col("loss").alias("start_loss"), F.col("accuracy").alias("start_accuracy"),
        F.lit(None).cast("bigint").alias("last"),
    )
    bests = F.min("start_loss").alias("start_loss"), F.max("start_accuracy").alias("start_accuracy")
    return state.unionByName(more).groupBy("run").agg(*bests, F.max("last").alias("last"))


def best_of_stream(log: DataFrame) -> DataFrame:
    """Run the stream over what is available now and return the flagged records.

    Late records are in no row of it; ``start_best`` keeps them in its side table.
    """
    spark = log.sparkSession
    base = shared_dir(spark)
    start_best(log, f"{base}/best", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/best/flags").drop("batch")
