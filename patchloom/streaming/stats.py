"""Running channel statistics over a stream of pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from patchloom.session import shared_dir


def stream_channel_stats(pixels: DataFrame, by: Sequence[str] = ("image",)) -> DataFrame:
    """Mean and population deviation per channel as images arrive.

    Count, mean and deviation are mergeable states, so each trigger only sends
    partial sums per channel, and the last rows equal the batch statistics.
    """
    v = F.col("v").cast("double")
    return pixels.groupBy(*by).agg(
        F.count("v").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")
    )


def start_stats(stats: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the current statistics as a parquet table, replaced on each trigger.

    The table has a row per channel.  Each batch writes its own folder, so a
    repeated batch after a failure writes the same rows again.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        stats.writeStream.outputMode("complete")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest(spark: SparkSession, table: str) -> DataFrame:
    """Rows of the last finished batch."""
    rows = spark.read.parquet(table)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).drop("batch")


def stats_of_stream(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Run the stream over what is available now and return the final statistics."""
    spark = pixels.sparkSession
    base = shared_dir(spark)
    query = start_stats(stream_channel_stats(pixels, by), f"{base}/table", f"{base}/checkpoint")
    query.awaitTermination()
    return latest(spark, f"{base}/table")
