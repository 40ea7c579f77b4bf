"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times whose mean is the rate of
its source. The draw inverts the distribution at a uniform number hashed from
seed and document id: a lost task draws the same again, and no source has to be
gathered to be thinned or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchloom.session import written

#: Means above this are drawn as a sum of equal parts, as exp(-mean) would vanish.
PART = 200.0


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) from the leading 52 bits of the md5 of ``key``."""
    digits = F.substring(F.md5(F.concat_ws(":", *key)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(2**52)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5) -> DataFrame:
    """Mean repetitions per source: source, rate.

    Sizes are bytes of text. A source's target share is its entry in ``weights``
    (sources without one get 0) or, without weights, in proportion to its size
    to the power ``alpha``; shares are of the total size, which the mixture
    keeps. A source without any text has rate 1. Null is a source of its own.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("double")
    sizes = docs.groupBy("source").agg(F.sum(size).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
        sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0))
    sizes = written(sizes)  # a row per source; read three times
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    scale = total["size"] / total["weight"] if total["weight"] else 0.0
    rate = F.col("weight") * scale / F.col("size")
    return sizes.select("source", F.when(F.col("size") > 0, rate).otherwise(1.0).alias("rate"))


def _steps(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... for a mean of at most ``PART``."""
    count = (rate + 12 * F.sqrt(rate) + 30).cast("int")

    def add(acc, k):
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), count), start, add)["all"]


def poisson_mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, seed: int = 17
) -> DataFrame:
    """``docs`` with each row repeated by its draw, in a global random order.

    Adds ``copy`` (from 1) and ``mix_key`` (the hash that orders the mixture).
    Rows with the same doc_id draw the same count; a null doc_id is a value of its
    own; an empty table stays empty. Columns of these two names in ``docs`` are
    replaced. The text is shuffled once, by ``mix_key``, so a source that holds
    most rows is spread evenly over all partitions.
    """
    docs = docs.drop("copy", "mix_key", "_steps", "_parts")
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    plan = rates(docs, weights, alpha).select(
        F.col("source").alias("_source"), parts.alias("_parts"), _steps(F.col("rate") / parts).alias("_steps")
    )
    drawn = docs.join(plan, docs["source"].eqNullSafe(plan["_source"]))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))

    def draw(total, part):
        u = uniform(F.lit(str(seed)), part.cast("string"), key)
        below = F.filter("_steps", lambda c: c <= u)
        return total + F.size(below)

    times = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), draw)
    drawn = drawn.withColumn("copy", times).where("copy > 0").drop("_source", "_parts", "_steps")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copy"))))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("copy").cast("string"), key, F.lit("order")))
    return copies.withColumn("mix_key", order).repartition("mix_key").sortWithinPartitions("mix_key")
