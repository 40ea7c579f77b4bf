"""Joins of a large table with a table that is expected to be small."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

#: Largest lookup (rows, bytes) that is ever broadcast; beyond it the join is salted.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: How many ways one key of the large side is split when the lookup is not small.
SALTS = 16


def _nullable(schema: T.StructType) -> T.StructType:
    """The schema with every field and element nullable, as Arrow data may need."""
    relaxed = re.sub(r'"(nullable|containsNull|valueContainsNull)":false', r'"\1":true', schema.json())
    return T.StructType.fromJson(json.loads(relaxed))


def bounded(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """``small`` as a local table if rows and bytes are within bounds, else None.

    At most ``limit + 1`` rows reach the driver, so the check itself is bounded.
    """
    rows = small.limit(limit + 1).toArrow()
    if rows.num_rows > limit or rows.nbytes > BROADCAST_BYTES:
        return None
    return small.sparkSession.createDataFrame(rows, _nullable(small.schema))


def attach(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``big`` to ``small`` on ``on`` (empty: ``small`` is one global row).

    A lookup of checked size is broadcast, so ``big`` is not shuffled.  A larger
    one is joined by hash with each key of ``big`` split ``SALTS`` ways over the
    columns ``spread``, so a key that holds a third of all rows still spreads.
    """
    on = list(on)
    if not on:
        row = small.first()  # the result of a global aggregate
        return big.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in small.schema})
    local = bounded(small, limit)
    if local is not None:
        return big.join(F.broadcast(local), on, how)
    return salted_join(big, small, on, spread, how)


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi-join that splits each key of ``big`` over ``SALTS`` tasks."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("__salt", salt).join(copies, [*on, "__salt"], how).drop("__salt")
