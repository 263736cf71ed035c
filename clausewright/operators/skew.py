"""Joins of rows with an aggregate by the same keys, of which one key may hold a third of the rows.

Such an aggregate is already placed by its keys, so a plain join would read it as it is, and adaptive
execution splits a hot key only where both sides are shuffled for the join itself. A hash of the keys
as one more join column brings that about; it costs one shuffle of the aggregate, a row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTRA = "__skew"


def with_extra_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn(EXTRA, F.xxhash64(*keys))


def join_aggregate(rows: DataFrame, aggregate: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``aggregate`` (one row per key) on ``keys``; hot keys of ``rows`` can be split."""
    return with_extra_key(rows, keys).join(with_extra_key(aggregate, keys), [*keys, EXTRA], how).drop(EXTRA)
