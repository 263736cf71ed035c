"""Ordered scans over long documents without one task per document.

A running value (last non-null, running count) is computed in two steps: inside chunks of
consecutive positions, then over one summary row per chunk, and the two are combined. The chunk
summaries of a document are few (rows / ``CHUNK``), so a document of any length is spread over many
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 20_000


def _chunked(df: DataFrame, doc: str, position: str) -> DataFrame:
    return df.withColumn("__chunk", F.floor(F.col(position) / CHUNK))


def carry_forward(df: DataFrame, doc: str, position: str, value: Column, out: str, tie: str | None = None) -> DataFrame:
    """``out``: the last non-null ``value`` at or before each row of its document."""
    order = [position] + ([tie] if tie else [])
    rows = _chunked(df.withColumn("__v", value), doc, position)
    inside = W.partitionBy(doc, "__chunk").orderBy(*order)
    rows = rows.withColumn("__in", F.last("__v", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    ends = rows.filter(F.col("__v").isNotNull()).groupBy(doc, "__chunk").agg(F.max_by("__v", F.struct(*order)).alias("__end"))
    chunks = rows.select(doc, "__chunk").distinct().join(ends, [doc, "__chunk"], "left")
    before = W.partitionBy(doc).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).select(doc, "__chunk", "__carry")
    return rows.join(chunks, [doc, "__chunk"]).withColumn(out, F.coalesce("__in", "__carry")).drop("__v", "__in", "__carry", "__chunk")


def running_count(df: DataFrame, doc: str, position: str, flag: Column, out: str, tie: str | None = None) -> DataFrame:
    """``out``: how many rows of the document up to and including this one have ``flag``."""
    order = [position] + ([tie] if tie else [])
    rows = _chunked(df.withColumn("__f", flag.cast("int")), doc, position)
    inside = W.partitionBy(doc, "__chunk").orderBy(*order)
    rows = rows.withColumn("__in", F.sum("__f").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    sums = rows.groupBy(doc, "__chunk").agg(F.sum("__f").alias("__s"))
    before = W.partitionBy(doc).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__carry", F.coalesce(F.sum("__s").over(before), F.lit(0))).select(doc, "__chunk", "__carry")
    return rows.join(sums, [doc, "__chunk"]).withColumn(out, F.col("__in") + F.col("__carry")).drop("__f", "__in", "__carry", "__chunk")
