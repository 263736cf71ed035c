"""Generated test cases: rendering, export rows, parsing of model output, chat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTPUT = T.StructType([
    T.StructField("reasoning", T.StringType()),
    T.StructField("test_cases", T.ArrayType(T.StructType([
        T.StructField("test_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("scenario", T.StringType()), T.StructField("preconditions", T.ArrayType(T.StringType())), T.StructField("test_steps", T.ArrayType(T.StringType())),
        T.StructField("expected_behavior", T.ArrayType(T.StringType())), T.StructField("source_clause_ids", T.ArrayType(T.StringType())), T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
    ]))),
])


def _section(title: str, items: Column, prefix: str) -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit(prefix), x)), "\n")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"### {title}\n\n"), lines, F.lit("\n\n"))).otherwise("")


def markdown(test_id: str = "test_id") -> Column:
    """A test case as a Markdown section; empty lists and maps leave no heading."""
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("preconditions", "test_steps", "expected_behavior", "source_clause_ids")}
    entries = F.array_sort(F.map_entries(F.coalesce("parameters", F.create_map().cast("map<string,string>"))))
    pair = lambda sep: F.transform(entries, lambda e: F.concat(e["key"], F.lit(sep), e["value"]))
    return F.concat(
        F.lit("## "), F.col(test_id), F.lit("\n\n**Title:** "), F.coalesce("title", F.lit("")), F.lit("  \n**Source clauses:** "), F.array_join(lists["source_clause_ids"], ", "), F.lit("  \n"),
        F.when(F.size(entries) > 0, F.concat(F.lit("**Parameters:** "), F.array_join(pair(": "), ", "), F.lit("  \n"))).otherwise(""),
        F.lit("\n### Overview\n\n"), F.coalesce("scenario", F.lit("")), F.lit("\n\n"), _section("Preconditions", lists["preconditions"], "- "), _section("Test Steps", lists["test_steps"], ""), _section("Expected Result", lists["expected_behavior"], "- "),
        F.when(F.size(entries) > 0, F.concat(F.lit("### Parameters\n\n| Parameter | Value |\n|-----------|-------|\n"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit("| "), e["key"], F.lit(" | "), e["value"], F.lit(" |"))), "\n"), F.lit("\n\n"))).otherwise(""),
    )


def export_rows(cases: DataFrame) -> DataFrame:
    """(Unique_ID, Test_title, test_scenario): numbered in (created_at, test_id) order over all cases.

    The running number needs a global order: rows are range-partitioned and sorted, numbered inside each
    partition, and shifted by the partition's offset (one small row per partition).
    """
    ordered = cases.select("test_id", "scenario", "created_at").repartitionByRange("created_at", "test_id").sortWithinPartitions("created_at", "test_id").withColumn("__p", F.spark_partition_id())
    inside = ordered.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy("created_at", "test_id")))
    sizes = inside.groupBy("__p").agg(F.count("*").alias("__n"))
    shift = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__p", "__o")
    return inside.join(shift, "__p").select((F.col("__i") + F.col("__o")).alias("Unique_ID"), F.col("test_id").alias("Test_title"), F.col("scenario").alias("test_scenario"))


def parse_output(rows: DataFrame, raw: str, clause: str) -> DataFrame:
    """One row per test case in model output: fences off, JSON or the first to last brace of it, defaults per field."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col(raw), r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""))
    whole = F.from_json(text, OUTPUT)
    inner = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), OUTPUT)
    parsed = rows.withColumn("__o", F.when(whole["test_cases"].isNotNull(), whole).otherwise(inner))
    each = parsed.select(clause, F.col("__o.reasoning").alias("reasoning"), F.posexplode("__o.test_cases").alias("pos", "t"))
    return each.select(
        clause, (F.col("pos") + 1).alias("case_no"), F.coalesce("t.test_id", F.concat(F.lit("TC-"), F.col(clause).cast("string"), F.lit("-"), (F.col("pos") + 1).cast("string"))).alias("test_id"),
        F.coalesce("t.title", F.lit("")).alias("title"), F.coalesce("t.scenario", F.lit("")).alias("scenario"), F.coalesce("t.source_clause_ids", F.array(F.col(clause).cast("string"))).alias("source_clause_ids"), F.coalesce("reasoning", F.lit("")).alias("reasoning"),
    )


def split_reasoning(text: Column) -> tuple[Column, Column]:
    """(reasoning, answer) around <think> ... </think>: the first one is kept as reasoning, all are removed."""
    pattern = r"(?is)<think>(.*?)</think>"
    return F.trim(F.regexp_extract(text, pattern, 1)), F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def ordered_distinct(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, position, value): distinct non-empty values by first appearance."""
    first = rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(F.min(F.struct(*order)).alias("o"))
    return first.select(key, F.row_number().over(W.partitionBy(key).orderBy("o", value)).alias("position"), value)
