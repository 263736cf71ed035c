"""Sinks: JSON, CSV, Markdown and Parquet checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.operators.generated import export_rows, markdown
from clausewright.session import path_exists


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """One {uid: {category, force}} object per line."""
    labels.select(F.to_json(F.map_from_arrays(F.array("uid"), F.array(F.struct("category", "force")))).alias("value")).write.mode("overwrite").text(path)


def write_test_cases(cases: DataFrame, path: str) -> None:
    cases.withColumn("markdown", markdown()).write.mode("overwrite").json(path)


def write_csv(cases: DataFrame, path: str) -> None:
    """All fields quoted, columns Unique_ID, Test_title, test_scenario."""
    export_rows(cases).orderBy("Unique_ID").write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_download(cases: DataFrame, path: str) -> None:
    """test_id, title, scenario with line ends as blanks."""
    cases.select("test_id", "title", F.regexp_replace("scenario", r"\r?\n", " ").alias("scenario")).write.mode("overwrite").option("header", True).csv(path)


def write_markdown(cases: DataFrame, path: str) -> None:
    """Sections in test_id order with separators; the header with the total is the first part's first line."""
    total = cases.count()
    head = cases.sparkSession.createDataFrame([(f"# Generated test cases\n\nTotal: {total}\n\n---\n", "", 0)], "value string, test_id string, part int")
    body = cases.select(F.concat(markdown(), F.lit("\n---\n")).alias("value"), "test_id", F.lit(1).alias("part"))
    head.unionByName(body).orderBy("part", "test_id").select("value").write.mode("overwrite").text(path)


def stage(spark: SparkSession, path: str, build) -> DataFrame:
    """Parquet checkpoint of a pipeline stage: read it if it was finished, else build and write it."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
