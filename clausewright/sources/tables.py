"""Parquet table access for one data folder; nothing is inferred beyond the file's own schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausewright.session import share_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table for operators that compute in Python: dealt to all cores if its files give fewer tasks than those.

    Large inputs have more splits than cores and pass through unchanged, so nothing is shuffled there.
    """
    context = df.sparkSession.sparkContext
    conf = context.getConf()
    # executors may still be registering when a query is planned
    asked = int(conf.get("spark.executor.instances", "0")) * int(conf.get("spark.executor.cores", "1"))
    cores = max(context.defaultParallelism, asked)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
