from pyspark.sql import functions as F

from clausewright.operators import orphans as O
from clausewright.operators.skew import join_aggregate

SETTINGS = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12"}


def final_plan(spark, build):
    """Rows and the executed plan under settings that call small partitions skewed."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        df = build()
        n = len(df.collect())
        return n, df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, n=30_000):
    """A third of the rows share one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string")))
    return spark.range(n).repartition(8).select(F.lit("d").alias("reg_doc"), key.alias("ref_key"), F.sha2(F.col("id").cast("string"), 256).alias("src_key"), F.lit("2024-01-01").cast("timestamp").alias("ref_at"))


def test_a_hot_key_meets_an_aggregate(spark):
    def build():
        rows = hot(spark)
        sizes = rows.groupBy("reg_doc", "ref_key").agg(F.count("*").alias("n"))
        return join_aggregate(rows, sizes, ["reg_doc", "ref_key"])

    n, plan = final_plan(spark, build)
    assert n == 30_000 and "skew=true" in plan


def test_references_to_one_hot_key_are_split(spark):
    def build():
        rows = hot(spark)
        targets = O.referenced_keys(rows.filter("ref_key = 'hot' OR ref_key < 'k3'").withColumn("t", F.lit("2023-01-01").cast("timestamp")), ["reg_doc", "ref_key"], "t")
        return O.orphan_references(rows, targets, ["reg_doc", "ref_key"], "ref_at")

    n, plan = final_plan(spark, build)
    assert n == hot(spark).filter("ref_key <> 'hot' AND ref_key >= 'k3'").count() and "skew=true" in plan
