"""File-arrival ingest (an extension): new Markdown files become numbered lines, each content once.

Files are identified by the hash of their content; a micro-batch writes only contents that the target
doesn't hold, so a repeated delivery or a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausewright.operators.lines import numbered_lines
from clausewright.session import path_exists


def ingest_files(spark: SparkSession, folder: str, target: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    stream = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.substring(F.sha2("value", 256), 1, 16).alias("doc_hash"), F.col("_metadata.file_name").alias("doc"), "value")

    def write(batch: DataFrame, epoch: int) -> None:
        fresh = batch.groupBy("doc_hash").agg(F.min("doc").alias("doc"), F.min("value").alias("value"))
        if path_exists(batch.sparkSession, target):
            known = batch.sparkSession.read.parquet(target).select("doc_hash").distinct()
            fresh = fresh.join(known, "doc_hash", "left_anti")
        numbered_lines(fresh, "doc_hash", "value", ("doc",)).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window with a watermark; late rows beyond it are dropped by the engine."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
