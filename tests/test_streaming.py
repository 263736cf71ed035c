from pyspark.sql import functions as F

from clausewright.streaming.ingest import ingest_files, windowed_counts


def test_each_content_is_ingested_once(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    (source / "a.md").write_text("one\ntwo")
    ingest_files(spark, str(source), target, state).awaitTermination()
    (source / "copy.md").write_text("one\ntwo")
    (source / "b.md").write_text("three")
    ingest_files(spark, str(source), target, state).awaitTermination()
    ingest_files(spark, str(source), target, state).awaitTermination()
    assert sorted(r.line for r in spark.read.parquet(target).collect()) == ["one", "three", "two"]


def test_windowed_counts(spark, tables, data):
    events = spark.readStream.schema(tables("events").schema).parquet(f"{data}/events*.parquet")
    q = windowed_counts(events).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == tables("events").count()
