"""Queries on the lines of one document with so many clauses that a line number passes the range of int."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

CLAUSES = 214_760


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One clause an annex, each with a title and one line of text."""
    path = str(tmp_path_factory.mktemp("long"))
    i = F.col("id") + 1
    rows = spark.range(CLAUSES).select(
        i.alias("clause_key"), F.lit("R1").alias("reg_doc"), F.concat(F.lit("Annex "), i.cast("string"), F.lit(" / 1")).alias("clause_id"), F.lit("Lamps").alias("title"),
        F.concat(F.lit("The lamp number "), i.cast("string"), F.lit(" shall be lit.")).alias("text"), i.cast("int").alias("line_start"), i.cast("int").alias("line_end"),
        F.array().cast("array<string>").alias("section_path"), F.lit("annex").alias("document_region"), F.lit(False).alias("is_pseudo_clause"),
    )
    rows.write.parquet(f"{path}/clauses.parquet")
    return path


def test_headings_of_a_long_document(spark, folder):
    found = entry.queries()["q38_heading_recognise"](spark, folder)
    got = found.groupBy("hid", "htitle").agg(F.count("*").alias("n"), F.countDistinct("line_no").alias("numbers"), F.min("line_no").alias("first"), F.max("line_no").alias("last")).collect()
    assert [tuple(r) for r in got] == [("1", "Lamps", CLAUSES, CLAUSES, 10_001, CLAUSES * 10_000 + 1)]


def test_depths_of_a_long_document(spark, folder):
    found = entry.queries()["q42_section_path_depth"](spark, folder)
    got = found.groupBy("hid", "depth").agg(F.count("*").alias("n"), F.countDistinct("line_no").alias("numbers"), F.max("line_no").alias("last")).collect()
    assert [tuple(r) for r in got] == [("1", 1, CLAUSES, CLAUSES, CLAUSES * 10_000 + 1)]


def test_segments_of_a_long_document(spark, folder):
    found = entry.queries()["q39_clause_segmentation"](spark, folder)
    whole = (F.col("line_start") == F.col("segment") * 10_000 + 1) & (F.col("line_end") == F.col("line_start") + 1)
    text = F.col("text") == F.concat(F.lit("The lamp number "), F.col("segment").cast("string"), F.lit(" shall be lit."))
    assert found.agg(F.count("*"), F.countDistinct("segment"), F.count_if(whole & text)).first()[:] == (CLAUSES, CLAUSES, CLAUSES)


def test_blocks_of_a_long_document(spark, folder):
    found = entry.queries()["q70_page_correlation"](spark, folder)
    own = F.col("block_no") == F.col("clause_no") * 10_000 + 2
    assert found.agg(F.count("*"), F.countDistinct("clause_no"), F.count_if(own)).first()[:] == (CLAUSES, CLAUSES, CLAUSES)
