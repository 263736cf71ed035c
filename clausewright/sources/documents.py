"""Document sources: Markdown files, JSON checkpoints, label files, layout JSON, content-hash ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.operators.labels import parse_labels
from clausewright.operators.lines import numbered_lines

CLAUSE = T.StructType([
    T.StructField("uid", T.StringType()), T.StructField("clause_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("section_path", T.ArrayType(T.StringType())), T.StructField("references", T.ArrayType(T.StringType())),
    T.StructField("is_pseudo_clause", T.BooleanType()), T.StructField("document_region", T.StringType()),
])
TEST_CASE = T.StructType([
    T.StructField("test_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("scenario", T.StringType()), T.StructField("preconditions", T.ArrayType(T.StringType())), T.StructField("test_steps", T.ArrayType(T.StringType())),
    T.StructField("expected_behavior", T.ArrayType(T.StringType())), T.StructField("source_clause_ids", T.ArrayType(T.StringType())), T.StructField("parameters", T.MapType(T.StringType(), T.StringType())), T.StructField("reasoning_trace", T.StringType()), T.StructField("markdown", T.StringType()),
])
_SPAN = T.StructType([T.StructField("type", T.StringType()), T.StructField("content", T.StringType())])
LAYOUT = T.StructType([T.StructField("pdf_info", T.ArrayType(T.StructType([
    T.StructField("page_idx", T.IntegerType()), T.StructField("page_size", T.ArrayType(T.IntegerType())),
    T.StructField("para_blocks", T.ArrayType(T.StructType([
        T.StructField("index", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("lines", T.ArrayType(T.StructType([T.StructField("spans", T.ArrayType(_SPAN))]))),
    ]))),
])))])
#: suffixes that need no converter, and those that a converter has to turn into Markdown
DIRECT, CONVERTED = (".md", ".markdown"), (".pdf", ".docx", ".pptx", ".xlsx", ".png", ".jpg", ".jpeg")


def markdown_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, line_no, line) of Markdown files; whole files are read, so that tables may span pages."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.col("value"))
    return numbered_lines(files, "doc", "value")


def clause_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLAUSE).option("multiLine", True).json(path)


def test_case_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEST_CASE).option("multiLine", True).json(path)


def label_file(spark: SparkSession, path: str) -> DataFrame:
    return parse_labels(spark.read.text(path, wholetext=True))


def layout_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT).option("multiLine", True).json(path)


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_hash, path, suffix, kind, content): content-addressed ids; kind is direct, convert or unsupported."""
    files = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = F.when(suffix.isin(*DIRECT), "direct").when(suffix.isin(*CONVERTED), "convert").otherwise("unsupported")
    return files.select(F.substring(F.sha2("content", 256), 1, 16).alias("doc_hash"), "path", suffix.alias("suffix"), kind.alias("kind"), "content")


def unprocessed(documents: DataFrame, processed: DataFrame) -> DataFrame:
    """Documents whose content hash isn't known yet."""
    return documents.join(processed.select("doc_hash"), "doc_hash", "left_anti")


def preferred_outputs(files: DataFrame) -> DataFrame:
    """Per document the converted Markdown file to use: ``stem/*/stem.md`` before any other, then by path. ``files``: doc, path."""
    first = F.when(F.col("path").rlike(r".*") & F.col("path").endswith(F.concat(F.lit("/"), F.col("doc"), F.lit(".md"))), 0).otherwise(1)
    rank = F.row_number().over(W.partitionBy("doc").orderBy(first, "path"))
    return files.filter(F.col("path").endswith(".md")).withColumn("__r", rank).filter("__r = 1").drop("__r")
