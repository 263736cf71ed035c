"""Queries of the text problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import markup, mixing, personal, residue, scan_repair, survivors, tokenizer
from clausewright.sources.tables import spread, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.copy_pairs(survivors.grouped(spread(table(spark, d, "clauses"))))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    best = survivors.survivors(spread(table(spark, d, "clauses")), table(spark, d, "parser_trust"))
    return best.withColumn("section_path", F.array_join("section_path", " > "))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_clauses(spread(table(spark, d, "clauses")))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(spread(table(spark, d, "clauses"))).select("clause_key", "title", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.scanned_clauses(spread(table(spark, d, "clauses")))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repaired_clauses(spread(table(spark, d, "clauses")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.marked_up(spread(table(spark, d, "clauses")), table(spark, d, "regulation_tables"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.cleaned_sources(spread(table(spark, d, "clauses")), table(spark, d, "regulation_tables"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_documents(spread(table(spark, d, "documents")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found_spans(spread(table(spark, d, "documents"))).select("doc_id", "kind", "start_pos").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(spread(table(spark, d, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_survivors, p5_found, p5_clean, p6_found, p6_repaired, p7_found, p7_clean, p8_ids, p9_mix, p9_shares, p10_found, p10_redacted)}
ORACLE: dict[str, str] = {}
