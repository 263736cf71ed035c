"""Clause labels (category, force): joins with fall-back, defaults, testable selection, legacy input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import text as tx


def is_testable(category: Column, force: Column) -> Column:
    return category.isin(*tx.TESTABLE) & (F.coalesce(force, F.lit("binding")) == "binding")


def attach_labels(rows: DataFrame, by_uid: DataFrame, by_id: DataFrame) -> DataFrame:
    """Labels by uid, else by (reg_doc, node), else unknown/none. Both label tables are unique by key."""
    first = by_uid.select("uid", F.col("category").alias("__c1"), F.col("force").alias("__f1"))
    second = by_id.select("reg_doc", "node", F.col("category").alias("__c2"), F.col("force").alias("__f2"))
    hit = F.col("__c1").isNotNull()
    out = rows.join(first, "uid", "left").join(second, ["reg_doc", "node"], "left")
    return out.withColumns({
        "category": F.when(hit, F.col("__c1")).otherwise(F.coalesce("__c2", F.lit("unknown"))),
        "force": F.when(hit, F.col("__f1")).otherwise(F.coalesce("__f2", F.lit("none"))),
    }).drop("__c1", "__c2", "__f1", "__f2")


def ablation_labels(rows: DataFrame) -> DataFrame:
    """Without a classifier: pseudo-clauses are formatting, all others obligations."""
    return rows.withColumns({"category": F.when(F.col("is_pseudo_clause"), "formatting").otherwise("obligation"), "force": F.when(F.col("is_pseudo_clause"), "none").otherwise("binding")})


def requirement_labels(requirements: DataFrame) -> DataFrame:
    """(reg_doc, node, category, force) from the requirements of each clause; the smallest category wins."""
    kind = F.col("requirement_type")
    category = (
        F.when(kind == "procedure", "test_procedure").when(kind == "test_condition", "test_condition").when(kind == "performance", "performance_data")
        .when(kind == "documentation", "administrative").when(kind == "other", "formatting").when(kind.isNotNull(), "obligation")
    )
    rows = requirements.select("reg_doc", tx.canonical_id(F.col("source_clause_id")).alias("node"), category.alias("category"), F.when(F.col("actor").isNotNull(), "binding").otherwise("none").alias("force"))
    return rows.filter(tx.is_clause_id(F.col("node")) & F.col("category").isNotNull()).groupBy("reg_doc", "node").agg(F.min(F.struct("category", "force")).alias("x")).select("reg_doc", "node", "x.category", "x.force")


def node_labels(nodes: DataFrame, by_id: DataFrame) -> DataFrame:
    """(reg_doc, node, category, force) of every node; undotted headings default to formatting."""
    heading = ~F.element_at(F.split("node", " / "), -1).contains(".")
    return nodes.join(by_id, ["reg_doc", "node"], "left").withColumns({"category": F.coalesce("category", F.when(heading, "formatting").otherwise("unknown")), "force": F.coalesce("force", F.lit("none"))})


def parse_labels(lines: DataFrame, value: str = "value") -> DataFrame:
    """(uid, category, force) from JSON objects keyed by uid, whose values are objects or, in old files, bare categories."""
    entries = lines.select(F.explode(F.from_json(value, "map<string,string>")).alias("uid", "v"))
    obj = F.from_json("v", "struct<category:string,force:string>")
    legacy = ~F.col("v").startswith("{")
    return entries.select("uid", F.when(legacy, F.col("v")).otherwise(F.coalesce(obj["category"], F.lit("unknown"))).alias("category"), F.when(legacy, "binding").otherwise(F.coalesce(obj["force"], F.lit("binding"))).alias("force"))
