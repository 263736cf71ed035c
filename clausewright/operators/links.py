"""Typed links and the document tree derived from section paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import text as tx


def reference_links(clauses: DataFrame, nodes: DataFrame) -> DataFrame:
    """(reg_doc, source_id, target_id, target_type): distinct links of the references; clause if known, else annex or unknown.

    The first of equal links (source, normalised target) stays, so a target keeps its first spelling.
    """
    refs = clauses.filter(~F.col("is_pseudo_clause")).select("reg_doc", "clause_key", tx.canonical_id(F.col("clause_id")).alias("source_id"), F.posexplode("reference_ids").alias("pos", "ref")).filter(F.col("ref").isNotNull())
    refs = refs.withColumn("target", tx.canonical_id(F.col("ref"))).filter(F.col("target") != "")
    first = refs.groupBy("reg_doc", "source_id", F.lower("target").alias("t")).agg(F.min_by("target", F.struct("clause_key", "pos")).alias("target_id"))
    known = nodes.select("reg_doc", F.col("node").alias("target_id"), F.lit(True).alias("known"))
    kind = F.when(F.col("known"), "clause").when(F.lower("target_id").startswith("annex"), "annex").otherwise("unknown")
    return first.join(known, ["reg_doc", "target_id"], "left").select("reg_doc", "source_id", "target_id", kind.alias("target_type"))


def document_tree(clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections from path prefixes: (reg_doc, path, parent_path, title, level), and (reg_doc, path, clause_key) of what each contains directly."""
    own = clauses.filter(F.size(F.coalesce("section_path", F.array().cast("array<string>"))) > 0)
    prefixes = own.select("reg_doc", "section_path", F.explode(F.sequence(F.lit(1), F.size("section_path"))).alias("level")).withColumn("p", F.slice("section_path", 1, F.col("level")))
    join = lambda c: F.array_join(c, " > ", "")
    sections = prefixes.select("reg_doc", join(F.col("p")).alias("path"), F.when(F.col("level") > 1, join(F.slice("p", 1, F.col("level") - 1))).alias("parent_path"), F.element_at("p", -1).alias("title"), "level").distinct()
    return sections, own.select("reg_doc", join(F.col("section_path")).alias("path"), "clause_key")


def structural_links(clauses: DataFrame) -> DataFrame:
    """(reg_doc, source, relation, target): parent_of between sections, contains from section to clause."""
    sections, held = document_tree(clauses)
    up = sections.filter(F.col("parent_path").isNotNull()).select("reg_doc", F.col("parent_path").alias("source"), F.lit("parent_of").alias("relation"), F.col("path").alias("target"))
    return up.unionByName(held.select("reg_doc", F.col("path").alias("source"), F.lit("contains").alias("relation"), F.col("clause_key").cast("string").alias("target")))


def table_links(tables: DataFrame) -> DataFrame:
    """(reg_doc, source_id, target_id): clause contains table; tables without an owner have none."""
    return tables.filter(F.col("owner_clause_id").isNotNull()).select("reg_doc", tx.canonical_id(F.col("owner_clause_id")).alias("source_id"), F.col("table_id").alias("target_id")).distinct()


def citation(doc: Column, clause_id: Column, title: Column) -> Column:
    """ "R1, paragraph 5.2 (Scope)"; annexes keep their own name."""
    name = F.when(clause_id.rlike(r"^\d"), F.concat(F.lit("paragraph "), clause_id)).otherwise(clause_id)
    return F.concat(doc, F.lit(", "), name, F.when(F.coalesce(F.trim(title), F.lit("")) != "", F.concat(F.lit(" ("), F.trim(title), F.lit(")"))).otherwise(""))


def full_path(path: Column) -> Column:
    return F.array_join(F.filter(path, lambda p: F.trim(p) != ""), " > ")


def html_escaped(text: Column) -> Column:
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def node_label(node: Column, title: Column, width: int = 28) -> Column:
    """Two-line label of a graph node; long titles are cut."""
    t = F.coalesce(title, F.lit(""))
    return F.concat(node, F.lit("\n"), F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 1), F.lit("…"))).otherwise(t))


def table_text(row_maps: Column, hide_empty: bool = True) -> Column:
    """One line per row, "Row i: header = value | ..."; empty cells are hidden or shown."""
    cells = lambda m: F.array_sort(F.filter(F.map_entries(m), lambda e: (F.coalesce(F.trim(e["value"]), F.lit("")) != "") | F.lit(not hide_empty)))
    rows = F.transform(row_maps, lambda m, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), F.array_join(F.transform(cells(m), lambda e: F.concat(e["key"], F.lit(" = "), F.coalesce(e["value"], F.lit("")))), " | ")))
    return F.array_join(rows, "\n")
