"""Repair of clause rows: best copy per id, other duplicate rules, form pruning, titles, the clause index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.functions import text as tx


def first_line(text: Column) -> Column:
    """First line that isn't blank, collapsed."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n"), tx.collapse), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def copy_score(title: Column, text: Column, path: Column, region: Column) -> Column:
    """How good a copy of a clause is; form fields and non-body paths lose, titles, regions, paths and length win."""
    low = F.transform(F.coalesce(path, F.array().cast("array<string>")), F.lower)
    head = F.coalesce(F.try_element_at(low, F.lit(1)), F.lit(""))
    good_title = F.coalesce(F.trim(title) != "", F.lit(False)) & ~tx.looks_like_form_field(title)
    flag = lambda c, n: F.when(c, n).otherwise(0)
    return (
        flag(tx.looks_like_form_field(title), -100) + flag(F.array_contains(low, "communication"), -80) + flag(F.arrays_overlap(low, F.array(F.lit("annexes"), F.lit("annex"))), -40)
        + flag(F.coalesce(region, F.lit("")) != "", 5) + flag(good_title, 20) + flag((F.size(low) > 0) & ~head.isin("communication", "annexes", "annex"), 15)
        + F.least(F.length(F.coalesce(text, F.lit(""))), F.lit(1200)) / 100
    )


def pick(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by ``order``. Rows of a key are reduced by a partial aggregate before the shuffle."""
    names = rows.columns
    ranked = rows.withColumn("__o", F.struct(*order))
    best = ranked.groupBy(*key).agg(F.min_by(F.struct(*[c for c in names if c not in key]), "__o").alias("__r"))
    return best.select(*key, "__r.*").select(*names)


def with_node(clauses: DataFrame) -> DataFrame:
    return clauses.withColumn("node", tx.canonical_id(F.col("clause_id"))).filter(tx.is_clause_id(F.col("node")))


def best_copy(clauses: DataFrame, doc: str = "reg_doc", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Highest ``copy_score`` per (``doc``, node); the earlier row on ties. ``keep``: the columns to carry besides the
    key and the order, all by default."""
    score = copy_score(F.col("title"), F.col("text"), F.col("section_path"), F.col("document_region"))
    rows = with_node(clauses).withColumn("score", score)
    if keep is not None:
        rows = rows.select(*dict.fromkeys((doc, "node", *keep, "score", "line_start", "clause_key")))
    return pick(rows, [doc, "node"], -F.col("score"), F.col("line_start"), F.col("clause_key"))


def longest_copy(clauses: DataFrame) -> DataFrame:
    return pick(with_node(clauses), ["reg_doc", "node"], -F.length(F.coalesce("text", F.lit(""))), F.col("clause_key"))


def last_copy(clauses: DataFrame) -> DataFrame:
    return pick(with_node(clauses), ["reg_doc", "node"], -F.col("line_start"), -F.col("clause_key"))


def is_form_junk(title: Column, text: Column, path: Column) -> Column:
    line = first_line(text)
    low = F.transform(F.coalesce(path, F.array().cast("array<string>")), F.lower)
    return F.exists(low, lambda p: p.startswith("communication")) | tx.looks_like_form_field(title) | tx.looks_like_form_field(line) | line.rlike(r"[.…_]{5,}")


def repaired_title(title: Column, text: Column, node: Column) -> Column:
    """A usable title, else the first line if it is heading-like, else its first 80 characters, else "(untitled)"."""
    line = first_line(text)
    good = F.coalesce(F.trim(title) != "", F.lit(False)) & ~tx.looks_like_form_field(title)
    raw = F.when(good, F.trim(title)).when(line == "", "(untitled)").when((F.length(line) <= 60) & tx.looks_like_title(line), line).otherwise(F.concat(F.substring(line, 1, 80), F.lit("…")))
    tail = F.element_at(F.split(node, " / "), -1)
    stripped = F.when(raw.startswith(F.concat(tail, F.lit(". "))), F.substring(raw, F.length(tail) + F.lit(3), F.length(raw))).otherwise(raw)
    return F.regexp_replace(stripped, r"\s*\.\s*\d{1,3}\s*$", "")


def kept_copies(clauses: DataFrame) -> DataFrame:
    """Best copies without form junk: reg_doc, node, title, text, section_path."""
    best = best_copy(clauses.filter(~F.col("is_pseudo_clause")), keep=("title", "text", "section_path"))
    return best.filter(~is_form_junk(F.col("title"), F.col("text"), F.col("section_path")))


def preview(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, 400)


def index_texts(clauses: DataFrame) -> DataFrame:
    """The rows of ``clause_index`` with what a search reads: reg_doc, node, title, text_preview."""
    return kept_copies(clauses).select("reg_doc", "node", repaired_title(F.col("title"), F.col("text"), F.col("node")).alias("title"), preview(F.col("text")).alias("text_preview"))


def clause_index(clauses: DataFrame, labels: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Best copies without form junk, labelled: title, preview, category, force, testable, parent."""
    kept = kept_copies(clauses)
    parents = ancestors.filter("depth = 1").select("reg_doc", "node", F.col("ancestor").alias("parent"))
    rows = kept.join(labels, ["reg_doc", "node"], "left").join(parents, ["reg_doc", "node"], "left")
    testable = F.col("category").isin(*tx.TESTABLE) & (F.col("force") == "binding")
    return rows.select(
        "reg_doc", "node", repaired_title(F.col("title"), F.col("text"), F.col("node")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), preview(F.col("text")).alias("text_preview"),
        F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("force", F.lit("none")).alias("force"), F.coalesce(testable, F.lit(False)).alias("testable"), "section_path", "parent",
    )


def namespaced(clauses: DataFrame) -> DataFrame:
    """``namespaced_id``: ids after an annex heading get its name as prefix, in line order; already prefixed ids stay."""
    from clausewright.operators.ordered import carry_forward

    rows = clauses.withColumn("bare", tx.canonical_id(F.col("clause_id")))
    head = F.when(F.col("bare").rlike(r"^Annex \d+$"), F.col("bare"))
    rows = carry_forward(rows, "reg_doc", "line_start", head, "container", tie="clause_key")
    keep = F.col("is_pseudo_clause") | F.col("container").isNull() | F.col("bare").contains(" / ") | (F.col("bare") == F.col("container")) | F.col("bare").rlike(r"^Annex \d+$")
    return rows.withColumn("namespaced_id", F.when(keep, F.col("bare")).otherwise(F.concat("container", F.lit(" / "), "bare")))


def ordered_rank(rows: DataFrame, doc: str, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(doc).orderBy(*order)))
