"""Lines to clauses: numbering, noise, headings, segmentation, section paths, number repair, missing parents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.functions import text as tx
from clausewright.operators.ordered import carry_forward, running_count

#: all line ends of str.splitlines
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
#: how any heading begins, blanks and number signs before it
HEADING_START = r"(?i)^[\s\x{00A0}#]*(?:annex|scenario|[1-9])"


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end adds no empty line."""
    return F.split(F.regexp_replace(text, "(?:" + LINE_END + ")$", ""), LINE_END)


def numbered_lines(docs: DataFrame, doc: str, text: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc, extra..., line_no from 1, line)."""
    rows = docs.filter(F.col(text).isNotNull() & (F.col(text) != ""))
    return rows.select(doc, *extra, F.posexplode(split_lines(F.col(text))).alias("pos", "line")).select(doc, *extra, (F.col("pos") + 1).alias("line_no"), "line")


def bare_line(line: Column) -> Column:
    return tx.collapse(F.regexp_replace(F.trim(line), r"^#+\s*", ""))


def heading_id(line: Column) -> Column:
    """Id of a heading line (annex, scenario, dotted number), else null."""
    def found(s: Column) -> Column:
        annex = F.regexp_extract(s, r"(?i)^annex\s+(\d+)(?:\s*[-:]\s*.+)?$", 1)
        scenario = F.regexp_extract(s, r"(?i)^scenario\s+(\d+)(?:\s*[-:]\s*.+)?$", 1)
        number = F.regexp_extract(s, r"^([1-9]\d?(?:\.\d+)*)\.?\s+\S", 1)
        ok = ~tx.is_noise_line(s) & ~tx.is_contents_line(s)
        return F.when(ok, F.when(annex != "", F.concat(F.lit("Annex "), annex)).when(scenario != "", F.concat(F.lit("Scenario "), scenario)).when(number != "", number))

    # most lines are none by their first letters; the others are made bare once
    return F.when(line.rlike(HEADING_START), F.element_at(F.transform(F.array(bare_line(line)), found), 1))


def heading_title(line: Column) -> Column:
    s = bare_line(line)
    rest = F.regexp_replace(F.regexp_replace(s, r"(?i)^(?:annex|scenario)\s+\d+\s*[-:]?\s*", ""), r"^[1-9]\d?(?:\.\d+)*\.?\s+", "")
    return F.trim(rest)


def segment(lines: DataFrame, doc: str) -> DataFrame:
    """One row per clause: heading id, title, text of its lines, first and last line. Lines before any heading are dropped."""
    rows = lines.withColumn("hid", heading_id(F.col("line")))
    rows = running_count(rows, doc, "line_no", F.col("hid").isNotNull(), "segment").filter("segment > 0")
    body = F.when(F.col("hid").isNull() & ~tx.is_noise_line(bare_line(F.col("line"))) & (F.trim("line") != ""), tx.collapse(F.col("line")))
    cells = rows.select(doc, "segment", "line_no", "hid", F.when(F.col("hid").isNotNull(), heading_title(F.col("line"))).alias("title"), body.alias("body"))
    grouped = cells.groupBy(doc, "segment").agg(
        F.max("hid").alias("clause_id"), F.max("title").alias("title"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"),
        F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("line_no", "body")))).alias("b"),
    )
    return grouped.select(doc, "segment", "clause_id", "title", F.array_join(F.col("b.body"), "\n").alias("text"), "line_start", "line_end")


def repair_number(previous: Column, fragment: Column) -> Column:
    """Splices a broken number (".5.2") into the previous id where the longest run overlaps; the first start wins ties."""
    prev, frag = F.split(previous, r"\."), F.split(F.regexp_replace(fragment, r"^\.+|\.+$", ""), r"\.")
    starts = F.sequence(F.lit(0), F.size(prev) - 1)

    def overlap(start: Column) -> Column:
        most = F.least(F.size(prev) - start, F.size(frag))
        return F.array_max(F.transform(F.sequence(F.lit(0), most), lambda n: F.when((n == 0) | (F.slice(prev, start + 1, F.greatest(n, F.lit(1))) == F.slice(frag, 1, F.greatest(n, F.lit(1)))), n).otherwise(0)))

    best = F.array_max(F.transform(starts, lambda s: F.struct(overlap(s).alias("n"), (-s).alias("s"))))
    spliced = F.array_join(F.concat(F.slice(prev, 1, F.greatest(-best["s"], F.lit(0))), frag), ".")
    return F.when(best["n"] > 0, spliced).otherwise(F.concat(F.element_at(prev, 1), F.lit("."), F.array_join(frag, ".")))


def missing_parents(nodes: DataFrame) -> DataFrame:
    """(reg_doc, node, first_child): direct parents by form that are not there, one level up, with the smallest child id."""
    wanted = nodes.select("reg_doc", tx.parent_id(F.col("node")).alias("parent"), "node").filter(F.col("parent").isNotNull())
    gone = wanted.join(nodes.withColumnRenamed("node", "parent"), ["reg_doc", "parent"], "left_anti")
    return gone.groupBy("reg_doc", "parent").agg(F.min("node").alias("first_child")).select("reg_doc", F.col("parent").alias("node"), "first_child")


def recovered_parents(clauses: DataFrame, reach: int = 50) -> DataFrame:
    """Missing parents with a line (just above the first child) and the nearest pseudo title ending within ``reach`` lines above.

    The pseudo title is found with one ordered scan that carries the last one forward, not by a range join.
    """
    rows = clauses.withColumn("node", tx.canonical_id(F.col("clause_id"))).withColumn("is_pseudo", F.coalesce("is_pseudo_clause", F.lit(False)))
    mark = F.when(F.col("is_pseudo") & F.col("title").isNotNull(), F.struct("line_end", "title"))
    rows = carry_forward(rows, "reg_doc", "line_start", mark, "above", tie="clause_key")
    first = rows.filter(~F.col("is_pseudo") & tx.is_clause_id(F.col("node"))).groupBy("reg_doc", "node").agg(F.min(F.struct("line_start", "clause_key", "above")).alias("c"))
    gone = missing_parents(first.select("reg_doc", "node"))
    near = gone.join(first.select("reg_doc", F.col("node").alias("first_child"), "c.line_start", "c.above"), ["reg_doc", "first_child"])
    close = F.col("line_start") - F.col("above.line_end") <= reach
    return near.select("reg_doc", "node", "first_child", F.greatest(F.lit(0), F.col("line_start") - 1).alias("line_start"), F.when(close, F.col("above.title")).alias("title"))


def section_paths(headings: DataFrame) -> DataFrame:
    """``headings`` (reg_doc, line_no, hid, title) plus ``path``: labels of the open headings, root first.

    A heading is closed by one that is no dotted child of it; annexes reset everything. The fold is
    sequential per document, so each document's headings (not its lines) are folded in one group.
    """
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        stack: list[tuple[str, str]] = []
        out = []
        for doc, no, hid, title in zip(*(pdf.sort_values("line_no")[c] for c in ("reg_doc", "line_no", "hid", "title"))):
            label = f"{hid}. {title}" if hid[:1].isdigit() else f"{hid} - {title}" if title else hid
            if hid.startswith("Annex"):
                stack = []
            elif hid[:1].isdigit():
                while stack and stack[-1][0][:1].isdigit() and not hid.startswith(stack[-1][0] + "."):
                    stack.pop()
            stack.append((hid, label))
            out.append((doc, no, hid, [s[1] for s in stack]))
        return pd.DataFrame(out, columns=["reg_doc", "line_no", "hid", "path"])

    return headings.select("reg_doc", "line_no", "hid", "title").groupBy("reg_doc").applyInPandas(fold, "reg_doc string, line_no long, hid string, path array<string>")


def greedy_chunks(rows: DataFrame, doc: str, order: str, size: Column, budget: int = 9000) -> DataFrame:
    """``chunk`` from 0: consecutive rows packed until the budget would be passed. The reset depends on the running
    state, so sizes (two numbers a row, no texts) are folded per document."""
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc_now, chunk, used = None, 0, 0
        for pdf in batches:
            out = []
            for d, s in zip(pdf["__d"], pdf["__s"]):
                if d != doc_now:
                    doc_now, chunk, used = d, 0, 0
                if used and used + s > budget:
                    chunk, used = chunk + 1, 0
                used += int(s)
                out.append(chunk)
            yield pdf.assign(chunk=out)

    slim = rows.select(F.col(doc).alias("__d"), F.col(order).alias("__o"), size.cast("int").alias("__s")).repartition("__d").sortWithinPartitions("__d", "__o")
    return slim.mapInPandas(fold, f"__d string, __o {dict(rows.dtypes)[order]}, __s int, chunk int").select(F.col("__d").alias(doc), F.col("__o").alias(order), F.col("__s").alias("size"), "chunk")


def first_rows(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")
