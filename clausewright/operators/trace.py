"""Tracing clauses to pages: layout blocks, page boxes, overlays, correlation of clauses with blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import text as tx

LEAST_TARGET = 15
SEARCH_WINDOW = 50


def text_blocks(pages: DataFrame) -> DataFrame:
    """Ordered text blocks of a layout JSON read with an explicit schema: (page, block_no, bbox, text)."""
    blocks = pages.select(F.explode("pdf_info").alias("p")).select(F.col("p.page_idx").alias("page"), F.posexplode("p.para_blocks").alias("pos", "b"))
    words = F.flatten(F.transform("b.lines", lambda line: F.transform(F.filter(line["spans"], lambda s: s["type"] == "text"), lambda s: s["content"])))
    rows = blocks.select("page", F.coalesce("b.index", "pos").alias("block_no"), F.col("b.bbox").alias("bbox"), F.array_join(words, " ").alias("text"))
    return rows.filter((F.trim("text") != "") & F.col("bbox").isNotNull())


def regions(pages: DataFrame) -> DataFrame:
    """Blocks of the kinds that an overlay can colour."""
    blocks = pages.select(F.explode("pdf_info").alias("p")).select(F.col("p.page_idx").alias("page"), F.explode("p.para_blocks").alias("b"))
    return blocks.filter(F.col("b.type").isin("text", "title", "list", "index", "table") & F.col("b.bbox").isNotNull()).select("page", F.col("b.type").alias("type"), F.col("b.bbox").alias("bbox"))


def page_boxes(traces: DataFrame) -> DataFrame:
    return traces.groupBy("page").agg(F.count("*").alias("boxes"), F.collect_list("bbox").alias("bboxes"))


def normalised(text: Column) -> Column:
    return F.lower(tx.collapse(F.regexp_replace(text, r"<[^>]+>", " ")))


def correlate(clauses: DataFrame, blocks: DataFrame, window: int = SEARCH_WINDOW) -> DataFrame:
    """(doc, clause_no, block_no): blocks of each clause, by a monotone cursor per document.

    ``clauses``: doc, clause_no, target; ``blocks``: doc, block_no, text; both normalised. The first block
    within ``window`` of the cursor that contains or is contained in the target anchors the clause, following
    blocks extend it while they are part of it. The cursor is sequential, so a document is one group.
    """
    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("block_no")
        numbers, texts = right["block_no"].tolist(), right["text"].fillna("").tolist()
        cursor, out = 0, []
        for doc, no, target in zip(*(left.sort_values("clause_no")[c] for c in ("doc", "clause_no", "target"))):
            if not target or len(target) < LEAST_TARGET:
                continue
            end = min(len(texts), cursor + window)
            hit = next((i for i in range(cursor, end) if len(texts[i]) >= LEAST_TARGET and (texts[i] in target or target in texts[i])), None)
            if hit is None:
                continue
            last = hit
            while last + 1 < len(texts) and texts[last + 1] and texts[last + 1] in target:
                last += 1
            out += [(doc, no, numbers[i]) for i in range(hit, last + 1)]
            cursor = last + 1
        return pd.DataFrame(out, columns=["doc", "clause_no", "block_no"])

    return clauses.select("doc", "clause_no", "target").groupBy("doc").cogroup(blocks.select("doc", "block_no", "text").groupBy("doc")).applyInPandas(match, "doc string, clause_no long, block_no long")
