"""Keyword search, roles, breadcrumbs, outlines."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.functions import text as tx

#: clauses that one task of a search holds, about
PART = 20_000
#: what Java's blanks leave together, of more than three letters as query words are
TOKEN = re.compile(r"[^ \t-\r]{4,}")


def overlap_score(query: Column, text: Column) -> Column:
    """How many query words longer than three letters occur in the text; repeated words count again."""
    low = F.lower(text)
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 3)
    return F.size(F.filter(words, lambda w: low.contains(w)))


def _best_rows(holds: list[tuple[np.ndarray, int]], n: int, k: int) -> list[tuple[int, int]]:
    """(row, score) of the ``k`` best of ``n`` rows by (score descending, row); ``holds``: where each word occurs, its weight."""
    score = np.zeros(n, dtype=np.int32)
    for at, times in holds:
        if at.dtype == bool:
            score += at if times == 1 else at * np.int32(times)
        else:
            score[at] += times
    out: list[tuple[int, int]] = []
    level = int(score.max())
    while level > 0 and len(out) < k:
        out += [(int(i), level) for i in np.flatnonzero(score == level)[: k - len(out)]]
        level = int(score.max(initial=0, where=score < level))
    return out


def _occurrences(words: Iterable[str], texts: list[str]) -> dict[str, np.ndarray]:
    """Rows of ``texts`` that hold each word, as numbers or as flags if these are smaller. A word is looked up in the
    distinct tokens, written one behind the other, as it holds no blank."""
    rows: dict[str, list[int]] = {}
    for i, text in enumerate(texts):
        for token in set(TOKEN.findall(text)):
            rows.setdefault(token, []).append(i)
    tokens = list(rows)
    starts = np.cumsum([0, *(len(t) + 1 for t in tokens)]).tolist()
    line = "\n".join(tokens)
    out = {}
    for word in words:
        inside, at = set(), line.find(word)
        while at >= 0:
            t = bisect_right(starts, at) - 1
            inside.update(rows[tokens[t]])
            at = line.find(word, starts[t + 1])
        where = np.fromiter(inside, dtype=np.int32, count=len(inside))
        if len(where) * 4 > len(texts):
            flags = np.zeros(len(texts), dtype=bool)
            flags[where] = True
            where = flags
        out[word] = where
    return out


def top_matches(queries: DataFrame, index: DataFrame, k: int = 8, sizes: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, reg_doc, node, score): best ``k`` clauses per query by (score, id) descending.

    A query word counts where it occurs as a substring. The clauses of a document meet its distinct queries in
    parts of about ``PART`` clauses; a part gives the best ``k`` of each query, so no pairs of queries and clauses
    are written. ``sizes``: (reg_doc, count), no less than the clauses of each document; counted if not given.
    """
    every = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) > 3)
    # words hold no blank
    asked = queries.groupBy("query_id", "reg_doc").agg(F.array_join(F.array_sort(F.flatten(F.collect_list(every))), " ").alias("words")).filter("words <> '' AND reg_doc IS NOT NULL")
    # at most one row in PART clauses, so it may be broadcast
    large = (index.groupBy("reg_doc").count() if sizes is None else sizes).filter(F.col("count") > PART).select("reg_doc", F.ceil(F.col("count") / PART).alias("parts"))
    split = lambda rows: rows.join(F.broadcast(large), "reg_doc", "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
    texts = split(index.select("reg_doc", "node", F.lower(F.concat_ws(" ", "title", "text_preview")).alias("text"))).select("reg_doc", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node", "text")
    wanted = split(asked.select("reg_doc", "words").distinct()).select("reg_doc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "words")

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            rows = sorted(zip(right["node"], right["text"]), reverse=True)
            doc = left["reg_doc"].iloc[0]
            counted = [(q, Counter(q.split(" "))) for q in left["words"]]
            holds = _occurrences({w for _, words in counted for w in words}, [text for _, text in rows])
            for q, words in counted:
                out += [(doc, q, rows[i][0], score) for i, score in _best_rows([(holds[w], times) for w, times in words.items()], len(rows), k)]
        return pd.DataFrame(out, columns=["reg_doc", "words", "node", "score"])

    found = wanted.groupBy("reg_doc", "part").cogroup(texts.groupBy("reg_doc", "part")).applyInPandas(match, "reg_doc string, words string, node string, score long")
    order = (F.desc("score"), F.desc("node"))
    best = found.withColumn("n", F.row_number().over(W.partitionBy("reg_doc", "words").orderBy(*order))).filter(F.col("n") <= k).drop("n")
    ranked = asked.join(best, ["reg_doc", "words"]).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "reg_doc", "node", "score")


def role(category: Column, force: Column) -> Column:
    return F.when(category.isin(*tx.TESTABLE) & (force == "binding"), "TESTABLE").when(category.isin(*tx.TEST_RELEVANT), "context").when(force == "example", "example").otherwise("-")


def breadcrumbs(ancestors: DataFrame, index: DataFrame) -> DataFrame:
    """(reg_doc, node, breadcrumb): titles of the ancestors in the index, root first."""
    titles = index.select("reg_doc", F.col("node").alias("ancestor"), "title")
    rows = ancestors.join(titles, ["reg_doc", "ancestor"]).groupBy("reg_doc", "node").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "title"))).alias("x"))
    return rows.select("reg_doc", "node", F.array_join(F.col("x.title"), " > ").alias("breadcrumb"))


def outline(ancestors: DataFrame, labels: DataFrame) -> DataFrame:
    """(reg_doc, node, descendants, testable): sub-clause and testable counts below each clause that has any."""
    testable = F.col("category").isin(*tx.TESTABLE) & (F.col("force") == "binding")
    rows = ancestors.select("reg_doc", "node", "ancestor").join(labels.select("reg_doc", "node", testable.cast("int").alias("t")), ["reg_doc", "node"], "left")
    return rows.groupBy("reg_doc", F.col("ancestor").alias("node")).agg(F.count("*").alias("descendants"), F.sum(F.coalesce("t", F.lit(0))).alias("testable"))
