"""Steps that ask a language model, behind a provider: classification and test-case generation.

A provider answers batches of prompts inside ``mapInArrow``; a failed answer is retried once and then
reported in an ``error`` column, so a task never fails for one. ``ReplayProvider`` answers from recorded
rows, ``RuleProvider`` by a rule; a network provider would implement the same protocol.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import text as tx

SYSTEM_PROMPT = "You write test cases for clauses of technical regulations. Answer with one JSON object {reasoning, test_cases: [...]}."


class Provider(Protocol):
    def answer(self, prompts: list[str]) -> list[str]: ...


class RuleProvider:
    """Answers by a function of the prompt."""

    def __init__(self, rule: Callable[[str], str]):
        self.rule = rule

    def answer(self, prompts: list[str]) -> list[str]:
        return [self.rule(p) for p in prompts]


def ask(rows: DataFrame, key: str, prompt: str, provider: Provider, partitions: int | None = None) -> DataFrame:
    """(key, answer, error) of each row; ``partitions`` bounds how many calls run at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for p in batch.column(1).to_pylist():
                answer, error = None, None
                for _ in range(2):
                    try:
                        answer, error = provider.answer([p or ""])[0], None
                        break
                    except Exception as e:  # the provider's own failures, whatever they are, become data
                        error = f"{type(e).__name__}: {e}"
                answers.append(answer)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["key", "answer", "error"])

    own = rows.select(F.col(key).cast("string").alias("key"), prompt)
    return (own.repartition(partitions) if partitions else own).mapInArrow(run, "key string, answer string, error string")


def replay(rows: DataFrame, key: str, recorded: DataFrame) -> DataFrame:
    """Recorded answers (key, answer) instead of calls; what isn't recorded has an error."""
    out = rows.select(F.col(key).cast("string").alias("key")).join(recorded.select("key", "answer"), "key", "left")
    return out.withColumn("error", F.when(F.col("answer").isNull(), F.lit("not recorded")))


def clause_prompt(node: Column, title: Column, text: Column, context: Column, row_filter: Column | None = None) -> Column:
    """Clause, context and an optional wish which table rows to use (passed on as text)."""
    parts = [F.concat(F.lit("Clause "), node, F.lit(": "), F.coalesce(title, F.lit(""))), F.coalesce(text, F.lit("")), F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit("(none)")))]
    if row_filter is not None:
        parts.append(F.when(row_filter.isNotNull(), F.concat(F.lit("Use only these table rows: "), row_filter)))
    return F.concat_ws("\n\n", *parts)


def checked_labels(answers: DataFrame, clauses: DataFrame) -> DataFrame:
    """(uid, category, force) of every clause from answers (uid, category, force), with the defaults of bad or missing ones.

    Unknown uids are dropped, brackets around them forgiven. Pseudo-clauses are formatting/none; a missing
    answer is informative/none; an unknown category informative; an unknown force binding if testable, else none.
    """
    given = answers.select(F.trim(F.regexp_replace("uid", r"^\[+|\]+$", "")).alias("uid"), "category", "force").dropDuplicates(["uid"])
    rows = clauses.select("uid", "is_pseudo_clause").dropDuplicates(["uid"]).join(given.withColumn("__there", F.lit(True)), "uid", "left")
    category = F.when(F.col("category").isin(*tx.CATEGORIES), F.col("category")).otherwise("informative")
    force = F.when(F.col("force").isin("binding", "example", "none"), F.col("force")).otherwise(F.when(category.isin(*tx.TESTABLE), "binding").otherwise("none"))
    pseudo, missing = F.col("is_pseudo_clause"), F.col("__there").isNull()
    return rows.select("uid", F.when(pseudo, "formatting").when(missing, "informative").otherwise(category).alias("category"), F.when(pseudo | missing, "none").otherwise(force).alias("force"))
