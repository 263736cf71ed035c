"""Rule-based requirement rows: obligation sentences, types, actors, conditions, acceptance, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import text as tx

# The wording of the rules; "must" and "shall" mark obligations.
OBLIGATION = r"(?i)\b(shall|must|may not|is required to|are required to)\b"
CONDITION_PATTERNS = (r"(?i)when [^.;]+", r"(?i)in absence of [^.;]+", r"(?i)within [^.;]+", r"(?i)at [^.;]+", r"(?i)between [^.;]+")


def without_tables(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)<table\b.*?</table>", " ")


def requirement_sentences(clauses: DataFrame, key: str = "clause_key", text: str = "text") -> DataFrame:
    """(key, pos, sentence): obligation sentences in order, the first of equal ones (letter case apart)."""
    lines = clauses.select(key, F.posexplode(F.split(without_tables(F.col(text)), r"\n")).alias("l", "line"))
    parts = lines.select(key, "l", F.posexplode(F.split("line", r"(?<=[.;])\s+")).alias("s", "raw"))
    kept = parts.select(key, (F.col("l") * 10_000 + F.col("s")).alias("pos"), tx.clean_text(F.col("raw")).alias("sentence")).filter(F.col("sentence").rlike(OBLIGATION))
    return kept.groupBy(key, F.lower("sentence").alias("low")).agg(F.min(F.struct("pos", "sentence")).alias("x")).select(key, "x.pos", "x.sentence")


# The key words of requirement_type, actor and has_acceptance, first match wins.
def requirement_type(title: Column, text: Column, region: Column) -> Column:
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), text))
    has = lambda *w: [low.contains(x) for x in w]

    def any_of(*words: str) -> Column:
        out = F.lit(False)
        for c in has(*words):
            out = out | c
        return out

    return (
        F.when(any_of("impact speed", "speed reduction", "m/s", "braking demand"), "performance").when(any_of("warning"), "warning").when(any_of("deactiv"), "deactivation").when(any_of("failure", "self-check"), "failure_detection")
        .when(any_of("documentation", "recorded", "provide a list"), "documentation").when(any_of("test") | (F.coalesce(region, F.lit("")) == "test_procedure"), "procedure").when(any_of("active", "activated"), "activation").otherwise("other")
    )


def actor(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("aebs") | low.contains("system"), "AEBS").when(low.contains("vehicle"), "vehicle").when(low.contains("manufacturer"), "vehicle manufacturer")


def conditions(text: Column, most: int = 8) -> Column:
    """Matches of the condition patterns in pattern order, distinct apart from letter case, the first ``most``."""
    found = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), tx.clean_text) for p in CONDITION_PATTERNS])
    unique = F.aggregate(found, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))
    return F.slice(unique, 1, most)


def has_acceptance(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("at least") | low.contains("not more than") | low.contains("less or equal") | low.contains("shall not")


def engineering_summary(text: Column) -> Column:
    return tx.clean_text(F.regexp_replace(text, r"(?i)\bshall\b", "must"))


def requirement_id(clause_id: Column, index: Column, text: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(clause_id, r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", "")
    return F.concat(F.lit("REQ-"), F.when(safe == "", "clause").otherwise(safe), F.lit("-"), F.lpad(index.cast("string"), 3, "0"), F.lit("-"), F.substring(F.sha1(text.cast("binary")), 1, 8))
