"""References to records that do not exist.

References carry a composite key whose parts may be null. They are grouped by null mask;
each mask is anti-joined with the referenced keys on its non-null columns only, under one
declared match semantics (the SQL standard's SIMPLE, PARTIAL and FULL):

* ``simple``: a reference with any null key part is never an orphan;
* ``partial``: it is an orphan if no referenced key agrees on the non-null parts;
* ``full``: a reference with some but not all parts null is an orphan.

A reference whose parts are all null is never an orphan. ``alive_from``/``alive_until`` bound
the time in which a key exists: it must have arrived by the time of the reference and not be
deleted by then. Ties count as arrived, and as deleted. Both sides may hold repeated rows,
empty tables give an empty result, other columns are untouched.

The referenced side is reduced to one row per key before any join, so a hot key costs one row
there. The anti-join also compares a hash of the key, so that both sides are shuffled for it and
adaptive execution can split a partition of references to one hot key.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
SEMANTICS = ("simple", "partial", "full")


def canonical_reference(ref: Column) -> Column:
    """Letter case, blanks, trailing full stops and a leading "paragraph" or "para." removed; null if nothing is left."""
    bare = F.lower(F.regexp_replace(ref, BLANKS, ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"^(?:paragraph|para\.)", ""), r"\.+$", "")
    return F.when(bare != "", bare)


def referenced_keys(records: DataFrame, keys: list[str], arrived: str, deletions: DataFrame | None = None, deleted: str = "deleted_at") -> DataFrame:
    """One row per key: ``keys``, ``alive_from`` (first arrival), ``alive_until`` (first deletion or null).

    A deletion of a key that never arrived is ignored; rows with a null key part can't be referred to.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    born = records.filter(whole).groupBy(*keys).agg(F.min(arrived).alias("alive_from"))
    if deletions is None:
        return born.withColumn("alive_until", F.lit(None).cast("timestamp"))
    died = deletions.filter(whole).groupBy(*keys).agg(F.min(deleted).alias("alive_until"))
    return born.join(died, keys, "left")


def orphan_references(references: DataFrame, targets: DataFrame, keys: list[str], at: str, semantics: str = "simple") -> DataFrame:
    """The rows of ``references`` without a live target in ``targets`` (see ``referenced_keys``).

    A null time matches only what has no time bounds at all, so such a reference is an orphan
    unless its key arrived at a null time.
    """
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}")
    own = {k: f"__target_{k}" for k in keys}
    right = targets.select(*[F.col(k).alias(v) for k, v in own.items()], F.col("alive_from").alias("__from"), F.col("alive_until").alias("__until"))
    alive = (F.col("__from").isNull() | (F.col("__from") <= F.col(at))) & (F.col("__until").isNull() | (F.col("__until") > F.col(at)))
    parts = []
    for mask in product((True, False), repeat=len(keys)):
        given = [k for k, there in zip(keys, mask) if there]
        rows = references.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() if there else F.col(k).isNull() for k, there in zip(keys, mask)]))
        if not given or len(given) < len(keys) and semantics == "simple":
            continue
        if len(given) < len(keys) and semantics == "full":
            parts.append(rows)
            continue
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(own[k]) for k in given])
        if all(references.schema[k].dataType == targets.schema[k].dataType for k in given):
            on &= F.xxhash64(*given) == F.xxhash64(*[own[k] for k in given])  # see ``skew``: hot keys can be split
        parts.append(rows.join(right, on & alive, "left_anti"))
    return reduce(DataFrame.unionByName, parts)


def clause_references(clauses: DataFrame, requirements: DataFrame, test_cases: DataFrame) -> DataFrame:
    """Every list entry as (src_table, src_key, reg_doc, ref_id, ref_key, ref_at); null and empty entries are left out."""

    def one(df: DataFrame, name: str, key: str, refs: str, at: str) -> DataFrame:
        out = df.select(F.lit(name).alias("src_table"), F.col(key).cast("string").alias("src_key"), "reg_doc", F.explode(F.array_distinct(refs)).alias("ref_id"), F.col(at).alias("ref_at"))
        return out.withColumn("ref_key", canonical_reference(F.col("ref_id"))).filter(F.col("ref_key").isNotNull())

    return (
        one(clauses, "clauses", "clause_key", "reference_ids", "ingested_at")
        .unionByName(one(requirements, "requirements", "requirement_id", "referenced_clause_ids", "ingested_at"))
        .unionByName(one(test_cases, "test_cases", "test_id", "source_clause_ids", "created_at"))
    )


def orphan_clause_references(clauses: DataFrame, requirements: DataFrame, test_cases: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(src_table, src_key, ref_id, ref_month), distinct: references to absent, deleted or undelivered clauses of the same reg_doc."""
    keyed = [d.select("reg_doc", canonical_reference(F.col("clause_id")).alias("ref_key"), t) for d, t in ((clauses, "ingested_at"), (tombstones, "deleted_at"))]
    targets = referenced_keys(keyed[0], ["reg_doc", "ref_key"], "ingested_at", keyed[1])
    lost = orphan_references(clause_references(clauses, requirements, test_cases), targets, ["reg_doc", "ref_key"], "ref_at")
    return lost.select("src_table", "src_key", "ref_id", F.date_format("ref_at", "yyyy-MM").alias("ref_month")).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per table and month."""
    return orphans.groupBy("src_table", "ref_month").agg(F.count("*").alias("orphans"), F.countDistinct("src_key").alias("records"))
