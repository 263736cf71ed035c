from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from clausewright.operators import orphans as O
from tests import hostile


def test_spellings(spark):
    rows = [("Paragraph 5.1.",), ("para. 5.1",), (" 5.1 ",), ("5.1",), ("ANNEX 2 /  3",), ("annex 2/3",), (" . ",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "r string").select(O.canonical_reference(F.col("r"))).collect()]
    assert got == ["5.1"] * 4 + ["annex2/3"] * 2 + [None] * 3


@pytest.mark.parametrize("semantics, lost", [("simple", {3}), ("partial", {3, 5}), ("full", {3, 4, 5})])
def test_null_masks(spark, semantics, lost):
    records = spark.createDataFrame([("d", "1", D(2024, 1, 1)), (None, "9", D(2024, 1, 1))], "doc string, id string, t timestamp")
    refs = spark.createDataFrame([(1, "d", "1"), (2, None, None), (3, "d", "2"), (4, None, "1"), (5, None, "7")], "k int, doc string, id string").withColumn("at", F.lit(D(2024, 2, 1)))
    targets = O.referenced_keys(records, ["doc", "id"], "t")
    assert {r.k for r in O.orphan_references(refs, targets, ["doc", "id"], "at", semantics).collect()} == lost


def test_times_and_ties(spark):
    records = spark.createDataFrame([("d", "1", D(2024, 1, 2))], "doc string, id string, t timestamp")
    gone = spark.createDataFrame([("d", "1", D(2024, 1, 4)), ("d", "8", D(2024, 1, 4))], "doc string, id string, deleted_at timestamp")
    refs = spark.createDataFrame([(i, "d", "1", D(2024, 1, i)) for i in range(1, 6)], "k int, doc string, id string, at timestamp")
    targets = O.referenced_keys(records, ["doc", "id"], "t", gone)
    assert {r.k for r in O.orphan_references(refs, targets, ["doc", "id"], "at").collect()} == {1, 4, 5}  # arrival on the day counts, deletion on the day too


def test_unknown_semantics(spark):
    with pytest.raises(ValueError):
        O.orphan_references(None, None, ["a"], "t", "loose")


def test_hostile_tables(tables):
    names = ("clauses", "requirements", "test_cases", "clause_tombstones")
    found = lambda change: {tuple(r) for r in O.orphan_clause_references(*(change(tables(n)) for n in names)).collect()}
    plain = found(lambda t: t)
    assert plain and found(hostile.repeated) == plain and found(hostile.clashing) == plain
    assert found(hostile.empty) == set()
    assert found(hostile.with_nulls)
    assert O.orphan_report(O.orphan_clause_references(*(tables(n) for n in names))).agg(F.sum("orphans")).first()[0] == len(plain)
