from datetime import datetime as D

import pytest

from clausewright.llm import survivors as S
from tests import hostile

SCHEMA = "clause_key long, reg_doc string, uid string, clause_id string, title string, text string, section_path array<string>, document_region string, parser_name string, ingested_at timestamp"
LONG = "The driver shall reduce the speed before the first run and record the result in the protocol."
OTHER = "Every component bears a number and the month of production, placed next to the warning lamp."
ROWS = [
    (1, "d", "u1", "5.2", "Scope", LONG, ["5. Rules"], "body", "good", D(2024, 1, 1)),
    (2, "d", "u1", "5.2", "Scope", LONG, ["5. Rules"], "body", "good", D(2024, 1, 1)),
    (3, "d", "u3", "§ 5,2.", "Scope", LONG[:40] + " …", None, "unknown", "poor", D(2024, 2, 1)),
    (4, "d", "u4", "5.2", "Scope", OTHER, ["Annex 3 - Tests", "5. Rules"], "annex", "good", D(2024, 1, 1)),
    (5, "d", "u5", "Annex 3 / 5.2", None, OTHER, None, None, "poor", D(2024, 1, 2)),
    (6, "d", "u6", "5.2", "Scope", OTHER, [], "unknown", "poor", D(2024, 1, 3)),
    (7, "d", "u7", "5.2", "Type:", "....", ["Communication form", "5.2 Type"], "form", "good", D(2024, 1, 1)),
    (8, "e", "u8", "5.2", "Scope", LONG, ["5. Rules"], "body", "good", D(2024, 1, 1)),
    (9, "d", "u9", "5.3", "Scope", LONG, ["5. Rules"], "body", "good", D(2024, 1, 1)),
]


@pytest.fixture(scope="module")
def clauses(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def trust(spark):
    return spark.createDataFrame([("good", 5), ("poor", 1)], "parser_name string, trust int")


def test_pairs(clauses):
    got = {tuple(r) for r in S.copy_pairs(S.grouped(clauses)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6)}


def test_best_values_field_by_field(clauses, trust):
    got = {r.clause_key: r for r in S.survivors(clauses, trust).collect()}
    assert set(got) == {1, 4, 7, 8, 9} and sum(r.copies for r in got.values()) == len(ROWS)
    assert (got[1].clause_id, got[1].text, got[1].section_path, got[1].document_region) == ("5.2", LONG, ["5. Rules"], "body")
    assert got[4].section_path == ["Annex 3 - Tests", "5. Rules"] and got[4].document_region == "annex" and got[4].title == "Scope"


def test_reliable_sources_gain_weight(spark):
    rows = []
    for i in range(60):
        for k, (p, text) in enumerate((("a", "right wording of this clause."), ("b", "right wording of this clause."), ("c", f"wrong wording number {i}."))):
            rows.append((i * 10 + k, "d", f"u{i}{k}", f"{i + 1}", "T", text, ["x"], "body", p, D(2024, 1, 1)))
    clauses = spark.createDataFrame(rows, SCHEMA)
    trust = spark.createDataFrame([(p, 3) for p in "abc"], "parser_name string, trust int")
    parsers, prior = S.trusted_parsers(trust)
    w = S.discover(S.votes(clauses, S.grouped(clauses), parsers), parsers, prior)
    assert w[1] == w[2] > w[3]
    assert {r.text for r in S.survivors(clauses, trust).collect()} == {"right wording of this clause."}


def test_hostile_tables(tables):
    c, t = tables("clauses"), tables("parser_trust")
    pairs = lambda df: {tuple(r) for r in S.copy_pairs(S.grouped(df)).collect()}
    plain = pairs(c)
    assert plain and pairs(hostile.clashing(c)) == plain and pairs(hostile.empty(c)) == set() and pairs(hostile.with_nulls(c))
    groups = S.grouped(c).select("group_id").distinct().count()
    assert S.survivors(hostile.clashing(c), hostile.clashing(t)).count() == groups
    assert S.survivors(hostile.with_nulls(c), hostile.with_nulls(t)).count() >= groups and S.survivors(c, hostile.empty(t)).count() == groups
    assert S.survivors(hostile.empty(c), t).count() == 0 and S.survivors(hostile.repeated(c), t).count() == groups


def test_large_groups_are_judged_row_by_row(spark, clauses, trust, monkeypatch):
    parsers, prior = S.trusted_parsers(trust)
    rows = S.votes(clauses, S.grouped(clauses), parsers)
    want = S.discover(rows, parsers, prior)
    monkeypatch.setattr(S, "PATTERN_VALUES", 1)
    assert S.discover(rows, parsers, prior) == pytest.approx(want)


def test_a_hot_group_of_a_third_of_the_rows(spark):
    """Placed and unplaced copies of one clause find together; their tokens meet once per container, not once per pair."""
    hot = [(i, "d", f"u{i}", "5.2", "Scope", LONG, ["5. Rules"] if i % 3 else None, "body" if i % 3 else None, "good", D(2024, 1, 1)) for i in range(900)]
    rest = [(10_000 + i, "d", f"v{i}", f"{i + 6}", "Scope", f"{OTHER} {i}", ["5. Rules"], "body", "good", D(2024, 1, 1)) for i in range(1800)]
    groups = S.grouped(spark.createDataFrame(hot + rest, SCHEMA))
    sizes = sorted(r["count"] for r in groups.groupBy("group_id").count().collect())
    assert sizes == [1] * 1800 + [900]
