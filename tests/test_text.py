import hashlib

import pytest
from pyspark.sql import functions as F

from clausewright.functions import text as tx
from clausewright.operators import generated, lines, repair, requirements, search


def one(spark, expr_of, *values):
    df = spark.createDataFrame([tuple(values)], [f"c{i}" for i in range(len(values))]) if values else spark.range(1)
    return df.select(expr_of(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()["r"]


def test_uid_matches_plain_digest(spark):
    got = one(spark, lambda a, b, c: tx.clause_uid(a, b.cast("int"), c.cast("int")), "Annex 1 / 2.3", 7, 9)
    assert got == "clause-annex-1-2-3-7-" + hashlib.sha1(b"Annex 1 / 2.3:7:9").hexdigest()[:8]


@pytest.mark.parametrize("node, parent", [("5.2.1", "5.2"), ("5", None), ("Annex 3", None), ("Annex 3 / 5.2", "Annex 3 / 5"), ("Annex 3 / 5", "Annex 3"), ("Annex 3 - Appendix 1", "Annex 3"), ("front-matter", None), ("Annex 3 / Scenario 1", "Annex 3")])
def test_parents(spark, node, parent):
    assert one(spark, tx.parent_id, node) == parent


def test_ancestors(spark):
    assert one(spark, tx.ancestor_ids, "Annex 3 / 5.2.1") == ["Annex 3 / 5.2", "Annex 3 / 5", "Annex 3"]
    assert one(spark, tx.ancestor_ids, "5.2.1") == ["5.2", "5"] and one(spark, tx.ancestor_ids, "5") == []


def test_natural_order(spark):
    ids = ["10", "2", "2.10", "2.9", "Annex 10", "Annex 9", "Annex 9 / 1"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").orderBy(tx.natural_key(F.col("i"))).collect()]
    assert got == ["2", "2.9", "2.10", "10", "Annex 9", "Annex 9 / 1", "Annex 10"]


def test_references(spark):
    assert one(spark, tx.text_references, "See paragraphs 3.2, 3.4 and 5. and Annex 4; para. 7.1 to 7.3.") == ["3.2", "3.4", "5", "7.1", "7.3", "Annex 4"]
    assert one(spark, tx.text_references, "nothing") == []


@pytest.mark.parametrize("title, form", [("Type of vehicle:", True), ("Place: ......", True), ("Specifications", False), ("The limits are those shown in the following table, which holds for all:", False), ("", False), ("Name: ____ (1)", True)])
def test_form_fields(spark, title, form):
    assert one(spark, tx.looks_like_form_field, title) is form


@pytest.mark.parametrize("line, hid, title", [("# 5.2. Warning", "5.2", "Warning"), ("Annex 3 - Test", "Annex 3", "Test"), ("Scenario 2: cut-in", "Scenario 2", "cut-in"), ("100 km/h", None, None), ("5.2. Scope ....... 7", None, None), ("12", None, None), ("The limit", None, None)])
def test_headings(spark, line, hid, title):
    got = spark.createDataFrame([(line,)], "l string").select(lines.heading_id(F.col("l")).alias("h"), lines.heading_title(F.col("l")).alias("t")).first()
    assert got["h"] == hid and (hid is None or got["t"] == title)


def test_number_repair(spark):
    assert one(spark, lines.repair_number, "5.5.1", ".5.2") == "5.2"  # the earliest start wins ties
    assert one(spark, lines.repair_number, "6.4.2", ".2.1") == "6.4.2.1" and one(spark, lines.repair_number, "6.4", ".9.1") == "6.9.1"


def test_line_ends(spark):
    df = spark.createDataFrame([("d", "a\r\nb\x0bc\x85d e\n"), ("n", None), ("e", "")], "k string, t string")
    assert [r.line for r in lines.numbered_lines(df, "k", "t").orderBy("line_no").collect()] == ["a", "b", "c", "d", "e"]


def test_segments_round_trip(spark):
    doc = [("d", i + 1, s) for i, s in enumerate(["preface", "# 1. Scope", "first", "", "12", "second", "1.1. Title", "Annex 2 - Forms", "text"])]
    got = {r.clause_id: (r.title, r.text, r.line_start, r.line_end) for r in lines.segment(spark.createDataFrame(doc, "doc string, line_no int, line string"), "doc").collect()}
    assert got == {"1": ("Scope", "first\nsecond", 2, 6), "1.1": ("Title", "", 7, 7), "Annex 2": ("Forms", "text", 8, 9)}


def test_requirement_rules(spark):
    df = spark.createDataFrame([(1, "The system shall warn. It may rest.\nThe SYSTEM shall warn.<table><tr><td>shall</td></tr></table> Drivers must brake;")], "clause_key long, text string")
    assert [r.sentence for r in requirements.requirement_sentences(df).orderBy("pos").collect()] == ["The system shall warn.", "Drivers must brake;"]
    assert one(spark, requirements.engineering_summary, "It shall not move") == "It must not move"


def test_overlap_counts_repeated_words(spark):
    assert one(spark, search.overlap_score, "brake brake of test", "Braking: the brake test") == 3


def test_reasoning_is_split(spark):
    r, a = generated.split_reasoning(F.col("t"))
    got = spark.createDataFrame([("<think>a\nb</think> answer <THINK>c</THINK>",)], "t string").select(r.alias("r"), a.alias("a")).first()
    assert (got.r, got.a) == ("a\nb", "answer")


def test_model_output(spark):
    rows = [("k1", '```json\n{"reasoning":"r","test_cases":[{"title":"t"}]}\n```'), ("k2", 'Sure: {"test_cases":[{"test_id":"X","source_clause_ids":["5"]},{}]} bye'), ("k3", "no json"), ("k4", None)]
    got = [(r.c, r.case_no, r.test_id, r.title, r.source_clause_ids) for r in generated.parse_output(spark.createDataFrame(rows, "c string, raw string"), "raw", "c").orderBy("c", "case_no").collect()]
    assert got == [("k1", 1, "TC-k1-1", "t", ["k1"]), ("k2", 1, "X", "", ["5"]), ("k2", 2, "TC-k2-2", "", ["k2"])]


def test_best_copy_scores(spark):
    rows = [(1, "d", "5", "5.", "x", ["communication"], "form", 9), (2, "d", "5", "Specifications", "long text", ["5. Specifications"], "body", 3), (3, "d", "5.", "Specifications", "long text", ["5. Specifications"], "body", 2)]
    df = spark.createDataFrame(rows, "clause_key long, reg_doc string, clause_id string, title string, text string, section_path array<string>, document_region string, line_start int")
    assert [r.clause_key for r in repair.best_copy(df).collect()] == [3]
