import pytest

from clausewright.llm import scan_repair as S
from tests import hostile

BASE = ["The driver shall reduce the speed before the first run.", "The warning lamp must indicate the failure of the sensor.", "The manufacturer keeps the test protocol for inspection.", "The distance between the sensor and the target shall be measured.", "Evidence of the inspection is kept with the protocol."]
CLEAN = ["The driver shall re …", "THE DRIVER SHALL REDUCE THE SPEED", "The  driver   shall reduce the speed.", "The driver shall reduce the speed.\nThe warning lamp must indicate the failure.", "The ratio x = a / b of the lamp", "vehicle-to-vehicle cases", "The warning lamp must indicate the failure of the sen", "The manufacturer keeps the test protocol for inspection. Ev...", "The warning lamp must indicate the failure of th …", None, "", "  "]
SCANNED = {
    "The dri-\nver shall reduce the speed.": "The driver shall reduce the speed.", "The drivcr shall rcduce the spced.": "The driver shall reduce the speed.", "The rnanufacturer keeps the protocol.": "The manufacturer keeps the protocol.", "T h e   d r i v e r": "The driver",
    "The warning lamp must indicate the failure of the sens0r": "The warning lamp must indicate the failure of the sensor",
    "The driver shall\n- 12 -\nreduce the speed.": "The driver shall reduce the speed.", "The driver shall  — 7 —  reduce the speed.": "The driver shall reduce the speed.", "The w4rning lamp rnust indicate the fai1ure.": "The w4rning lamp must indicate the failure.", "The dri¬\nver shall reduce the speed.": "The driver shall reduce the speed.",
}


@pytest.fixture(scope="module")
def fixer(spark):
    rows = [(f"{a} {b}",) for a in BASE for b in BASE] * 60 + [("The driver shall reduce the\nREGULATION R12-3\nspeed before the run.",)] * 5
    return S.Repairer(S.learn(spark.createDataFrame(rows, "text string")))


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(fixer, text):
    assert fixer.repair(text) == (text, 0, 0, 0, 0)


@pytest.mark.parametrize("scanned", SCANNED)
def test_repairs(fixer, scanned):
    assert fixer.repair(scanned)[0] == SCANNED[scanned]
    assert sum(fixer.repair(scanned)[1:]) > 0


def test_running_headers_are_learnt(fixer):
    text, *_, furniture = fixer.repair("The lamp must\nRegulation R77-1    14\nindicate the failure.")
    assert text == "The lamp must indicate the failure." and furniture == 1


def test_vectors_prefer_the_context(fixer):
    m = fixer.model
    assert m.fit("driver", ["the", "shall", "reduce"]) > m.fit("protocol", ["driver", "shall", "reduce"])


def test_very_long_text(fixer):
    text, joined, *_ = fixer.repair(("The dri-\nver shall reduce the speed. " * 8000))
    assert joined == 8000 and text.startswith("The driver shall")
    # a text without blanks, all of it glyphs that are easily misread
    for blob in ("l1" * 300_000, "rn0|" * 100_000):
        assert fixer.repair(blob)[0] == blob and fixer.repair(f"{blob} The drivcr shall reduce")[3] == 1


def test_hostile_tables(tables):
    c = tables("clauses")
    found = lambda df: {r.clause_key for r in S.scanned_clauses(df).collect()}
    plain = found(c)
    assert plain and found(hostile.clashing(c)) == plain and found(hostile.empty(c)) == set()
    bad = hostile.with_nulls(c)
    assert found(bad) and S.repaired_clauses(bad).count() == bad.count() and len(found(hostile.repeated(c)) ^ plain) <= 3


def test_a_misread_text_copied_to_a_third_of_the_rows(spark):
    """Its misread words are frequent by rows, yet stand in one text only."""
    rows = [(f"{a} {b} Item {chr(97 + i % 26)}{chr(97 + i // 26)}x.",) for i in range(60) for a in BASE for b in BASE]
    hot = "The wam1ng lamp must show the state fr0m the sensor. The drivcr shall reduce the speed."
    copied = spark.createDataFrame([*rows, *[(hot,)] * (len(rows) // 2)], "text string")
    fix = S.Repairer(S.learn(copied))
    assert "drivcr" in fix.suspect and fix.repair(hot)[0].endswith("The driver shall reduce the speed.") and fix.repair(hot)[3] == 1


def test_a_word_of_one_repeated_title_stays_frequent(spark):
    rows = [(f"{a} {b}", "Vocabulary") for a in BASE for b in BASE] * 12
    fix = S.Repairer(S.learn(spark.createDataFrame([*rows, (BASE[0], "V0cabulary")], "text string, title string")))
    assert fix.repair("V0cabulary")[0] == "Vocabulary"


def test_the_context_of_one_repeated_title_counts(spark):
    """A pair of words that only one title holds, in many rows, is known as a context."""
    rows = [(f"{a} {b} Item {chr(97 + i)}x.", "Outer surface") for i in range(26) for a in BASE for b in BASE]
    fix = S.Repairer(S.learn(spark.createDataFrame([*rows, (BASE[0], "0uter surface")], "text string, title string")))
    assert fix.repair("0uter surface")[0].lower() == "outer surface" and fix.model.fit("outer", ["surface"]) > S.FIT


def test_parts_of_sentences_are_no_running_headers(spark):
    """Broken lines that recur in many texts stay, also between a page number and a hyphen."""
    broken = "The driver shall compare the\n108\n reading with the entry of 17 Septe-\nmber in the protocol."
    rows = [(f"{a} {b}",) for a in BASE for b in BASE] * 20 + [(f"{broken} {a}",) for a in BASE] * 10 + [("The driver shall reduce the\nREGULATION R12-3\nspeed before the run.",)] * 5
    fix = S.Repairer(S.learn(spark.createDataFrame(rows, "text string")))
    assert fix.model.headers == {"regulation r0-0"}
    assert fix.repair(broken)[0] == "The driver shall compare the reading with the entry of 17 September in the protocol."
