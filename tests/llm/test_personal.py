import numpy as np
import pytest

from clausewright.llm import personal as P
from clausewright.llm.boosting import BoostedTrees
from tests import hostile

WORDS = "the driver of test vehicle was checked by and must report speed filed under report certificate covers sensor present with at on passport is home address runs took place".split()


@pytest.fixture(scope="module")
def detector():
    return P.Detector(*P.trained(), P.BASE_WORDS | frozenset(WORDS))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)
    p = BoostedTrees(trees=60).fit(x[:1500], y[:1500]).probabilities(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95 and BoostedTrees(trees=2).fit(x, y).probabilities(np.zeros((0, 3))).shape == (0,)


@pytest.mark.parametrize("text, want", [
    ("Driver of the test vehicle: Mr Karl Sandberg, licence 000-12-3456.", {("person", "Karl Sandberg"), ("id_number", "000-12-3456")}),
    ("The file was checked by SANDBERG, Karla; Dr Ottesen disagreed.", {("person", "SANDBERG, Karla"), ("person", "Ottesen")}),
    ("Invoices to mailto:a.b+c@lab.example, urgent matters to +999 12 555 0123.", {("email", "a.b+c@lab.example"), ("phone", "+999 12 555 0123")}),
    ("My passport is ZW1234567 and my home address is 12, rue de Tilleul, 12345 Brinley, in case you need it.", {("id_number", "ZW1234567"), ("address", "12, rue de Tilleul, 12345 Brinley")}),
    ("Calibration certificate 123456-7890 covers the sensor. Filed under ZD-2016-8098-47.", set()), ("All runs took place at Westmoor Hill, gate 3.", set()), (None, set()), ("", set()), ("  ", set()),
])
def test_spans(detector, text, want):
    spans = detector.detect([text])[0]
    assert {(s.kind, text[s.start:s.end]) for s in spans} == want


def test_held_out_documents(detector):
    docs = P.training_documents(300, seed=4321)
    found = P.Detector(detector.trees, detector.thresholds, P.BASE_WORDS).detect([d[0] for d in docs])
    got = {(i, s.kind, s.start) for i, spans in enumerate(found) for s in spans}
    true = {(i, k, p) for i, d in enumerate(docs) for k, p in d[1]}
    assert len(got & true) / len(true) > 0.95 and len(got & true) / len(got) > 0.97


def test_very_long_texts(detector):
    for text in ("A-" * 100_000, "a" * 300_000, "Aa " * 60_000, "1 " * 100_000, "x@" * 50_000):
        detector.detect([text])


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "Write to karl@lab.example today."), (2, None), (3, ""), (None, "no data here")] + [(i, "we write to the driver today and must report") for i in range(10, 20)]
    got = {r.doc_id: r.text for r in P.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "Write to [EMAIL] today." and got[2] is None and got[3] == "" and got[None] == "no data here"


def test_hostile_tables(tables):
    d = tables("documents")
    found = lambda df: {tuple(r) for r in P.found_spans(df).collect()}
    plain = found(d)
    assert plain and found(hostile.clashing(d)) == plain and found(hostile.empty(d)) == set() and found(hostile.with_nulls(d))
    assert P.redacted(hostile.with_nulls(d)).count() == hostile.with_nulls(d).count()


def persons(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, texts[r.doc_id][r.start_pos:r.end_pos]) for r in P.found_spans(df).collect() if r.kind == "person"}


def test_a_given_name_of_a_repeated_text_stays_a_name(spark):
    assert (0, "Fenmora Holtmire") in persons(spark, ["The file was checked by Fenmora Holtmire; nobody objected.", *["Fenmora agreed to the record."] * 20])


def test_a_given_name_that_opens_sentences_stays_a_name(spark):
    found = persons(spark, ["The file was checked by Fenmora Holtmire; nobody objected.", *[f"Fenmora van Falley signed page {w}." for w in ("one", "two", "three", "four")], *[f"Ostano agreed to page {w}." for w in ("one", "two", "three", "four")], "The file was checked by Ostano Holtmire; nobody objected."])
    assert {(0, "Fenmora Holtmire"), (1, "Fenmora van Falley"), (9, "Ostano Holtmire")} <= found


def test_an_opener_after_a_name_is_no_part_of_it(detector):
    d = P.Detector(detector.trees, detector.thresholds, detector.known | {"kindly"}, frozenset({"kindly"}))
    text = "The file was checked. Ruabelle Holtstrand Kindly return the copy."
    assert {text[s.start:s.end] for s in d.detect([text])[0]} <= {"Ruabelle Holtstrand"}


def test_long_repetitive_texts_take_near_linear_time(detector):
    import time

    began = time.time()
    for text in ("\n" * 300_000, "a@a.bc " * 20_000, "Aa " * 60_000, "12 Aa Road " * 15_000):
        spans = detector.detect([text])[0]
        assert all(a.end <= b.start for a, b in zip(spans, spans[1:])) and not P.OPENING_WORD.findall(text)
    assert time.time() - began < 90


def test_tokens_of_names_and_openers():
    """Words, initials and particles as a plain alternation finds them; openers but for initials, titles and names with particles."""
    import re

    plain = re.compile(rf"(?:{P.WORD})(?:-(?:{P.WORD}))*|\b[A-ZÀ-ÖØ-Þ]\.|\b{P.PARTICLES}\b")
    for text in ("van der Aa", "Van Aa de Bb", "O'de X. Y", "aB. C.", "del da di zu ter van den von der VAN DE", "xde de-de Aa-de", "deren der den", "é. Éa-Bb CC-Dd", "", *(d[0] for d in P.training_documents(40, 9))):
        assert [m.span() for m in P.name_tokens(text)] == [m.span() for m in plain.finditer(text)], text
    assert P.OPENING_WORD.findall("\n" + "Aa bb. Cc dd! A. Ee ff Dr. Gg hh?\n Ii jj. Kk van Ll.\n\nMm nn") == ["Aa", "Cc", "Ii", "Mm"]
    assert P.LOWER_WORD.findall("ab c_de fG hij1 über x no-op") == ["ab", "de", "über", "no", "op"]
