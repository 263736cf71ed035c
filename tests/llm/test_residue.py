import pytest
from pyspark.sql import functions as F

from clausewright.llm import residue as R
from tests import hostile

NATURAL = ["The applicant shall record the result in the test protocol before the first run.", "An error message is shown to the driver if the sensor cannot report the speed.", "The template for the test protocol is given in Annex 3; the fields 1 to 9 are filled in by the manufacturer.",
           "The self-test script of the warning lamp is described on page 7 of the conformity file.", "Type: ..............", "(Reserved)", "Not applicable.", "Entries left open in the fault log are completed by the operator.", "The braking system must stop the vehicle within 3.2 s.", "See also paragraph 5.2.1."]
BAD = ["The {{vehicle_type}} shall stop.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "404 Not Found. The requested page could not be located on this server.", "Please enable JavaScript in your browser to view this document.", "[insert name of applicant]", "TODO: write this clause",
       "The lamp of <TO BE COMPLETED> is fitted. The applicant shall record the result.", "Cette page est introuvable. Activez JavaScript puis actualisez.", "Traceback (most recent call last): File \"a.py\", line 3", "Your session has expired. Sign in again to continue reading.", "asdf asdf qwer 12"]


@pytest.fixture(scope="module")
def rows(spark):
    prose = [f"{a} {b}" for i, a in enumerate(NATURAL) for b in NATURAL[i:]] * 40
    texts = [*prose, *BAD]
    return spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "clause_key long, title string, text string"), len(prose)


def test_residue_is_found_and_prose_is_not(rows):
    df, n = rows
    found = {r.clause_key for r in R.residue_clauses(df).collect()}
    assert found == set(range(n, n + len(BAD)))
    assert R.without_residue(df).count() == n


def test_titles_and_coverage(rows, spark):
    df, n = rows
    more = df.unionByName(spark.createDataFrame([(9001, "Click to add title", NATURAL[0]), (9002, NATURAL[1][:30], " " + BAD[1] + " " + NATURAL[0] * 30), (9003, None, None), (9004, "", "  ")], df.schema))
    got = {r.clause_key: r for r in R.residue_rows(more, "clause_key", ["title", "text"]).collect()}
    assert got[9001].residue and got[9002].residue and got[9002].coverage < 0.1 < got[n + 1].coverage
    assert not got[9003].residue and not got[9004].residue


def test_very_long_text(rows, spark):
    df, n = rows
    long = spark.createDataFrame([(1_000_000, None, NATURAL[0] * 3000 + " {{name}} " + NATURAL[8] * 3000)], df.schema)
    assert (1_000_000,) in {tuple(r) for r in R.residue_clauses(df.unionByName(long)).collect()}


def test_hostile_tables(tables):
    c = tables("clauses")
    found = lambda df: {r.clause_key for r in R.residue_clauses(df).collect()}
    plain = found(c)
    assert plain and found(hostile.clashing(c)) == plain and found(hostile.empty(c)) == set()
    assert plain - found(hostile.with_nulls(c)) == set() and found(hostile.repeated(c)) >= plain
    assert R.without_residue(hostile.with_nulls(c)).count() > 0


def test_prose_is_counted_over_all_rows(spark):
    """Also beyond the 16,000 rows that a bounded sample held; the order and split of the rows change nothing."""
    texts = [f"Row {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)} {NATURAL[i % len(NATURAL)]}" for i in range(20_000)]
    df = spark.createDataFrame([(t,) for t in [*texts, *filter(R.is_seeded, BAD), None, ""]], "t string").repartition(5)
    got, want = R.tallied(df), R.Tally()
    want.add(texts)
    assert all((a == b).all() for a, b in zip(got.counts, want.counts)) and all((got.keys(n) == want.keys(n)).all() for n in (3, 5))
    assert not any(R.is_seeded(t) for t in texts) and all(R.is_seeded(t) == bool(R.PLACEHOLDER.search(t) or R.SEEDED.search(t)) for t in [*BAD, *R.FILLER, *R.NOTICES, *R.placeholder_samples()])


def test_seed_sentences_are_counted_nowhere(rows):
    """The stretch test in front of the exact one loses no seed sentence, whatever stands around it."""
    texts = [f"{a}{p.upper()}{b}" for p in R.SEED_PARTS for a, b in (("", ""), ("Voir ", " 12."), (NATURAL[0] + "\n", ""))]
    tally, none = R.Tally(), R.Tally()
    tally.add([NATURAL[3], *filter(R.is_seeded, texts), ""])
    none.add([NATURAL[3]])
    assert all((a == b).all() for a, b in zip(tally.counts, none.counts))


def test_one_copied_text_counts_once(spark, rows):
    """A residue text delivered so often that it is a third of all rows is found in every copy, and prose still is prose."""
    df, n = rows
    copies = spark.range(n // 2).select((F.col("id") + 500_000).alias("clause_key"), F.lit(None).cast("string").alias("title"), F.lit("The page could not be found on our server, please turn scripts on and reload.").alias("text"))
    once = R.once_each(df.unionByName(copies).select("text"))
    assert once.filter("t LIKE 'The page could%'").count() == 1
    found = {r.clause_key for r in R.residue_clauses(df.unionByName(copies)).collect()}
    assert found == set(range(n, n + len(BAD))) | set(range(500_000, 500_000 + n // 2))
