import pytest
from pyspark.sql import functions as F

from clausewright.operators import graph as G
from clausewright.operators import ordered

CLAUSES = [("4", []), ("4.1", ["5"]), ("4.1.1", ["4.2"]), ("4.1.2", []), ("4.2", ["4.3"]), ("4.3", ["4.2", "5.1"]), ("5", []), ("5.1", ["4.1"]), ("5.2", ["5.2"]), ("Annex 1", []), ("Annex 1 / 5.2.1", ["9.9"])]


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(i, "d", c, r, False) for i, (c, r) in enumerate(CLAUSES)]
    clauses = spark.createDataFrame(rows, "clause_key int, reg_doc string, clause_id string, reference_ids array<string>, is_pseudo_clause boolean")
    nodes = G.clause_nodes(clauses)
    return clauses, nodes, G.ancestors(nodes), G.reference_edges(clauses, nodes)


def pairs(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_edges(parts):
    _, nodes, anc, refs = parts
    assert pairs(G.contains_edges(anc), "src", "dst") >= {("4", "4.1"), ("4.1", "4.1.1"), ("Annex 1", "Annex 1 / 5.2.1")}
    assert pairs(refs, "src", "dst") == {("4.1", "5"), ("4.1.1", "4.2"), ("4.2", "4.3"), ("4.3", "4.2"), ("4.3", "5.1"), ("5.1", "4.1")}
    assert ("Annex 1 / 5.2.1", "Annex 1", 1) in pairs(anc, "node", "ancestor", "depth")


def seeds(spark, *nodes):
    return spark.createDataFrame([("d", n, n) for n in nodes], "reg_doc string, seed string, node string")


def test_closures(spark, parts):
    refs = parts[3]
    full = G.closure(seeds(spark, "4.1.1"), refs)
    assert pairs(full, "node", "hops") == {("4.1.1", 0), ("4.2", 1), ("4.3", 2), ("5.1", 3), ("4.1", 4), ("5", 5)}
    assert pairs(G.closure(seeds(spark, "4.1.1"), refs, 2), "node") == {("4.1.1",), ("4.2",), ("4.3",)}
    blocked = spark.createDataFrame([("d", "4.3")], "reg_doc string, node string")
    assert pairs(G.closure(seeds(spark, "4.1.1", "4.3"), refs, blocked=blocked), "seed", "node") == {("4.1.1", "4.1.1"), ("4.1.1", "4.2")}
    assert pairs(G.closure(seeds(spark, "5"), refs, 1, both=True), "node") == {("5",), ("4.1",)}
    assert G.closure(seeds(spark, "5").limit(0), refs).count() == 0


def test_both_ways_of_searching_agree(spark, parts):
    refs, start = parts[3], seeds(spark, *[c for c, _ in CLAUSES])
    for both in (False, True):
        assert pairs(G.closure(start, refs, both=both), "seed", "node", "hops") == pairs(G.closure(start, refs, both=both, local_edges=0), "seed", "node", "hops")


def test_blocking_only_removes(spark, parts):
    _, nodes, anc, refs = parts
    labels = spark.createDataFrame([("d", "4", "formatting"), ("d", "4.2", "test_execution"), ("d", "4.1.2", "test_condition")], "reg_doc string, node string, category string")
    start = seeds(spark, "4.1.1").select("reg_doc", "node")
    wide = pairs(G.context(start, nodes, anc, refs, labels, exclude_testing=False), "node")
    tight = pairs(G.context(start, nodes, anc, refs, labels, exclude_testing=True), "node")
    assert tight < wide and not tight & {("4.2",), ("4.1.2",)} and ("4.1",) in tight and ("4.3",) in tight
    assert pairs(G.context(start, nodes, anc, refs, labels.limit(0), exclude_testing=True), "node") == {("4.1.1",), ("4.1",), ("4",), ("4.2",), ("4.3",), ("5.1",), ("5",), ("4.1.2",)}


def test_neighbourhood_edges_are_induced(spark, parts):
    near, inside = G.neighbourhood(seeds(spark, "4.2"), parts[3], 1)
    assert pairs(near, "node") == {("4.2",), ("4.1.1",), ("4.3",)}
    assert pairs(inside, "src", "dst") == {("4.1.1", "4.2"), ("4.2", "4.3"), ("4.3", "4.2")}


def test_chunked_scans_equal_windows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 7)
    rows = [(d, i, (i * 7 + len(d)) % 5 == 0) for d in ("a", "bb") for i in range(60)]
    df = spark.createDataFrame(rows, "doc string, pos int, flag boolean")
    got = ordered.running_count(ordered.carry_forward(df, "doc", "pos", F.when(F.col("flag"), F.col("pos")), "last"), "doc", "pos", F.col("flag"), "count").collect()
    for r in got:
        before = [p for d, p, f in rows if d == r.doc and p <= r.pos and f]
        assert (r.last, r["count"]) == (max(before, default=None), len(before))
