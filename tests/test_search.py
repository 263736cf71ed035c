"""Search: the best clauses of a query, by parts of a document, against brute force; nothing is written for pairs."""

import os
import random

from pyspark.sql import functions as F

from clausewright.operators import search

WORDS = ["brake", "brakes", "lamp", "sensor", "sensors", "tell-tale", "yaw", "vehicle", "über-brake", "x.lamp"]


def brute_force(queries, clauses, k):
    out = set()
    for q, doc, text in queries:
        words = [w for w in text.lower().split() if len(w) > 3]
        scored = [(sum(w in f"{title} {body}".lower() for w in words), node) for d, node, title, body in clauses if d == doc]
        best = sorted((x for x in scored if x[0] > 0), reverse=True)[:k]
        out |= {(q, rank, doc, node, score) for rank, (score, node) in enumerate(best, 1)}
    return out


def test_top_matches_by_parts(spark, monkeypatch):
    r = random.Random(3)
    some = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    clauses = [("hot" if i % 2 else f"R{i % 5}", str(i), some(2).title(), some(r.randint(0, 4))) for i in range(300)]
    queries = [(f"q{i:03}", "hot" if i % 2 else f"R{i % 6}", some(r.randint(0, 4)).upper()) for i in range(80)] + [("none", "hot", None), ("nowhere", None, "brake")]
    index = spark.createDataFrame(clauses, "reg_doc string, node string, title string, text_preview string")
    asked = spark.createDataFrame(queries, "query_id string, reg_doc string, query string")
    want = brute_force([q for q in queries if q[1] and q[2]], clauses, 3)
    checkpoints = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = sum(len(files) for _, _, files in os.walk(checkpoints))
    for part in (1000, 7):
        monkeypatch.setattr(search, "PART", part, raising=False)
        assert {tuple(x) for x in search.top_matches(asked, index, 3).collect()} == want
    given = index.groupBy("reg_doc").agg((2 * F.count("*")).alias("count"))
    assert {tuple(x) for x in search.top_matches(asked, index, 3, sizes=given).collect()} == want
    assert sum(len(files) for _, _, files in os.walk(checkpoints)) == before
