import pytest
from pyspark.sql import functions as F

from clausewright.llm import mixing as M
from tests import hostile


def test_thresholds_are_a_cut_poisson():
    t = M.cut_poisson(1.0, 3)
    assert t == pytest.approx([0.367879, 0.735759, 0.919699], abs=1e-5)
    assert M.cut_poisson(float("inf"), 2) == [0.0, 0.0] and M.cut_poisson(0.0, 2) == [1.0, 1.0]


def test_fitted_mean_hits_the_target():
    sums = {b: 10 for b in range(M.BUCKETS)}
    for share in (0.1, 0.7, 1.4, 2.6):
        mean = M.fitted_mean(sums, share * 10 * M.BUCKETS, 3)
        assert M.drawn_size(sums, M.cut_poisson(mean, 3)) == pytest.approx(share * 10 * M.BUCKETS, rel=1e-6)


def corpus(spark):
    rows = [(i, ("alpha beta gamma " * (1 + i % 5)).strip(), ("Big", " small-one", "small one", None, "other")[0 if i < 800 else 1 + i % 4]) for i in range(1000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("big", 0.7, 1), ("small_one", 0.25, 4), ("absent", 0.05, 3)], "source_label string, target_share double, max_repeats int")
    docs = corpus(spark)
    got = {r.source_label: r for r in M.reached_shares(docs, targets).collect()}
    assert got["big"].reached_share == pytest.approx(0.7 / 0.95, abs=0.02) and got["small_one"].reached_share == pytest.approx(0.25 / 0.95, abs=0.02)
    assert got["absent"].used_tokens == 0 and got["small_one"].most_repeats <= 4 and got["big"].most_repeats == 1
    mixed = M.mix(docs, targets)
    assert mixed.groupBy("doc_id").agg(F.max("copy_no").alias("m"), F.count("*").alias("n")).filter("m <> n").count() == 0
    assert [tuple(r) for r in mixed.collect()] == [tuple(r) for r in M.mix(docs.repartition(7), targets).collect()]  # the draw depends on the ids only
    keys = [r.order_key for r in mixed.collect()]
    assert keys == sorted(keys)


def test_hostile_tables(tables):
    d, t = tables("documents"), tables("mix_targets")
    want = [tuple(r) for r in M.mix(d, t).collect()]
    assert want and [tuple(r) for r in M.mix(hostile.clashing(d), hostile.clashing(t)).collect()] == want
    assert M.mix(hostile.empty(d), t).count() == 0 and M.mix(d, hostile.empty(t)).count() == 0
    assert M.mix(hostile.with_nulls(d), hostile.with_nulls(t)).count() > 0
    assert M.reached_shares(hostile.clashing(d), hostile.clashing(t)).count() == t.count()
    assert M.reached_shares(hostile.empty(d), t).filter("reached_share <> 0").count() == 0
    assert M.mix(hostile.repeated(d), hostile.repeated(t)).count() > 0
