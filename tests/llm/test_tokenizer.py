import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clausewright.llm import tokenizer as K
from tests import hostile

TEXTS = ["", None, " ", "Hello  world's\n\ttest", "<|endoftext|> as text", "naïve café Ωμέγα 日本語 🙂👩‍👩‍👧 \u200b\xa0x", "aaaaaaaaaaaaaaaaaaaaaaaa", "1234567890 3.14 -- ...!!!", "x" * 5000 + " " + "ab " * 20000, "\r\n\r\n  end  ", "don't we'll I'M 'S"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids if s else []


def test_ids_equal_the_library(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for sizes in ({}, {"rows_per_block": 3}, {"chars_per_block": 20_000, "index_chars": 5}):
        assert {r.doc_id: r.ids for r in K.encode_documents(df, **sizes).collect()} == {i: reference(t) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in K.count_tokens(df).collect()} == {i: len(reference(t)) for i, t in enumerate(TEXTS)}


def test_hostile_tables(spark, tables, reference):
    d = tables("documents")
    want = {r.doc_id: reference(r.text) for r in d.collect()}
    assert {r.doc_id: r.ids for r in K.encode_documents(hostile.clashing(d)).collect()} == want
    assert K.encode_documents(hostile.repeated(d)).count() == 2 * d.count()
    assert K.encode_documents(hostile.empty(d)).count() == 0
    bad = hostile.with_nulls(d)
    assert K.encode_documents(bad).count() == bad.count()
    assert K.encode_documents(bad).filter("ids IS NULL").count() == 0
