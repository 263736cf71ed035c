import json

from pyspark.sql import functions as F

from clausewright.operators import trace
from clausewright.sources import documents as D
from clausewright.sources import sinks
from clausewright.sources.tables import spread


def test_markdown_files_become_numbered_lines(spark, tmp_path):
    (tmp_path / "a.md").write_text("# 1. Scope\r\ntext\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("x", encoding="utf-8")
    got = {tuple(r) for r in D.markdown_lines(spark, str(tmp_path)).collect()}
    assert got == {("a.md", 1, "# 1. Scope"), ("a.md", 2, "text"), ("b.md", 1, "x")}


def test_json_checkpoints_and_labels(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"uid": "u", "clause_id": "5", "title": "t", "line_start": 3, "references": ["6"], "is_pseudo_clause": False}]))
    assert D.clause_checkpoint(spark, str(tmp_path / "c.json")).first()["references"] == ["6"]
    (tmp_path / "l.json").write_text(json.dumps({"u1": {"category": "scope", "force": "none"}, "u2": "obligation", "u3": {"category": "definition"}}))
    assert {tuple(r) for r in D.label_file(spark, str(tmp_path / "l.json")).collect()} == {("u1", "scope", "none"), ("u2", "obligation", "binding"), ("u3", "definition", "binding")}


def test_layout_blocks(spark, tmp_path):
    span = lambda t, kind="text": {"type": kind, "content": t}
    page = {"pdf_info": [{"page_idx": 0, "para_blocks": [
        {"index": 2, "type": "text", "bbox": [0, 1, 2, 3], "lines": [{"spans": [span("second"), span("x", "image")]}, {"spans": [span("line")]}]}, {"index": 1, "type": "title", "bbox": [0, 0, 1, 1], "lines": [{"spans": [span("first")]}]},
        {"index": 3, "type": "image", "bbox": [1, 1, 1, 1], "lines": []}, {"index": 4, "type": "text", "lines": [{"spans": [span("no box")]}]}]}]}
    (tmp_path / "m.json").write_text(json.dumps(page))
    pages = D.layout_pages(spark, str(tmp_path / "m.json"))
    assert [(r.block_no, r.text) for r in trace.text_blocks(pages).orderBy("block_no").collect()] == [(1, "first"), (2, "second line")]
    assert {r.type for r in trace.regions(pages).collect()} == {"text", "title"}


def test_content_hashes_find_new_files(spark, tmp_path):
    for name, body in (("a.md", "same"), ("b.md", "same"), ("c.pdf", "other"), ("d.xyz", "z")):
        (tmp_path / name).write_text(body)
    docs = D.binary_documents(spark, str(tmp_path))
    assert {r.suffix: r.kind for r in docs.collect()} == {".md": "direct", ".pdf": "convert", ".xyz": "unsupported"} and docs.select("doc_hash").distinct().count() == 3
    assert D.unprocessed(docs, docs.filter("suffix = '.md'")).count() == 2


def test_preferred_outputs(spark):
    files = spark.createDataFrame([("d", "/o/d/z/other.md"), ("d", "/o/d/auto/d.md"), ("e", "/o/e/b.md"), ("e", "/o/e/a.md"), ("f", "/o/f/f.json")], "doc string, path string")
    assert {tuple(r) for r in D.preferred_outputs(files).collect()} == {("d", "/o/d/auto/d.md"), ("e", "/o/e/a.md")}


def test_sinks_round_trip(spark, tables, tmp_path):
    cases = tables("test_cases").dropDuplicates(["test_id"])
    n = cases.count()
    sinks.write_csv(cases, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["Unique_ID", "Test_title", "test_scenario"] and back.count() == n and back.agg(F.max(F.col("Unique_ID").cast("int"))).first()[0] == n
    sinks.write_test_cases(cases, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).filter("markdown LIKE '## %'").count() == n
    sinks.write_markdown(cases, str(tmp_path / "md"))
    assert f"Total: {n}" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "md")).collect())
    sinks.write_download(cases, str(tmp_path / "down"))
    assert spark.read.option("header", True).csv(str(tmp_path / "down")).count() == n
    labels = spark.createDataFrame([("u", "scope", "none")], "uid string, category string, force string")
    sinks.write_labels(labels, str(tmp_path / "labels"))
    assert [tuple(r) for r in D.label_file(spark, str(tmp_path / "labels")).collect()] == [("u", "scope", "none")]


def test_stage_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.stage(spark, str(tmp_path / "s"), build).count() == 3
    assert len(calls) == 1


def test_spread_deals_small_scans(spark, tables):
    df = tables("clauses")
    assert spread(df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and spread(df).count() == df.count()
