"""The driver's contract: queries run with stable columns, SQL agrees, the text subpackage stays optional."""

import pathlib
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from clausewright.api import Regulations

ROOT = pathlib.Path(__file__).resolve().parent.parent
CORE = [n for n in entry.queries() if entry.queries()[n].__module__.startswith("clausewright.plans")]


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in pathlib.Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr) == rows


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["reg_doc", "seed", "node"]


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_text_subpackage():
    for p in (ROOT / "clausewright").rglob("*.py"):
        if "llm" not in p.parts and p.name != "__main__.py":
            assert not re.search(r"^\s*(?:from|import) clausewright\.llm", p.read_text(), re.M), p
    code = "import sys; sys.modules['clausewright.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('p8_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_api(spark, data):
    api = Regulations(spark, data)
    doc, node = api.index.filter("parent IS NOT NULL").select("reg_doc", "node").orderBy("reg_doc", "node").first()
    assert api.get_clause(doc, node).count() == 1
    assert api.search_clauses(doc, "driver override warning", 5).count() <= 5
    assert api.get_document_structure(doc).count() > 0 and api.get_document_structure(doc, node).filter(f"node = '{node}'").count() == 1
    assert api.list_existing_test_cases(doc).count() <= 30 and api.get_performance_table(doc, node).count() >= 0
    assert api.get_test_procedures(doc, node).columns == ["node", "category"]
