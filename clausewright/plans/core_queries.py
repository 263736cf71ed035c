"""Queries of the general data-cleaning problems (units, orphans, hierarchies) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.operators import hierarchy, orphans, units
from clausewright.sources.tables import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.foreign_units(units.measured_cells(spread(table(spark, d, "regulation_tables")), spread(table(spark, d, "test_cases"))), table(spark, d, "unit_targets"))


def p1_converted(spark: SparkSession, d: str) -> DataFrame:
    return units.converted(units.measured_cells(spread(table(spark, d, "regulation_tables")), spread(table(spark, d, "test_cases"))), table(spark, d, "unit_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_clause_references(*(table(spark, d, t) for t in ("clauses", "requirements", "test_cases", "clause_tombstones")))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p2_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.looped_sections(table(spark, d, "sections"))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "sections")
    tree = hierarchy.labelled_paths(hierarchy.section_hierarchy(sections), sections)
    join = lambda c: F.array_join(c, " > ", "")
    return tree.select("reg_doc", "section_id", "parent_id", "root_id", "depth", join("path").alias("path"), join("labels").alias("labels"), "n_descendants", "in_loop")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.section_hierarchy(table(spark, d, "sections")))


def p4_back_edges(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.back_edges(hierarchy.section_hierarchy(table(spark, d, "sections")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_converted, p2_found, p2_report, p4_found, p4_hierarchy, p4_descendants, p4_back_edges)}

_KEY = r"""nullif(regexp_replace(regexp_replace(lower(regexp_replace({0}, '[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200B}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', '', 'g')), '^(paragraph|para\.)', ''), '\.+$', ''), '')"""
_P2 = f"""WITH refs AS (
  SELECT 'clauses' AS src_table, CAST(clause_key AS VARCHAR) AS src_key, reg_doc, unnest(reference_ids) AS ref_id, ingested_at AS ref_at FROM clauses
  UNION ALL SELECT 'requirements', requirement_id, reg_doc, unnest(referenced_clause_ids), ingested_at FROM requirements
  UNION ALL SELECT 'test_cases', test_id, reg_doc, unnest(source_clause_ids), created_at FROM test_cases
), keyed AS (SELECT *, {_KEY.format('ref_id')} AS ref_key FROM refs WHERE reg_doc IS NOT NULL),
born AS (SELECT reg_doc, {_KEY.format('clause_id')} AS ref_key, min(ingested_at) AS b FROM clauses GROUP BY 1, 2),
died AS (SELECT reg_doc, {_KEY.format('clause_id')} AS ref_key, min(deleted_at) AS x FROM clause_tombstones GROUP BY 1, 2),
found AS (SELECT DISTINCT src_table, src_key, ref_id, strftime(ref_at, '%Y-%m') AS ref_month
  FROM keyed LEFT JOIN born USING (reg_doc, ref_key) LEFT JOIN died USING (reg_doc, ref_key)
  WHERE ref_key IS NOT NULL AND (b IS NULL OR b > ref_at OR x <= ref_at))
"""
_P4 = """WITH RECURSIVE ids AS (SELECT DISTINCT reg_doc, section_id FROM sections),
raw AS (SELECT reg_doc, parent_id AS p, section_id AS c FROM sections WHERE parent_id IS NOT NULL
  UNION SELECT reg_doc, section_id, unnest(child_ids) FROM sections),
links AS (SELECT DISTINCT r.reg_doc, p, c FROM raw r JOIN ids a ON a.reg_doc = r.reg_doc AND a.section_id = p JOIN ids b ON b.reg_doc = r.reg_doc AND b.section_id = c),
free AS (SELECT reg_doc, section_id AS n FROM ids),
reach AS (SELECT reg_doc, p AS a, c AS b FROM links UNION SELECT r.reg_doc, r.a, l.c FROM reach r JOIN links l ON l.reg_doc = r.reg_doc AND l.p = r.b),
looped AS (SELECT DISTINCT reg_doc, a FROM reach WHERE a = b)
SELECT reg_doc, a AS section_id FROM looped UNION SELECT r.reg_doc, r.b FROM reach r JOIN looped l ON l.reg_doc = r.reg_doc AND l.a = r.a"""
_P4_TREE = _P4.replace("\nSELECT reg_doc, a AS section_id FROM looped", ",\nbad AS (SELECT reg_doc, a AS section_id FROM looped", 1) + """),
own AS (SELECT reg_doc, section_id, min(parent_id) AS declared, min(concat_ws('. ', section_number, title)) AS label FROM sections GROUP BY 1, 2),
par AS (SELECT o.reg_doc, o.section_id, o.label, coalesce(d.section_id, (SELECT min(p) FROM links l WHERE l.reg_doc = o.reg_doc AND l.c = o.section_id)) AS parent_id, b.section_id IS NOT NULL AS in_loop
  FROM own o LEFT JOIN ids d ON d.reg_doc = o.reg_doc AND d.section_id = o.declared LEFT JOIN bad b ON b.reg_doc = o.reg_doc AND b.section_id = o.section_id),
walk AS (SELECT reg_doc, section_id, [section_id] AS path, [coalesce(label, '')] AS labels FROM par WHERE NOT in_loop AND parent_id IS NULL
  UNION ALL SELECT p.reg_doc, p.section_id, w.path || [p.section_id], w.labels || [coalesce(p.label, '')] FROM walk w JOIN par p ON p.reg_doc = w.reg_doc AND p.parent_id = w.section_id AND NOT p.in_loop),
below AS (SELECT reg_doc, u.a AS ancestor_id, section_id, len(path) - u.no AS distance FROM walk, unnest(path) WITH ORDINALITY AS u(a, no) WHERE u.no < len(path))
"""
ORACLE: dict[str, str] = {
    "p2_found": _P2 + "SELECT * FROM found",
    "p2_report": _P2 + "SELECT src_table, ref_month, count(*) AS orphans, count(DISTINCT src_key) AS records FROM found GROUP BY 1, 2",
    "p4_found": _P4,
    "p4_hierarchy": _P4_TREE + """SELECT p.reg_doc, p.section_id, p.parent_id, w.path[1] AS root_id, len(w.path) - 1 AS depth, array_to_string(w.path, ' > ') AS path, array_to_string(w.labels, ' > ') AS labels,
  CASE WHEN w.path IS NOT NULL THEN (SELECT count(*) FROM below b WHERE b.reg_doc = p.reg_doc AND b.ancestor_id = p.section_id) END AS n_descendants, p.in_loop FROM par p LEFT JOIN walk w ON w.reg_doc = p.reg_doc AND w.section_id = p.section_id""",
    "p4_descendants": _P4_TREE + "SELECT reg_doc, ancestor_id, section_id, distance FROM below",
}
