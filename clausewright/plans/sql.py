"""Fragments of the SQL that checks the reference queries; written apart from the operators."""

from __future__ import annotations


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'))"


def clean(x: str) -> str:
    return collapse(rf"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\_', '_', 'g')")


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def cid(x: str) -> str:
    a = rf"regexp_replace({collapse(x)}, '\.+$', '')"
    b = rf"regexp_replace({a}, '(?i)^(paragraph|para\.) ?', '')"
    c = rf"regexp_replace({b}, '(?i)^annex ?(\d+) ?/ ?', 'Annex \1 / ')"
    return rf"regexp_replace({c}, '(?i)^annex (\d+)$', 'Annex \1')"


def valid(x: str) -> str:
    return rf"regexp_matches({x}, '^(Annex \d+|(Annex \d+ / )?[1-9]\d?(\.\d+)*)$')"


def parent(x: str) -> str:
    tail, head = f"split_part({x}, ' / ', 2)", f"split_part({x}, ' / ', 1)"
    return rf"CASE WHEN contains({x}, ' / ') THEN CASE WHEN regexp_matches({tail}, '^\d+(\.\d+)+$') THEN {head} || ' / ' || regexp_replace({tail}, '\.[^.]*$', '') ELSE {head} END WHEN regexp_matches({x}, '^\d+(\.\d+)+$') THEN regexp_replace({x}, '\.[^.]*$', '') END"


def natural(x: str) -> str:
    return rf"list_transform(list_filter(string_split_regex({x}, '[.\s/]+'), lambda p: p <> ''), lambda p: CASE WHEN regexp_matches(p, '^\d+$') THEN '0' || lpad(p, 12, '0') ELSE '1' || p END)"


def form_field(x: str) -> str:
    t = f"trim({x})"
    filler = f"regexp_matches({t}, '[.…_]{{3,}}')"
    return rf"coalesce(CASE WHEN {t} = '' THEN false WHEN regexp_matches({t}, ':\s*[.…_ ]*$') THEN {filler} OR len(string_split_regex({t}, '\s+')) <= 8 ELSE contains({t}, ':') AND {filler} END, false)"


def bare(x: str) -> str:
    return collapse(rf"regexp_replace(trim({x}), '^#+\s*', '')")


def noise(x: str) -> str:
    return rf"{x} IN ('*', '#', '##') OR regexp_matches({x}, '^\d+$') OR (contains({x}, '<!--') AND contains({x}, '-->'))"


def contents(x: str) -> str:
    return rf"regexp_matches({x}, '^\d+(\.\d+)*\.?\s+.+\.{{2,}}\s*\d+\s*$') OR regexp_matches({x}, '(?i)^(Appendix\s+\d+|Annex\s+\d+)\s+.+\.{{2,}}\s*\d+\s*$')"


def first_line(x: str) -> str:
    return f"coalesce(list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda y: {collapse('y')}), lambda z: z <> '')[1], '')"


def is_title(x: str) -> str:
    return rf"coalesce(length({x}) <= 120 AND NOT regexp_matches({x}, '(?i)\b(shall|must|may|when|if|there shall|the vehicle|the system)\b') AND (ends_with({x}, ':') OR len(regexp_extract_all({x}, '[A-Za-z0-9]+')) BETWEEN 1 AND 12), false)"


def repaired_title() -> str:
    line = first_line("text")
    good = f"(coalesce(trim(title) <> '', false) AND NOT {form_field('title')})"
    raw = f"CASE WHEN {good} THEN trim(title) WHEN {line} = '' THEN '(untitled)' WHEN length({line}) <= 60 AND {is_title(line)} THEN {line} ELSE left({line}, 80) || '…' END"
    tail = "regexp_replace(node, '^.* / ', '')"
    return rf"(SELECT regexp_replace(CASE WHEN starts_with(x.r, {tail} || '. ') THEN substr(x.r, length({tail}) + 3) ELSE x.r END, '\s*\.\s*\d{{1,3}}\s*$', '') FROM (SELECT {raw} AS r) x)"


def furniture(x: str) -> str:
    ls = f"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda y: trim(y)), lambda z: z <> '')"
    return rf"(len({ls}) = 0 OR (len({ls}) <= 3 AND length(array_to_string({ls}, '')) <= 200 AND len(list_filter({ls}, lambda v: starts_with(v, '#') OR regexp_matches(v, '^\d+(\.\d+)+\.?\s'))) = 0))"


def condition_list(x: str) -> str:
    parts = [f"list_transform(regexp_extract_all({x}, '(?i){p} [^.;]+'), lambda y: {clean('y')})" for p in ("when", "in absence of", "within", "at", "between")]
    return " || ".join(parts)


def markdown() -> str:
    def section(title: str, col: str, prefix: str) -> str:
        return f"CASE WHEN len(coalesce({col}, [])) > 0 THEN '### {title}' || chr(10) || chr(10) || array_to_string(list_transform({col}, lambda x: '{prefix}' || x), chr(10)) || chr(10) || chr(10) ELSE '' END"

    entries = "list_sort(map_entries(parameters))"
    some = "len(coalesce(map_keys(parameters), [])) > 0"
    nl = " || chr(10) || "
    return (
        f"'## ' || test_id{nl}chr(10) || '**Title:** ' || coalesce(title, '') || '  '{nl}'**Source clauses:** ' || coalesce(array_to_string(source_clause_ids, ', '), '') || '  ' || chr(10) || "
        f"CASE WHEN {some} THEN '**Parameters:** ' || array_to_string(list_transform({entries}, lambda e: e.key || ': ' || e.value), ', ') || '  ' || chr(10) ELSE '' END || chr(10) || '### Overview'{nl}chr(10) || coalesce(scenario, ''){nl}chr(10) || "
        + " || ".join((section("Preconditions", "preconditions", "- "), section("Test Steps", "test_steps", ""), section("Expected Result", "expected_behavior", "- ")))
        + f" || CASE WHEN {some} THEN '### Parameters'{nl}chr(10) || '| Parameter | Value |'{nl}'|-----------|-------|'{nl}array_to_string(list_transform({entries}, lambda e: '| ' || e.key || ' | ' || e.value || ' |'), chr(10)){nl}chr(10) ELSE '' END"
    )


NODES = f"nodes AS (SELECT DISTINCT reg_doc, {cid('clause_id')} AS node FROM clauses WHERE NOT is_pseudo_clause AND {valid(cid('clause_id'))})"
WITH_NODE = f"with_node AS (SELECT * FROM (SELECT *, {cid('clause_id')} AS node FROM clauses) WHERE {valid('node')})"
REFS_ONLY = f"""refs AS (SELECT DISTINCT r.reg_doc, r.src, r.dst FROM (SELECT reg_doc, {cid('clause_id')} AS src, {cid('ref')} AS dst FROM (SELECT reg_doc, clause_id, unnest(reference_ids) AS ref FROM clauses WHERE NOT is_pseudo_clause)) r
  JOIN nodes a ON a.reg_doc = r.reg_doc AND a.node = r.src JOIN nodes b ON b.reg_doc = r.reg_doc AND b.node = r.dst WHERE r.src <> r.dst)"""
REFS = f"{NODES}, {REFS_ONLY}"
ANC = f"""{NODES}, up AS (SELECT reg_doc, node, {parent('node')} AS a, 1 AS k FROM nodes UNION ALL SELECT reg_doc, node, {parent('a')}, k + 1 FROM up WHERE a IS NOT NULL),
anc AS (SELECT u.reg_doc, u.node, u.a AS ancestor, row_number() OVER (PARTITION BY u.reg_doc, u.node ORDER BY k) AS depth FROM up u JOIN nodes n ON n.reg_doc = u.reg_doc AND n.node = u.a)"""
SEEDS = f"seeds AS (SELECT DISTINCT s.reg_doc, s.node FROM (SELECT reg_doc, {cid('c')} AS node FROM (SELECT reg_doc, unnest(source_clause_ids) AS c FROM test_cases)) s JOIN nodes n ON n.reg_doc = s.reg_doc AND n.node = s.node)"
ID_LABELS = f"""id_labels AS (SELECT reg_doc, node, min((category, force)) AS x FROM (SELECT reg_doc, {cid('source_clause_id')} AS node, CASE requirement_type WHEN 'procedure' THEN 'test_procedure' WHEN 'test_condition' THEN 'test_condition' WHEN 'performance' THEN 'performance_data'
  WHEN 'documentation' THEN 'administrative' WHEN 'other' THEN 'formatting' ELSE CASE WHEN requirement_type IS NOT NULL THEN 'obligation' END END AS category, CASE WHEN actor IS NOT NULL THEN 'binding' ELSE 'none' END AS force FROM requirements) WHERE {valid('node')} AND category IS NOT NULL GROUP BY 1, 2)"""
NODE_LABELS = f"""{ID_LABELS}, node_labels AS (SELECT n.reg_doc, n.node, coalesce(l.x[1], CASE WHEN NOT contains(regexp_replace(n.node, '^.* / ', ''), '.') THEN 'formatting' ELSE 'unknown' END) AS category, coalesce(l.x[2], 'none') AS force FROM nodes n LEFT JOIN id_labels l ON l.reg_doc = n.reg_doc AND l.node = n.node)"""
NODE_LABELS_ALL = f"{NODES}, {NODE_LABELS}"
LABELLED = f"""{ID_LABELS}, uid_labels AS (SELECT uid, min((CASE document_region WHEN 'body' THEN 'obligation' WHEN 'annex' THEN 'test_condition' WHEN 'form' THEN 'administrative' WHEN 'front_matter' THEN 'informative' ELSE 'unknown' END, CASE WHEN is_pseudo_clause THEN 'none' ELSE 'binding' END)) AS x FROM clauses WHERE parser_name = 'hand_checked' GROUP BY 1),
labelled AS (SELECT c.clause_key, c.reg_doc, c.text, c.is_pseudo_clause, u.uid IS NOT NULL AS by_uid, l.node IS NOT NULL AS by_id, coalesce(u.x[1], l.x[1], 'unknown') AS category, coalesce(u.x[2], l.x[2], 'none') AS force FROM (SELECT *, {cid('clause_id')} AS node FROM clauses) c LEFT JOIN uid_labels u ON u.uid = c.uid LEFT JOIN id_labels l ON l.reg_doc = c.reg_doc AND l.node = c.node)"""
_LOW = "list_transform(coalesce(section_path, []), lambda p: lower(p))"
SCORE = f"""(CASE WHEN {form_field('title')} THEN -100 ELSE 0 END + CASE WHEN list_contains({_LOW}, 'communication') THEN -80 ELSE 0 END + CASE WHEN list_has_any({_LOW}, ['annexes', 'annex']) THEN -40 ELSE 0 END
  + CASE WHEN coalesce(document_region, '') <> '' THEN 5 ELSE 0 END + CASE WHEN coalesce(trim(title) <> '', false) AND NOT {form_field('title')} THEN 20 ELSE 0 END
  + CASE WHEN len({_LOW}) > 0 AND coalesce({_LOW}[1], '') NOT IN ('communication', 'annexes', 'annex') THEN 15 ELSE 0 END + least(length(coalesce(text, '')), 1200) / 100)"""
BEST_OF = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY reg_doc, node ORDER BY score DESC, line_start, clause_key) AS n FROM scored) WHERE n = 1"
BEST = f"{WITH_NODE}, scored AS (SELECT *, {SCORE} AS score FROM with_node), best AS ({BEST_OF})"
_LINE = first_line("text")
INDEX = f"""{ANC}, {NODE_LABELS}, {WITH_NODE}, scored AS (SELECT *, {SCORE} AS score FROM with_node WHERE NOT is_pseudo_clause), best AS ({BEST_OF}),
kept AS (SELECT * FROM best WHERE NOT (len(list_filter({_LOW}, lambda p: starts_with(p, 'communication'))) > 0 OR {form_field('title')} OR {form_field(_LINE)} OR regexp_matches({_LINE}, '[.…_]{{5,}}'))),
idx AS (SELECT k.reg_doc, k.node, k.t AS title, left(coalesce(k.text, ''), 400) AS text_preview, coalesce(l.category, 'unknown') AS category, coalesce(l.force, 'none') AS force, coalesce(l.category IN ('obligation', 'performance_data', 'test_execution', 'test_procedure') AND l.force = 'binding', false) AS testable, a.ancestor AS parent
  FROM (SELECT *, {repaired_title()} AS t FROM kept) k LEFT JOIN node_labels l ON l.reg_doc = k.reg_doc AND l.node = k.node LEFT JOIN anc a ON a.reg_doc = k.reg_doc AND a.node = k.node AND a.depth = 1)"""
_END = r"\r\n|[\n\r\x{000b}\x{000c}\x{001c}\x{001d}\x{001e}\x{0085}\x{2028}\x{2029}]"
LINES = f"lines AS (SELECT clause_key, u.no AS line_no, u.line FROM clauses, unnest(string_split_regex(regexp_replace(text, '(?:{_END})$', ''), '{_END}')) WITH ORDINALITY AS u(line, no) WHERE text <> '')"
DOC_LINES = f"""{BEST}, ranked AS (SELECT reg_doc, node, title, text, row_number() OVER (PARTITION BY reg_doc ORDER BY line_start, clause_key) AS rank, regexp_replace(node, '^.* / ', '') AS tail FROM best),
written AS (SELECT reg_doc, rank, CASE WHEN starts_with(tail, 'Annex') THEN tail || ' - ' ELSE '# ' || tail || '. ' END || coalesce(regexp_replace(title, '[\\r\\n]+', ' ', 'g'), 'Untitled') || chr(10) || coalesce(text, '') AS doc FROM ranked),
doc_lines AS (SELECT reg_doc, rank * 10000 + u.no AS line_no, u.line FROM written, unnest(string_split_regex(regexp_replace(doc, '(?:{_END})$', ''), '{_END}')) WITH ORDINALITY AS u(line, no))"""
HEADS = rf"""heads AS (SELECT reg_doc, line_no, line, b, CASE WHEN NOT ({noise('b')}) AND NOT ({contents('b')}) THEN CASE
    WHEN regexp_matches(b, '(?i)^annex\s+(\d+)(?:\s*[-:]\s*.+)?$') THEN 'Annex ' || regexp_extract(b, '(?i)^annex\s+(\d+)', 1) WHEN regexp_matches(b, '(?i)^scenario\s+(\d+)(?:\s*[-:]\s*.+)?$') THEN 'Scenario ' || regexp_extract(b, '(?i)^scenario\s+(\d+)', 1)
    WHEN regexp_matches(b, '^([1-9]\d?(?:\.\d+)*)\.?\s+\S') THEN regexp_extract(b, '^([1-9]\d?(?:\.\d+)*)\.?\s+\S', 1) END END AS hid,
  trim(regexp_replace(regexp_replace(b, '(?i)^(?:annex|scenario)\s+\d+\s*[-:]?\s*', ''), '^[1-9]\d?(?:\.\d+)*\.?\s+', '')) AS htitle FROM (SELECT *, {bare('line')} AS b FROM doc_lines))"""
MD_CELLS = rf"""md AS (SELECT DISTINCT ON (table_id) table_id AS key, raw_markdown FROM regulation_tables), ml AS (SELECT key, u.line, row_number() OVER (PARTITION BY key ORDER BY u.no) - 1 AS row_no FROM md, unnest(string_split(raw_markdown, chr(10))) WITH ORDINALITY AS u(line, no) WHERE regexp_matches(u.line, '^\s*\|.*\|\s*$') AND NOT regexp_matches(u.line, '^[\s|:\-]+$')),
cells AS (SELECT key, row_no, c.no - 1 AS col_no, {collapse('c.v')} AS value FROM ml, unnest(string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|')) WITH ORDINALITY AS c(v, no))"""
SENTENCES = rf"""raw AS (SELECT clause_key, l.no AS l, s.no AS s, {clean('s.x')} AS sentence FROM clauses, unnest(string_split(regexp_replace(text, '(?is)<table\b.*?</table>', ' ', 'g'), chr(10))) WITH ORDINALITY AS l(line, no), unnest(string_split(regexp_replace(l.line, '([.;])\s+', '\1' || chr(1), 'g'), chr(1))) WITH ORDINALITY AS s(x, no)),
sentences AS (SELECT clause_key, arg_min(sentence, (l, s)) AS sentence FROM raw WHERE regexp_matches(sentence, '(?i)\b(shall|must|may not|is required to|are required to)\b') GROUP BY clause_key, lower(sentence))"""


def context(exclude: bool, both: bool, seeds: str | None = None) -> str:
    """CTEs up to ``ctx`` (reg_doc, seed, node), the union of all parts before the testing filter."""
    blocked = "SELECT reg_doc, node FROM node_labels WHERE category IN ('test_condition', 'test_execution', 'test_procedure', 'test_setup')" + ("" if exclude else " AND false")
    free = "NOT EXISTS (SELECT 1 FROM blocked b WHERE b.reg_doc = {0}.reg_doc AND b.node = {0}.node)"
    two = "UNION SELECT reg_doc, dst, src FROM open_refs" if both else ""
    return f"""WITH RECURSIVE {ANC}, {REFS_ONLY}, {NODE_LABELS}, {seeds or SEEDS}, blocked AS ({blocked}),
open_refs AS (SELECT * FROM refs e WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.reg_doc = e.reg_doc AND (b.node = e.src OR b.node = e.dst))), open_both AS (SELECT * FROM open_refs {two}),
rts AS (SELECT s.reg_doc, s.node AS seed, arg_min(a.ancestor, a.depth) AS root, min(a.depth) AS rd FROM seeds s JOIN anc a ON a.reg_doc = s.reg_doc AND a.node = s.node JOIN node_labels l ON l.reg_doc = a.reg_doc AND l.node = a.ancestor AND l.category = 'formatting' GROUP BY 1, 2),
ups AS (SELECT s.reg_doc, s.node AS seed, a.ancestor AS node, a.depth FROM seeds s JOIN anc a ON a.reg_doc = s.reg_doc AND a.node = s.node LEFT JOIN rts r ON r.reg_doc = s.reg_doc AND r.seed = s.node WHERE r.rd IS NULL OR a.depth <= r.rd),
chain AS (SELECT reg_doc, node AS seed, node FROM seeds UNION SELECT reg_doc, seed, node FROM ups),
p1 AS (SELECT * FROM chain c WHERE {free.format('c')} UNION SELECT p.reg_doc, p.seed, e.dst FROM p1 p JOIN open_refs e ON e.reg_doc = p.reg_doc AND e.src = p.node),
p3 AS (SELECT reg_doc, seed, root AS node FROM rts UNION SELECT r.reg_doc, r.seed, a.node FROM rts r JOIN anc a ON a.reg_doc = r.reg_doc AND a.ancestor = r.root),
p4 AS (SELECT * FROM p3 c WHERE {free.format('c')} UNION SELECT p.reg_doc, p.seed, e.dst FROM p4 p JOIN open_both e ON e.reg_doc = p.reg_doc AND e.src = p.node),
ctx AS (SELECT * FROM chain UNION SELECT * FROM p1 UNION SELECT s.reg_doc, s.node, a.node FROM seeds s JOIN anc a ON a.reg_doc = s.reg_doc AND a.ancestor = s.node
  UNION SELECT u.reg_doc, u.seed, a.node FROM ups u JOIN anc a ON a.reg_doc = u.reg_doc AND a.ancestor = u.node AND a.depth = 1 WHERE u.depth = 1 UNION SELECT * FROM p3 UNION SELECT * FROM p4)
"""
