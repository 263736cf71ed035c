import re
from html import unescape

from clausewright.operators import grids as G


def test_spans_repeat_values():
    html = "<table><tr><th rowspan=2>a</th><th colspan=2>b</th></tr><tr><td>c</td><td>d</td></tr><tr><td colspan='3'>x&amp;y</td></tr><tr><td></td></tr></table>"
    assert G.html_grid(html) == [["a", "b", "b"], ["a", "c", "d"], ["x&y", "x&y", "x&y"]]
    assert G.html_grid(None) == [] and G.html_grid("") == [] and G.html_grid("plain") == []
    assert G.html_grid("<TABLE><TR><TD>1<TD>2<TR><TD>3") == [["1", "2"], ["3"]]
    assert G.html_grid("<table><tr><td rowspan=3>a<td>b</tr><tr><td>c</tr><tr><td>d</tr></table>") == [["a", "b"], ["a", "c"], ["a", "d"]]


def test_markdown_headers_and_cells(spark):
    text = "intro\n| speed | speed | |\n|---|:-:|---|\n| km/h | m | |\n| 10 | 2 | x |\n| dry | 3 | |"
    cells = G.markdown_cells(spark.createDataFrame([("t", text), ("n", None), ("e", "")], "k string, md string"), "k", "md")
    heads, body = G.split_header(cells)
    assert {r.col_no: r.header for r in heads.collect()} == {0: "speed / km/h", 1: "speed / m", 2: "column"}
    assert {(r.data_row, r.col_no): r.value for r in body.collect()} == {(0, 0): "10", (0, 1): "2", (0, 2): "x", (1, 0): "dry", (1, 1): "3", (1, 2): ""}


def test_tables_over_pages_merge(spark):
    rows = [("d", 1, "a", 2, "h|k", True), ("d", 2, "b", 2, "h|k", True), ("d", 3, "c", 2, "h|k", True), ("d", 4, "e", 2, "H|k", True), ("d", 5, "f", 2, "H|k", False), ("x", 1, "g", 2, "H|k", True)]
    got = {r.key: (r.merged_key, r.continues) for r in G.continued_tables(spark.createDataFrame(rows, "doc string, position int, key string, columns int, header string, gap_ok boolean")).collect()}
    assert got == {"a": ("a", False), "b": ("a", True), "c": ("a", True), "e": ("e", False), "f": ("f", False), "g": ("g", False)}


def second_grid(html):
    """Brute force: cells placed one by one on a sheet, spans filled, blank rows left out."""
    sheet, row, col = {}, -1, 0
    body = re.sub(r"(?is)<caption\b.*?</caption>|<!--.*?-->", "", html)
    for m in re.finditer(r"(?is)<(tr|td|th)\b([^>]*)>((?:(?!</?(?:tr|td|th|table)\b).)*)", body):
        if m[1].lower() == "tr":
            row, col = row + 1, 0
            continue
        row = max(row, 0)
        spans = [int((re.search(rf"(?i){k}\s*=\s*[\"']?(\d+)", m[2]) or [0, "1"])[1]) or 1 for k in ("rowspan", "colspan")]
        value = " ".join(unescape(re.sub(r"<[^<>]*>", lambda t: " " if re.match(r"(?i)<(?:br|p)\b", t[0]) else "", m[3])).replace("\xa0", " ").split())
        while (row, col) in sheet:
            col += 1
        for k in range(spans[1]):
            for r in range(spans[0]):
                sheet[row + r, col + k] = value
        col += spans[1]
    rows = [[sheet[r, c] for c in sorted(c for q, c in sheet if q == r)] for r in range(row + 1)]
    return [r for r in rows if any(r)]


def test_cells_of_all_tables_equal_brute_force(tables):
    rows = {r.table_id: r.raw_html for r in tables("regulation_tables").filter("raw_html IS NOT NULL").collect()}
    assert len(rows) > 5 and any("colspan" in t for t in rows.values())
    for key, text in rows.items():
        assert G.html_grid(text) == second_grid(text), key
