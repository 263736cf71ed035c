"""Tables inside text: HTML and Markdown blocks to grids, headers, units, types; tables split over pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.functions import text as tx


class _Grid(HTMLParser):
    """Rows of (text, rowspan, colspan) of one table."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.cell: tuple[list[str], int, int] | None = None

    @staticmethod
    def _span(value: str | None) -> int:
        return max(1, int(value)) if value and value.strip().isdigit() else 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
            self.cell = None
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            a = dict(attrs)
            self.cell = ([], self._span(a.get("rowspan")), self._span(a.get("colspan")))
            self.rows[-1].append(self.cell)
        elif tag in ("br", "p") and self.cell:
            self.cell[0].append(" ")
        elif tag in ("caption",):
            self.cell = None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.cell[0].append(data)


def html_grid(text: str | None) -> list[list[str]]:
    """Grid of the first table with spans repeated; rows without any text are left out."""
    if not text:
        return []
    parser = _Grid()
    parser.feed(text)
    grid: list[list[str]] = []
    pending: dict[int, tuple[int, str]] = {}
    for row in parser.rows:
        out: list[str] = []
        cells = iter(row)

        def fill() -> None:
            while len(out) in pending:
                left, value = pending[len(out)]
                pending.pop(len(out))
                if left > 1:
                    later[len(out)] = (left - 1, value)
                out.append(value)

        later: dict[int, tuple[int, str]] = {}
        for parts, rows, cols in cells:
            fill()
            value = " ".join("".join(parts).replace("\xa0", " ").split())
            for _ in range(cols):
                if rows > 1:
                    later[len(out)] = (rows - 1, value)
                out.append(value)
        fill()
        pending = {**pending, **later}
        grid.append(out)
    return [r for r in grid if any(r)]


def grids(tables: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row_no, col_no, value) of the HTML table in ``html``; row and column count from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, j, v) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, r in enumerate(html_grid(text)) for j, v in enumerate(r)]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["key", "row_no", "col_no", "value"])

    return tables.select(F.col(key).cast("string").alias("key"), html).mapInArrow(run, "key string, row_no int, col_no int, value string")


def markdown_cells(tables: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, row_no, col_no, value) of pipe tables; separator lines are skipped, outer pipes trimmed. JVM only."""
    lines = tables.select(F.col(key).cast("string").alias("key"), F.posexplode(F.split(F.col(markdown), r"\n")).alias("pos", "line"))
    rows = lines.filter(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:\-]+$"))
    rows = rows.withColumn("row_no", F.row_number().over(W.partitionBy("key").orderBy("pos")) - 1)
    inner = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    return rows.select("key", "row_no", F.posexplode(F.split(inner, r"\|")).alias("col_no", "v")).select("key", "row_no", "col_no", tx.collapse(F.col("v")).alias("value"))


def is_data_row(values: Column) -> Column:
    """At least half of the filled cells, and one at least, hold a digit."""
    filled = F.size(F.filter(values, lambda v: v != ""))
    return F.size(F.filter(values, lambda v: v.rlike("[0-9]"))) >= F.greatest(F.lit(1), F.floor(filled / 2))


def split_header(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, col_no, header) and the data cells (key, data_row, col_no, value).

    Header rows are those before the first data row, the first row at least; distinct parts are joined
    by " / ", blanks become "column", repeats get _2, _3 and so on. Tables of one row have no data.
    """
    rows = cells.groupBy("key", "row_no").agg(F.sum(F.col("value").rlike("[0-9]").cast("int")).alias("digits"), F.sum((F.col("value") != "").cast("int")).alias("filled"))
    data = (F.col("row_no") > 0) & (F.col("digits") >= F.greatest(F.lit(1), F.floor(F.col("filled") / 2)))
    first = rows.groupBy("key").agg(F.min(F.when(data, F.col("row_no"))).alias("f"), F.max("row_no").alias("l"), F.count("*").alias("n"))
    first = first.filter("n > 1").withColumn("first_data", F.coalesce("f", F.col("l") + 1)).select("key", "first_data")
    own = cells.join(first, "key")
    parts = own.filter(F.col("row_no") < F.col("first_data")).groupBy("key", "col_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "value"))).alias("p"))
    name = F.array_join(F.array_distinct(F.filter(F.col("p.value"), lambda v: v != "")), " / ")
    heads = parts.select("key", "col_no", F.when(name == "", "column").otherwise(name).alias("h"))
    no = F.row_number().over(W.partitionBy("key", "h").orderBy("col_no"))
    heads = heads.withColumn("no", no).select("key", "col_no", F.when(F.col("no") == 1, F.col("h")).otherwise(F.concat("h", F.lit("_"), F.col("no").cast("string"))).alias("header"))
    body = own.filter(F.col("row_no") >= F.col("first_data")).select("key", (F.col("row_no") - F.col("first_data")).alias("data_row"), "col_no", "value")
    return heads, body


def table_type(title: Column, owner: Column, headers: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(owner, F.lit("")), headers))
    own = F.coalesce(owner, F.lit(""))
    return (
        F.when(text.contains("subject vehicle test speed") | own.rlike(r"^6\.[4-7]"), "test_speed_matrix").when(text.contains("maximum") & text.contains("impact speed"), "performance_limit")
        .when(F.lower(own).startswith("annex 1") | text.contains("approval") & text.contains("signature"), "form").otherwise("unknown")
    )


def stated_units(title: Column, headers: Column) -> Column:
    """speed, acceleration and illumination units that title and headers mention, joined by ";"."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), headers))
    return F.concat_ws(";", F.when(text.contains("km/h") | text.contains("k m / h"), "speed=km/h"), F.when(text.contains("m/s") | text.contains("m / s"), "acceleration=m/s^2"), F.when(text.contains("lux"), "illumination=lux"))


def column_mode(cells: DataFrame) -> DataFrame:
    """(key, columns): the most frequent row length, the larger one on ties."""
    lengths = cells.groupBy("key", "row_no").agg(F.count("*").alias("columns")).groupBy("key", "columns").agg(F.count("*").alias("rows"))
    return lengths.groupBy("key").agg(F.max_by("columns", F.struct("rows", "columns")).alias("columns"))


def continued_tables(tables: DataFrame) -> DataFrame:
    """``tables`` (doc, position, key, columns, header, gap_ok) plus ``merged_key`` and ``continues``.

    A table continues the one before it if columns and header agree and only page furniture lies
    between; members of a run share header and columns, so comparing neighbours is enough.
    """
    by = W.partitionBy("doc").orderBy("position", "key")
    same = (F.col("header") == F.lag("header").over(by)) & (F.col("columns") == F.lag("columns").over(by)) & (F.col("header") != "") & F.col("gap_ok")
    rows = tables.withColumn("continues", F.coalesce(same, F.lit(False)))
    rows = rows.withColumn("run", F.sum((~F.col("continues")).cast("int")).over(by))
    return rows.withColumn("merged_key", F.first("key").over(W.partitionBy("doc", "run").orderBy("position", "key"))).drop("run")


def is_furniture_gap(gap: Column) -> Column:
    """Nothing, or at most three short lines without a heading or a number that starts a clause."""
    lines = F.filter(F.transform(F.split(F.coalesce(gap, F.lit("")), r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(lines) == 0) | ((F.size(lines) <= 3) & (F.length(F.array_join(lines, "")) <= 200) & ~F.exists(lines, lambda x: x.startswith("#") | x.rlike(r"^\d+(\.\d+)+\.?\s")))


# Words that mark a line above a table as its title.
TITLE_WORDS = r"(?i)maximum|subject vehicle test speed|test speed|impact speed|scenario"


def title_before(text: Column) -> Column:
    """Title of the first pipe table in ``text``: of the last eight lines above it the nearest with a title word, else the nearest."""
    above = F.split(F.regexp_extract(text, r"^((?:(?![ \t]*\|)[^\n]*\n)*)[ \t]*\|", 1), r"\n")
    bare = F.filter(F.transform(above, lambda x: tx.collapse(F.regexp_replace(F.trim(x), r"^#+\s*", ""))), lambda x: (x != "") & ~F.lower(x).startswith("all values"))
    last = F.reverse(F.slice(bare, F.greatest(F.size(bare) - 7, F.lit(1)), 8))
    marked = F.filter(last, lambda x: x.rlike(TITLE_WORDS))
    return F.coalesce(F.try_element_at(marked, F.lit(1)), F.try_element_at(last, F.lit(1)), F.lit(""))
