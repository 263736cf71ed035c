"""Column expressions on clause text, titles and identifiers; all run inside the JVM's code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x{00A0}]+"
#: shape of a usable clause id after ``canonical_id``
ID_SHAPE = r"^(Annex \d+|(Annex \d+ / )?[1-9]\d?(\.\d+)*)$"

# Taxonomies of clause labels.
CATEGORIES = ("obligation", "performance_data", "test_execution", "test_condition", "test_setup", "test_procedure", "definition", "scope", "administrative", "formatting", "informative")
TESTABLE = ("obligation", "performance_data", "test_execution", "test_procedure")
TESTING = ("test_condition", "test_execution", "test_procedure", "test_setup")
TEST_RELEVANT = (*TESTABLE, "test_condition", "test_setup")
# Top-level numbers of body clauses and the region they stand for.
REGION_BY_NUMBER = {"1": "scope", "2": "definitions", "3": "administrative", "4": "administrative", "5": "specifications", "6": "test_procedure", "7": "administrative", "8": "administrative", "9": "administrative", "10": "administrative", "11": "administrative", "12": "administrative"}
# Patterns of modal words, reference lists, form fields and contents lines.
MODAL = r"(?i)\b(shall|must|may|when|if|there shall|the vehicle|the system)\b"

REFERENCE_LIST = r"(?i)\b(?:paragraphs?|paras?\.?)\s+((?:\d+(?:\.\d+)*\.?\s*(?:(?:,|and|or|to|-)\s*)?)+)"
ANNEX_REFERENCE = r"(?i)\bannex\s+(\d+)"
FORM_FILLER = r"[.…_]{3,}"
FORM_END = r":\s*[.…_ ]*$"
CONTENTS_NUMBER = r"^\d+(\.\d+)*\.?\s+.+\.{2,}\s*\d+\s*$"
CONTENTS_ANNEX = r"(?i)^(Appendix\s+\d+|Annex\s+\d+)\s+.+\.{2,}\s*\d+\s*$"


def collapse(text: Column) -> Column:
    """Runs of blanks (also non-breaking) become one, ends are trimmed."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def clean_text(text: Column) -> Column:
    """Tags become blanks, escaped underscores plain ones, blanks are collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\\_", "_"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def short_digest(*parts: Column, size: int = 8) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", *parts).cast("binary")), 1, size)


def clause_uid(clause_id: Column, start: Column, end: Column) -> Column:
    """``clause-<slug>-<line>-<digest>``."""
    return F.concat(F.lit("clause-"), slug(clause_id), F.lit("-"), start.cast("string"), F.lit("-"), short_digest(clause_id, start.cast("string"), end.cast("string")))


def content_hash(*parts: Column) -> Column:
    """16 hex digits over the parts; nulls count as empty."""
    return F.substring(F.sha1(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary")), 1, 16)


def canonical_id(clause_id: Column) -> Column:
    """Display form of a clause id: blanks collapsed, "Annex n / m" spaced and cased, no trailing full stops."""
    s = F.regexp_replace(collapse(clause_id), r"\.+$", "")
    s = F.regexp_replace(s, r"(?i)^(paragraph|para\.) ?", "")
    return F.regexp_replace(F.regexp_replace(s, r"(?i)^annex ?(\d+) ?/ ?", "Annex $1 / "), r"(?i)^annex (\d+)$", "Annex $1")


def is_clause_id(clause_id: Column) -> Column:
    return clause_id.rlike(ID_SHAPE)


def is_number_valid(clause_id: Column) -> Column:
    """Dotted number with a top level of 1 to 99 and no leading zero."""
    return clause_id.rlike(r"^[1-9]\d?(\.\d+)*$")


def parent_id(clause_id: Column) -> Column:
    """Parent by the form of the id alone; null for roots."""
    tail = F.element_at(F.split(clause_id, " / "), -1)
    container = F.substring_index(clause_id, " / ", 1)
    drop = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    return (
        F.when(clause_id.contains(" / "), F.when(tail.rlike(r"^\d+(\.\d+)+$"), F.concat(container, F.lit(" / "), drop(tail))).otherwise(container))
        .when(clause_id.rlike(r"(?i)^annex \d+ - appendix \d+$"), F.regexp_replace(clause_id, r"(?i) - appendix \d+$", ""))
        .when(clause_id.rlike(r"^\d+(\.\d+)+$"), drop(clause_id))
    )


def ancestor_ids(clause_id: Column) -> Column:
    """All ancestors by form, nearest first."""
    tail = F.element_at(F.split(clause_id, " / "), -1)
    prefix = F.when(clause_id.contains(" / "), F.concat(F.substring_index(clause_id, " / ", 1), F.lit(" / "))).otherwise("")
    parts = F.split(tail, r"\.")
    dotted = F.when(tail.rlike(r"^\d+(\.\d+)*$") & (F.size(parts) > 1), F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.concat(prefix, F.array_join(F.slice(parts, 1, n), ".")))).otherwise(F.array().cast("array<string>"))
    return F.when(clause_id.contains(" / "), F.concat(dotted, F.array(F.substring_index(clause_id, " / ", 1)))).otherwise(dotted)


def natural_key(clause_id: Column) -> Column:
    """Sortable array: numbers by value before words."""
    parts = F.filter(F.split(clause_id, r"[.\s/]+"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d+$"), 0).otherwise(1).alias("kind"), F.coalesce(p.try_cast("long"), F.lit(0).cast("long")).alias("n"), F.when(p.rlike(r"^\d+$"), "").otherwise(p).alias("s")))


def region_of(clause_id: Column) -> Column:
    """Region by the top-level number; annexes by name."""
    top = F.split_part(clause_id, F.lit("."), F.lit(1))
    out = F.when(F.lower(clause_id).startswith("annex"), "annex")
    for number, region in REGION_BY_NUMBER.items():
        out = out.when(top == number, region)
    return out.otherwise("unknown")


def looks_like_title(text: Column) -> Column:
    """Short, without modal words, and a label or at most twelve words."""
    words = F.regexp_count(text, F.lit(r"[A-Za-z0-9]+"))
    return F.coalesce((F.length(text) <= 120) & ~text.rlike(MODAL) & (text.endswith(":") | ((words > 0) & (words <= 12))), F.lit(False))


def looks_like_form_field(title: Column) -> Column:
    t = F.trim(title)
    filler = t.rlike(FORM_FILLER)
    ends = t.rlike(FORM_END)
    return F.coalesce(F.when(t == "", False).when(ends, filler | (F.size(F.split(t, r"\s+")) <= 8)).otherwise(t.contains(":") & filler), F.lit(False))


def is_noise_line(line: Column) -> Column:
    return line.isin("*", "#", "##") | line.rlike(r"^\d+$") | (line.contains("<!--") & line.contains("-->"))


def is_contents_line(line: Column) -> Column:
    return line.rlike(CONTENTS_NUMBER) | line.rlike(CONTENTS_ANNEX)


def text_references(text: Column) -> Column:
    """Sorted distinct clause and annex numbers that a text refers to ("paragraphs 3.2 and 4", "Annex 2")."""
    lists = F.regexp_extract_all(text, F.lit(REFERENCE_LIST), F.lit(1))
    numbers = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"\d+(?:\.\d+)*"), F.lit(0))))
    annexes = F.transform(F.regexp_extract_all(text, F.lit(ANNEX_REFERENCE), F.lit(1)), lambda n: F.concat(F.lit("Annex "), n))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(numbers, F.array().cast("array<string>")), F.coalesce(annexes, F.array().cast("array<string>")))))


def rgb(hex_colour: Column) -> list[Column]:
    """Red, green and blue of "#rrggbb", each from 0 to 1."""
    return [F.conv(F.substring(hex_colour, 2 + 2 * i, 2), 16, 10).cast("double") / 255 for i in range(3)]
