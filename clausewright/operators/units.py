"""Quantities recorded in different units: a number and unit grammar with dimension vectors.

A unit expression is parsed into a scale, an offset and a vector of exponents over the base
dimensions (length, mass, time, temperature, luminous intensity). Grammar::

    value  = [qualifier] number [("±" | "+/-") number | ("-" | "–" | "to" | "...") number] [unit] ["*"]
    unit   = [("x" | "×")] multiplier unit | factor (("/" | "per" | "·" | "*" | " ") factor)*
    factor = symbol [("^" | "**")] [exponent]
    multiplier = number | "10^3" | "10³"

A symbol may have several readings ("C", "g", "m"); the one whose dimensions equal those of
the quantity is taken. The unit of a value is looked for in this order: with the value, in its
field name, in the record's ``units`` (by field, then quantity), in the title, in the scenario; a
statement that does not parse, or parses to other dimensions, is passed over. Without any
the value is in the common unit.

Defined results: null, blank and number-free values are no values; a value of a field that
names no known quantity counts only if its own unit has a listed quantity's dimensions; repeated
records give one row; null maps and arrays, and empty tables, give none. Parsing runs in Arrow
batches with per-task memos of the (few) distinct unit spellings; only the small unit table
(one row per quantity) reaches every task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Unit(NamedTuple):
    """canonical = value * scale + offset, in base units; dims over (length, mass, time, temperature, luminous intensity)."""

    scale: float
    offset: float
    dims: tuple[int, int, int, int, int]


NONE = (0, 0, 0, 0, 0)
L, M, S, K, J = ((1, 0, 0, 0, 0), (0, 1, 0, 0, 0), (0, 0, 1, 0, 0), (0, 0, 0, 1, 0), (0, 0, 0, 0, 1))
FORCE, PRESSURE, ACCEL, SPEED, LUX = (1, 1, -2, 0, 0), (-1, 1, -2, 0, 0), (1, 0, -2, 0, 0), (1, 0, -1, 0, 0), (-2, 0, 0, 0, 1)

# Symbols and words of units (public SI and customary definitions).
PREFIXED = {
    "m": Unit(1, 0, L), "g": Unit(1e-3, 0, M), "s": Unit(1, 0, S), "N": Unit(1, 0, FORCE), "Pa": Unit(1, 0, PRESSURE), "bar": Unit(1e5, 0, PRESSURE),
    "lx": Unit(1, 0, LUX), "lux": Unit(1, 0, LUX), "K": Unit(1, 0, K), "t": Unit(1e3, 0, M),
}
PREFIXES = {"": 1.0, "k": 1e3, "M": 1e6, "c": 1e-2, "m": 1e-3, "d": 1e-1, "da": 1e1, "h": 1e2, "µ": 1e-6, "μ": 1e-6, "G": 1e9}
PLAIN = {
    "h": Unit(3600, 0, S), "hr": Unit(3600, 0, S), "min": Unit(60, 0, S), "sec": Unit(1, 0, S), "msec": Unit(1e-3, 0, S),
    "in": Unit(0.0254, 0, L), "ft": Unit(0.3048, 0, L), "yd": Unit(0.9144, 0, L), "mi": Unit(1609.344, 0, L), "nmi": Unit(1852, 0, L), '"': Unit(0.0254, 0, L),
    "lb": Unit(0.45359237, 0, M), "lbs": Unit(0.45359237, 0, M), "oz": Unit(0.028349523125, 0, M), "Kg": Unit(1, 0, M), "KG": Unit(1, 0, M),
    "lbf": Unit(4.4482216152605, 0, FORCE), "kgf": Unit(9.80665, 0, FORCE), "kp": Unit(9.80665, 0, FORCE),
    "psi": Unit(6894.757293168, 0, PRESSURE), "PSI": Unit(6894.757293168, 0, PRESSURE), "kpa": Unit(1e3, 0, PRESSURE), "KPa": Unit(1e3, 0, PRESSURE), "Mpa": Unit(1e6, 0, PRESSURE), "mpa": Unit(1e6, 0, PRESSURE), "atm": Unit(101325, 0, PRESSURE),
    "kn": Unit(1852 / 3600, 0, SPEED), "kt": Unit(1852 / 3600, 0, SPEED), "kph": Unit(1 / 3.6, 0, SPEED), "kmh": Unit(1 / 3.6, 0, SPEED), "mph": Unit(0.44704, 0, SPEED), "mps": Unit(1, 0, SPEED), "fps": Unit(0.3048, 0, SPEED),
    "ms2": Unit(1, 0, ACCEL), "g": Unit(9.80665, 0, ACCEL), "G": Unit(9.80665, 0, ACCEL), "g0": Unit(9.80665, 0, ACCEL), "gn": Unit(9.80665, 0, ACCEL), "Gal": Unit(0.01, 0, ACCEL),
    "fc": Unit(10.763910416709722, 0, LUX), "ftc": Unit(10.763910416709722, 0, LUX), "Lux": Unit(1, 0, LUX), "LUX": Unit(1, 0, LUX), "phot": Unit(1e4, 0, LUX),
    "C": Unit(1, 273.15, K), "°C": Unit(1, 273.15, K), "℃": Unit(1, 273.15, K), "degC": Unit(1, 273.15, K),
    "F": Unit(5 / 9, 459.67 * 5 / 9, K), "°F": Unit(5 / 9, 459.67 * 5 / 9, K), "℉": Unit(5 / 9, 459.67 * 5 / 9, K), "degF": Unit(5 / 9, 459.67 * 5 / 9, K),
    "°K": Unit(1, 0, K), "degK": Unit(1, 0, K), "°R": Unit(5 / 9, 0, K),
}
WORDS = {
    "metre": "m", "meter": "m", "kilometre": "km", "kilometer": "km", "centimetre": "cm", "centimeter": "cm", "millimetre": "mm", "millimeter": "mm", "inch": "in", "inche": "in", "foot": "ft", "feet": "ft", "yard": "yd", "mile": "mi",
    "gram": "g", "kilogram": "kg", "kilo": "kg", "tonne": "t", "ton": "t", "pound": "lb", "ounce": "oz", "second": "s", "sec": "s", "millisecond": "ms", "msec": "ms", "minute": "min", "hour": "h", "hr": "h",
    "newton": "N", "kilonewton": "kN", "decanewton": "daN", "pascal": "Pa", "kilopascal": "kPa", "megapascal": "MPa", "hectopascal": "hPa", "millibar": "mbar", "knot": "kn", "lux": "lx", "kilolux": "klx", "footcandle": "fc",
    "celsius": "°C", "fahrenheit": "°F", "kelvin": "K", "poundforce": "lbf",
}
# Words in field names that tell the quantity, the first hit counts; plural classes used in prose.
QUANTITY_WORDS = (
    ("temperature", r"temp(?:erature)?s?"), ("acceleration", r"(?:de|ac)celerations?|(?:de|ac)cel"), ("speed", r"speeds?|velocit(?:y|ies)"), ("pressure", r"pressures?"),
    ("force", r"forces?"), ("mass", r"mass(?:es)?|ballast|weights?"), ("illumination", r"illuminations?|illuminance|lights?"), ("time", r"times?|ttc|durations?"),
    ("length", r"distances?|gaps?|offsets?|heights?|lengths?|widths?|depths?"),
)
QUANTITY_RE = [(q, re.compile(rf"(?<![a-z])(?:{p})(?![a-z])")) for q, p in QUANTITY_WORDS]

NUMBER = r"\d+(?:[.,]\d+)*"
VALUE_RE = re.compile(
    rf"^\s*(?P<q>[≤≥<>=~≈±]+|[<>]=|(?:max|min|approx|ca|abt|about|up to|at least|at most|not more than|not less than)\.?)?\s*(?P<a>[-−–+]?{NUMBER})"
    rf"(?:\s*(?P<op>±|\+/-|\+/−|[-–—]|to|\.\.\.?|…)\s*(?P<b>[-−]?{NUMBER}))?\s*(?P<unit>.*?)\s*\*?\s*$",
    re.I | re.S,
)
UNIT_CHARS = 200
SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
FACTOR_RE = re.compile(r"^([^\d^*\-+]+?)(?:\^|\*\*)?([-+]?\d+)?$")


def to_number(text: str) -> float | None:
    """"8,4" and "8.4" alike; with several separators the last one is the decimal point unless it repeats."""
    text = text.replace("−", "-").replace("–", "-").lstrip("+")
    marks = [c for c in text if c in ".,"]
    if len(marks) > 1:
        last = marks[-1]
        text = text.replace("," if last == "." else ".", "")
        if text.count(last) > 1:
            text = text.replace(last, "")
    try:
        return float(text.replace(",", "."))
    except ValueError:
        return None


@lru_cache(maxsize=50_000)
def readings(symbol: str) -> tuple[Unit, ...]:
    """All units a single symbol or word may stand for."""
    out = []
    if symbol in PLAIN:
        out.append(PLAIN[symbol])
    for base, unit in PREFIXED.items():
        if symbol.endswith(base) and (prefix := symbol[: len(symbol) - len(base)]) in PREFIXES:
            out.append(unit._replace(scale=unit.scale * PREFIXES[prefix]))
    word = symbol.lower().rstrip(".")
    for form in (word, word.removesuffix("s")):
        if form in WORDS:
            return tuple(out) + tuple(u for u in readings(WORDS[form]) if u not in out)
    if not out and symbol.endswith("."):
        return readings(symbol.rstrip("."))
    if not out and symbol != symbol.lower():
        return readings(symbol.lower())
    return tuple(out)


def _tidy(text: str) -> str:
    """LaTeX wrapping, odd blanks and spelled-out operators."""
    text = text.replace("\xa0", " ").replace("\u202f", " ").strip().rstrip(";:")
    if "$" in text or "\\" in text:
        text = re.sub(r"\\(?:mathrm|text|rm|bf|mathbf)\b|\\[,;! ]|[${}~]", " ", text)
        text = re.sub(r"\\(?:cdot|times)\b", "·", text)
        text = re.sub(r"\s*([/^])\s*", r"\1", text)
        text = re.sub(r"(?<=\b[A-Za-z]) (?=[A-Za-z]\b)", "", text).strip()
    text = re.sub(r"\bdeg(?:rees?|s)?\.?\s*(?=[CFK]\b|Celsius|Fahrenheit|Kelvin)", "°", text, flags=re.I)
    text = re.sub(r"°\s*(Celsius|Fahrenheit|Kelvin)\b", lambda m: "°" + m[1][0].upper(), text, flags=re.I)
    text = re.sub(r"°\s+(?=[CFK]\b)", "°", text)
    text = re.sub(r"\b(foot|feet)[\s-]*candles?\b", "fc", text, flags=re.I)
    text = re.sub(r"\bpounds?[\s-]*force\b", "lbf", text, flags=re.I)
    text = re.sub(r"\bper\b", "/", text, flags=re.I)
    text = re.sub(r"\bsquared?\b", "^2", text, flags=re.I)
    return text.translate(SUPERSCRIPTS) if not re.match(r"^10[⁰¹²³⁴⁵⁶⁷⁸⁹⁻]", text) else "10^" + re.sub(r"^10([⁰¹²³⁴⁵⁶⁷⁸⁹⁻]+)", lambda m: m[1].translate(SUPERSCRIPTS), text).translate(SUPERSCRIPTS)


@lru_cache(maxsize=50_000)
def parse_unit(text: str) -> tuple[Unit, ...]:
    """All readings of a unit expression (of up to UNIT_CHARS characters, as written); empty if it isn't one."""
    if len(text) > UNIT_CHARS:
        return ()
    text = _tidy(text)
    factor = 1.0
    if m := re.match(r"^(?:[x×*·]\s*)?10\s*\^\s*(-?\d+)\s*[x×*·]?\s*(?=\D)", text):
        factor, text = 10.0 ** int(m[1]), text[m.end():]
    elif m := re.match(rf"^[x×]\s*({NUMBER})\s+(?=\D)", text):
        factor, text = to_number(m[1]) or 1.0, text[m.end():]
    if not text or len(text) > 40:
        return ()
    whole = readings(text)
    if whole:
        return tuple(u._replace(scale=u.scale * factor, offset=u.offset) for u in whole)
    out: list[Unit] = [Unit(factor, 0.0, NONE)]
    sign = 1
    for part in re.split(r"(\s*[/·*]\s*|\s+)", text):
        if not part:
            continue
        if not part.strip() or part.strip() in "/·*":
            sign = -1 if part.strip() == "/" else 1 if part.strip() else sign
            continue
        m = FACTOR_RE.match(part)
        if not m:
            return ()
        power = sign * int(m[2] or 1)
        units = readings(m[1])
        if not units:
            return ()
        out = [Unit(a.scale * u.scale**power, 0.0, tuple(x + power * y for x, y in zip(a.dims, u.dims))) for a in out for u in units][:64]
    return tuple(out)


def unit_for(text: str, dims: tuple[int, ...]) -> Unit | None:
    """The reading of ``text`` with the given dimensions."""
    return next((u for u in parse_unit(text) if u.dims == dims), None)


@lru_cache(maxsize=50_000)
def split_field(field: str) -> tuple[str, tuple[str, ...]]:
    """Bare name in lower case, and the unit spellings that the field name may carry, likeliest first."""
    name = field.replace("\xa0", " ").strip()
    found = []
    if m := re.match(r"^(.*?)\s*[(\[]([^()\[\]]+)[)\]]\s*$", name):
        found.append((m[1], m[2]))
    if m := re.match(r"^(.*?),\s+(.+)$", name):
        found.append((m[1], m[2]))
    if m := re.match(r"^(.*?)\s+in\s+(.+)$", name):
        found.append((m[1], m[2]))
    if "_" in name and " " not in name:
        head, _, tail = name.rpartition("_")
        found.append((head, tail))
    for head, tail in found:
        if parse_unit(tail):
            return head.strip().lower(), (tail,)
    return name.lower(), ()


@lru_cache(maxsize=50_000)
def quantity_of(name: str) -> str | None:
    """The quantity that a bare field name speaks of."""
    words = name.replace("_", " ").lower()
    return next((q for q, p in QUANTITY_RE if p.search(words)), None)


STATED_RE = re.compile(
    r"(?:all values of (?P<a>[\w\s-]+?) in (?P<ua>.+?)\s*$)|(?:[(,]\s*(?P<b>[\w\s-]+?) given in (?P<ub>[^()]+?)\)?\s*$)|(?:\((?P<c>[\w\s-]+?) in (?P<uc>[^()]+?)\)\s*$)"
    r"|(?:all (?P<d>[a-z ]+?) (?:of this \w+ )?(?:are|is) (?:stated|given|expressed|recorded) in (?P<ud>.+?)\.?(?=\.\s|\.?$|\.\s*\n))|(?:note that (?P<e>[a-z ]+?) (?:are|is) (?:stated|given|expressed|recorded) in (?P<ue>.+?)\.?(?=\.\s|\.?$|\.\s*\n))",
    re.I | re.M,
)


@lru_cache(maxsize=20_000)
def stated_units(prose: str) -> tuple[tuple[str, str], ...]:
    """(what, unit spelling) pairs that a title or a scenario states."""
    out = []
    for m in STATED_RE.finditer(prose):
        for key in "abcde":
            if m[key]:
                out.append((m[key].strip().lower(), m["u" + key].strip()))
    return tuple(out)


class Targets:
    """Common unit and dimensions by quantity."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.unit: dict[str, tuple[str, Unit]] = {}
        for quantity, spelling in rows:
            dims = DIMENSIONS.get(quantity)
            unit = unit_for(spelling, dims) if dims else next(iter(parse_unit(spelling)), None)
            if unit:
                self.unit[quantity] = (spelling, unit)
        self.by_dims = {u.dims: q for q, (_, u) in reversed(self.unit.items())}


DIMENSIONS = {"speed": SPEED, "acceleration": ACCEL, "length": L, "mass": M, "time": S, "illumination": LUX, "temperature": K, "force": FORCE, "pressure": PRESSURE}


class Reading(NamedTuple):
    quantity: str
    unit_text: str
    foreign: bool
    low: float
    high: float
    tolerance: float | None


def read_value(field: str, value: str | None, units: dict[str, str], prose: tuple[str, ...], targets: Targets) -> Reading | None:
    """The value in its common unit, or None if there is no measured value."""
    m = VALUE_RE.match(value or "")
    if not m:
        return None
    first = to_number(m["a"])
    if first is None:
        return None
    name, in_field = split_field(field)
    quantity = quantity_of(name)
    own = (m["unit"] or "").strip()
    if quantity not in targets.unit:
        quantity = next((targets.by_dims[u.dims] for u in parse_unit(own) if u.dims in targets.by_dims), None) if own else None
        if quantity is None:
            quantity = next((targets.by_dims[u.dims] for t in in_field for u in parse_unit(t) if u.dims in targets.by_dims), None)
        if quantity is None:
            return None
    common_text, common = targets.unit[quantity]
    unit, text = None, ""
    if own:
        unit, text = unit_for(own, common.dims), own
        if unit is None and (words := own.split()) and len(words) > 1:
            # trailing remarks after the unit; no unit is longer than UNIT_CHARS, so has no more words
            for n in range(min(len(words) - 1, UNIT_CHARS // 2), 0, -1):
                if u := unit_for(" ".join(words[:n]), common.dims):
                    unit, text = u, " ".join(words[:n])
                    break
    if unit is None:
        stated = list(in_field)
        lowered = {k.replace("\xa0", " ").strip().lower(): v for k, v in units.items() if k and v}
        stated += [lowered[k] for k in (field.strip().lower(), name, quantity) if k in lowered]
        pairs = [p for text_ in prose if text_ for p in stated_units(text_)]
        stated += [u for what, u in pairs if what == name] + [u for what, u in pairs if what != name and _class_of(what) == quantity]
        for text in stated:
            unit = unit_for(text, common.dims) or unit_for(text.rstrip("."), common.dims)
            if unit:
                break
    if unit is None:
        unit, text = common, common_text
    foreign = abs(unit.scale - common.scale) > 1e-9 * abs(common.scale) or abs(unit.offset - common.offset) > 1e-6
    convert = lambda x: (x * unit.scale + unit.offset - common.offset) / common.scale
    second = to_number(m["b"]) if m["b"] else None
    tolerance = None
    low = high = convert(first)
    if second is not None:
        if m["op"] in ("±", "+/-", "+/−"):
            tolerance = abs(second) * unit.scale / common.scale
        else:
            high = convert(second)
    return Reading(quantity, text, foreign, low, high, tolerance)


# Plural classes in prose that name no quantity word of their own.
CLASSES = {"light levels": "illumination", "distances": "length"}


def _class_of(what: str) -> str | None:
    """The quantity of a class word ("forces"); a specific field name is no class."""
    if what in CLASSES:
        return CLASSES[what]
    return quantity_of(what) if re.fullmatch(r"[a-z]+s", what) else None


def measured_cells(tables: DataFrame, test_cases: DataFrame) -> DataFrame:
    """One row per cell: (src_table, src_key, row_no, field, value, units, prose); repeated records once."""
    none = F.create_map().cast("map<string,string>")
    cells = tables.select("table_id", F.coalesce("units", none).alias("units"), F.array("title").alias("prose"), F.posexplode("row_maps").alias("row_no", "cells"))
    cells = cells.select(F.lit("regulation_tables").alias("src_table"), F.col("table_id").alias("src_key"), F.col("row_no").cast("long").alias("row_no"), F.explode("cells").alias("field", "value"), "units", "prose")
    cases = test_cases.select(
        F.lit("test_cases").alias("src_table"), F.col("test_id").alias("src_key"), F.lit(0).cast("long").alias("row_no"), F.explode("parameters").alias("field", "value"), none.alias("units"), F.array("title", "objective", "scenario").alias("prose")
    )
    # a value without a digit is no value: dropped before Python
    return cells.unionByName(cases).filter(F.col("value").rlike("[0-9]") & F.col("src_key").isNotNull())


CONVERTED = T.StructType([
    T.StructField("src_table", T.StringType()), T.StructField("src_key", T.StringType()), T.StructField("row_no", T.LongType()), T.StructField("field", T.StringType()),
    T.StructField("quantity", T.StringType()), T.StructField("unit_text", T.StringType()), T.StructField("foreign_unit", T.BooleanType()),
    T.StructField("value_low", T.DoubleType()), T.StructField("value_high", T.DoubleType()), T.StructField("tolerance", T.DoubleType()), T.StructField("common_unit", T.StringType()),
])


def read_cells(cells: DataFrame, unit_targets: DataFrame) -> DataFrame:
    """CONVERTED rows. ``unit_targets`` has one row per physical quantity, read by the driver (bounded by the grammar's quantities)."""
    listed = [(r[0], r[1]) for r in unit_targets.filter(F.col("quantity").isin(list(DIMENSIONS)) & F.col("common_unit").isNotNull()).select("quantity", "common_unit").distinct().collect()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets = Targets(listed)
        for batch in batches:
            rows = []
            for src, key, no, field, value, units, prose in zip(*(c.to_pylist() for c in batch.columns)):
                if r := read_value(field, value, dict(units or ()), tuple(prose or ()), targets):
                    rows.append((src, key, no, field, r.quantity, r.unit_text, r.foreign, r.low, r.high, r.tolerance, targets.unit[r.quantity][0]))
            columns = list(zip(*rows)) if rows else [[]] * len(CONVERTED)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.name for f in CONVERTED])

    return cells.select("src_table", "src_key", "row_no", "field", "value", "units", "prose").mapInArrow(read, CONVERTED)


def converted(cells: DataFrame, unit_targets: DataFrame) -> DataFrame:
    """Every measured value in its common unit, once."""
    return read_cells(cells, unit_targets).dropDuplicates(["src_table", "src_key", "row_no", "field"])


def foreign_units(cells: DataFrame, unit_targets: DataFrame) -> DataFrame:
    """(src_table, src_key, row_no, field) of the values whose unit isn't the common one."""
    return read_cells(cells, unit_targets).filter("foreign_unit").select("src_table", "src_key", "row_no", "field").distinct()
