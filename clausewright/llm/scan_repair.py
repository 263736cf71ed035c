"""Repair of text from scanned pages: skip-gram vectors, glyph edits in context, furniture, reflow.

1. Equal texts are brought together with the number of their copies. One pass over them counts
   words, word pairs within two places, and short-line templates, by copies and by distinct texts:
   what is frequent, or rare beside another form, by either count is so. Thus neither a text
   delivered many times hides its misread words nor does a word of one repeated title get lost.
   Tasks add up their own counts before the shuffle.
2. From these counts the driver learns skip-gram vectors with negative sampling. It only reads
   words and pairs above a *relative* frequency (``WORD_SHARE``, ``PAIR_SHARE``), so what it reads
   is bounded by 1/share whatever the corpus size.
3. A second pass repairs each text: words broken across lines are joined, spaced-out words closed,
   a word outside the frequent vocabulary is linked to the frequent words that plausible glyph
   edits lead to, and replaced by the one whose vector fits the words around it; then page numbers
   and running headers are removed and broken lines reflowed. Whole texts are processed.

A running header is a line template that the corpus shows to interrupt sentences; page marks have
their own grammar. Defined results: null stays null; an empty or blank text stays as it is; the
order and number of rows is kept; repeated rows are repaired alike; an empty table gives an empty
result; extra columns are kept, but for the names added here, which are overwritten.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_SHARE = 2e-5
PAIR_SHARE = 4e-6
LINE_SHARE = 2e-6
DIMENSIONS = 24
WINDOW = 2
COUNTED = ["kind", "a", "b", "n", "m", "dn", "dm"]
RARE_RATIO = 50
WORD_CHARS = 64
FIT = 0.12

# Glyph confusions of scanning, what is read for what was printed.
GLYPHS = (
    ("rn", "m"), ("cl", "d"), ("ii", "u"), ("ii", "n"), ("vv", "w"), ("h", "li"), ("1", "i"), ("1", "l"), ("0", "o"), ("5", "s"), ("c", "e"), ("b", "h"), ("f", "t"), ("9", "g"),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("'i'", "t"), ("8", "b"), ("6", "b"), ("ri", "n"), ("|", "l"), ("lc", "k"), ("2", "z"), ("nn", "m"), ("q", "g"),
)
BREAK = re.compile(r"(?<=[^\W\d_])[-­¬‐‑][ \t\f]*\r?\n\s*(?=[^\W\d_])|(?<=\w)­\s*(?=\w)|(?<=[^\W\d_])¬\s*(?=[^\W\d_])")
SPACED = re.compile(r"(?<!\S)[^\s|](?:[ \u00a0]+[^\s|]){3,}(?!\S)")
WORD = re.compile(r"'I'[^\W_]+|[^\W_]+(?:['|][^\W_]+)*")
PAGE_LINE = re.compile(r"^[ \t\f\v\r]*(?:[-–—]+ ?\d{1,5} ?[-–—]+|\d{1,5}|\d{1,4} ?/ ?\d{1,4}|\[?(?:p|pp|pg|page|seite|página|pág)\.? ?\d{1,5}(?: ?(?:of|von|de|sur|/) ?\d{1,5})?\]?)[ \t\f\v\r]*$", re.I)
PAGE_INLINE = re.compile(r"(?<!\S)(?:[—–] ?\d{1,5} ?[—–]|\[(?:p|pp|page)\.? ?\d{1,5}\]|Page \d{1,5} of \d{1,5})(?!\S)")
CUT_OFF = re.compile(r"\s*(?:…|\.\.\.)?\s*")
SENTENCE_END = re.compile(r"[.;:!?)\]>|}*]\s*$")


def words_of(text: str) -> list[str]:
    """Lower-case words; numbers as "0", codes with three digits or more as "#"."""
    out = []
    for w in WORD.findall(text):
        if w.isalpha():
            out.append(w.lower())
        elif w.isdigit():
            out.append("0")
        else:
            out.append("#" if sum(c.isdigit() for c in w) > 2 else w.lower())
    return out


class WordIds(dict):
    """Memo from a blank-free piece of text to the ids of its counted words; ids in order of appearance."""

    def __init__(self):
        super().__init__()
        self.forms: dict[str, int] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = self[piece] = tuple(self.forms.setdefault(w, len(self.forms)) for w in words_of(piece))
        return out


def line_template(line: str) -> str | None:
    """The shape of a short line that could be a running header: digits masked, outer page numbers off.

    A line that begins with a small letter or ends in a broken word belongs to its sentence.
    """
    s = line.strip()
    if not 5 <= len(s) <= 90 or SENTENCE_END.search(s) or s[0] in "|!{<\\#*(-+_&" or s[0].islower() or s[-1] in "-\xad¬‐‑":
        return None
    if SPACED.fullmatch(s):
        s = close_spaced(s)
    if len(s) > 60:
        return None
    s = re.sub(r"^\d{1,5}\s{2,}|\s{2,}\d{1,5}$", "", s)
    if not re.search(r"[^\W\d]\S*\d|\d\S*[^\W\d]", s) and not re.search(r"\d", s):
        return None
    return re.sub(r"\d+", "0", re.sub(r"\s+", " ", s)).lower()


def close_spaced(match_text: str) -> str:
    """ "T e s t   r u n" to "Test run"."""
    return " ".join(re.sub(r"(?<=\S)[  ](?=\S)", "", part) for part in re.split(r"[  ]{2,}", match_text))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, a, b, n, m, dn, dm) from (text, copies): words (w), pairs (p) and line templates (l) with how
    often one breaks a sentence (m), by copies (n, m) and by distinct texts (dn, dm)."""
    known = WordIds()
    codes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    counts, distinct = Counter(), Counter()
    lines: dict[str, list[int]] = {}
    base = 1 << 31

    def merge() -> None:
        nonlocal codes, held
        if codes:
            keys, n = np.unique(np.concatenate([c[0] for c in codes]), return_inverse=True)
            sums = [np.bincount(n, weights=np.concatenate([c[k] for c in codes])).astype(np.int64) for k in (1, 2)]
            codes, held = [(keys, *sums)], len(keys)

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal codes, held
        merge()
        names = list(known.forms)
        zeros = [0] * len(names)
        yield _rows([["w"] * len(names), names, [""] * len(names), [counts[i] for i in known.forms.values()], zeros, [distinct[i] for i in known.forms.values()], zeros])
        if codes:
            keys, sums, texts = codes[0]
            own = pa.array(names, pa.string())
            left, right = own.take(pa.array(keys // base)), own.take(pa.array(keys % base))
            zero = pa.array(np.zeros(len(keys), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(["p"] * len(keys)), left, right, pa.array(sums), zero, pa.array(texts), zero], names=COUNTED)
        if lines:
            ls = list(lines.items())
            yield _rows([["l"] * len(ls), [k for k, _ in ls], [""] * len(ls), *([v[i] for _, v in ls] for i in range(4))])
        known.clear(), known.forms.clear(), counts.clear(), distinct.clear(), lines.clear()
        codes, held = [], 0

    for batch in batches:
        ids: list[int] = []
        weights: list[int] = []
        sizes: list[int] = []
        gap = [-1] * WINDOW
        for text, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if "\n" in text:
                parts = text.split("\n")
                for i, line in enumerate(parts):
                    if (t := line_template(line)) is not None:
                        broken = 0 < i < len(parts) - 1 and _open_end(parts, i)
                        entry = lines.setdefault(t, [0, 0, 0, 0])
                        entry[0] += copies
                        entry[1] += copies * broken
                        entry[2] += 1
                        entry[3] += broken
                text = BREAK.sub("", text)
            before = len(ids)
            ids.extend(chain.from_iterable(map(known.__getitem__, text.split())))
            ids.extend(gap)
            weights.append(copies)
            sizes.append(len(ids) - before)
        flat = np.array(ids, dtype=np.int64)
        if not len(flat):
            continue
        copies_at = np.repeat(np.array(weights, dtype=np.int64), sizes)
        present, at, n = np.unique(flat, return_inverse=True, return_counts=True)
        sums = np.bincount(at, weights=copies_at).astype(np.int64)
        words = present >= 0
        counts.update(dict(zip(present[words].tolist(), sums[words].tolist())))
        distinct.update(dict(zip(present[words].tolist(), n[words].tolist())))
        found, copied = [], []
        for step in range(1, WINDOW + 1):
            a, b = flat[:-step], flat[step:]
            ok = (a >= 0) & (b >= 0)
            found.append(a[ok] * base + b[ok])
            copied.append(copies_at[:-step][ok])
        keys, at, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        codes.append((keys, np.bincount(at, weights=np.concatenate(copied), minlength=len(keys)).astype(np.int64), n.astype(np.int64)))
        held += len(keys)
        if held > 3_000_000:
            merge()
        if held > 2_000_000 or len(known) > 1_000_000:
            yield from emit()
    yield from emit()


def _rows(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int64()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=COUNTED)


def _open_end(parts: list[str], i: int) -> bool:
    """The line before line ``i`` stops in mid-sentence and the one after goes on."""
    before, after = parts[i - 1].rstrip(), parts[i + 1].lstrip()
    return bool(before and after and not SENTENCE_END.search(before) and (after[0].islower() or after[0].isdigit()))


@dataclass
class ScanModel:
    """Frequent words with their counts by copies and by distinct texts, their vectors, and running-header templates."""

    counts: dict[str, int] = field(default_factory=dict)
    distinct: dict[str, int] = field(default_factory=dict)
    inner: np.ndarray | None = None
    outer: np.ndarray | None = None
    index: dict[str, int] = field(default_factory=dict)
    headers: frozenset[str] = frozenset()

    def dwarfs(self, word: str, other: str) -> bool:
        """``word`` is more than RARE_RATIO times as frequent as ``other``, by copies or by distinct texts."""
        return any(n[word] > RARE_RATIO * max(1, n.get(other, 0)) for n in (self.counts, self.distinct))

    def fit(self, word: str, around: list[str]) -> float:
        """Mean skip-gram probability of the words around ``word``; 1 where nothing is known around it."""
        rows = [self.index[a] for a in around if a in self.index]
        if not rows or word not in self.index:
            return 1.0
        z = self.outer[rows] @ self.inner[self.index[word]]
        return float(np.mean(1 / (1 + np.exp(-z))))


def train_skip_gram(counts: dict[str, int], pairs: list[tuple[str, str, int]], dimensions: int = DIMENSIONS, negatives: int = 4, epochs: int = 60, seed: int = 5) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Skip-gram vectors with negative sampling from pair counts (full-batch Adagrad)."""
    index = {w: i for i, w in enumerate(sorted(counts))}
    rng = np.random.default_rng(seed)
    size = max(1, len(index))
    inner = rng.normal(0, 0.1, (size, dimensions))
    outer = rng.normal(0, 0.1, (size, dimensions))
    rows = [(index[a], index[b], n) for a, b, n in pairs if a in index and b in index]
    if not rows:
        return index, inner.astype(np.float32), outer.astype(np.float32)
    a = np.array([r[0] for r in rows] + [r[1] for r in rows])
    b = np.array([r[1] for r in rows] + [r[0] for r in rows])
    n = np.array([r[2] for r in rows] * 2, dtype=float) ** 0.5
    share = np.array([counts[w] for w in sorted(counts)], dtype=float) ** 0.75
    share /= share.sum()
    ga, gb = np.full_like(inner, 1e-6), np.full_like(outer, 1e-6)
    for _ in range(epochs):
        da, db = np.zeros_like(inner), np.zeros_like(outer)
        for other, label, weight in [(b, 1.0, n), *[(rng.choice(size, len(a), p=share), 0.0, n) for _ in range(negatives)]]:
            z = np.einsum("ij,ij->i", inner[a], outer[other])
            g = ((label - 1 / (1 + np.exp(-z))) * weight)[:, None]
            np.add.at(da, a, g * outer[other])
            np.add.at(db, other, g * inner[a])
        ga += da**2
        gb += db**2
        inner += 0.3 * da / np.sqrt(ga)
        outer += 0.3 * db / np.sqrt(gb)
    return index, inner.astype(np.float32), outer.astype(np.float32)


def learn(texts: DataFrame) -> ScanModel:
    """``texts``: string columns only."""
    each = texts.select(F.explode(F.array(*texts.columns)).alias("t")).filter("t <> ''").groupBy("t").agg(F.count("*").alias("copies"))
    raw = each.mapInArrow(_count_batches, "kind string, a string, b string, n long, m long, dn long, dm long")
    stats = raw.groupBy("kind", "a", "b").agg(*[F.sum(c).alias(c) for c in COUNTED[3:]]).persist()
    try:
        totals = {r["kind"]: r for r in stats.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("dn").alias("dn")).collect()}
        if "w" not in totals:
            return ScanModel()
        least = [(k, c, max(3.0, totals[k][c] * s)) for k, s in (("w", WORD_SHARE), ("p", PAIR_SHARE), ("l", LINE_SHARE)) if k in totals for c in ("n", "dn")]
        kept = stats.filter(" OR ".join(f"(kind = '{k}' AND {c} >= {v})" for k, c, v in least)).filter("kind <> 'l' OR m >= 2").collect()
    finally:
        stats.unpersist()
    counts, distinct = ({r["a"]: r[c] for r in kept if r["kind"] == "w"} for c in ("n", "dn"))

    def weight(r: Row) -> int:
        """By copies or by distinct texts, whichever gives the word or pair the larger share of its kind."""
        return max(r["n"], round(r["dn"] * totals[r["kind"]]["n"] / totals[r["kind"]]["dn"]))

    pairs = [(r["a"], r["b"], weight(r)) for r in kept if r["kind"] == "p"]
    index, inner, outer = train_skip_gram({r["a"]: weight(r) for r in kept if r["kind"] == "w"}, pairs)
    headers = frozenset(r["a"] for r in kept if r["kind"] == "l" and (r["m"] >= 0.02 * r["n"] or r["dm"] >= 0.02 * r["dn"]))
    return ScanModel(counts, distinct, inner, outer, index, headers)


class Pieces(dict):
    """Memo from a blank-free piece of text to its words that may be misread."""

    def __init__(self, repairer: Repairer):
        super().__init__()
        self.repairer = repairer

    def __missing__(self, piece: str) -> tuple[str, ...]:
        words = {w.lower() for w in WORD.findall(piece)} - self.repairer.common
        out = tuple(w for w in words if not w.isdigit() and self.repairer.linked(w))
        if len(self) < 500_000:
            self[piece] = out
        return out


class Repairer:
    """Applies a ScanModel to single texts; memos are per task."""

    def __init__(self, model: ScanModel):
        self.model = model
        self.links: dict[str, tuple[str, ...]] = {}
        sizes = [len(w) for w in model.counts if len(w) <= WORD_CHARS]
        reach = 2 * max(abs(len(read) - len(printed)) for read, printed in GLYPHS)
        self.shortest, self.longest = min(sizes, default=0) - reach, max(sizes, default=0) + reach
        # a frequent word that one glyph edit turns into a far more frequent one is suspect itself
        self.suspect = {w for w in model.counts if any(model.dwarfs(c, w) for c in self._edits(w))}
        self.common = set(model.counts) - self.suspect
        self.pieces = Pieces(self)
        self.beginnings = {w[:k] for w in self.common for k in range(1, len(w))}

    def _edits(self, word: str) -> set[str]:
        """Frequent words that one or two glyph edits lead to; none is far longer or shorter, and no word has over WORD_CHARS letters."""
        found: set[str] = set()
        if not self.shortest <= len(word) <= self.longest:
            return found
        level, seen = {word}, {word}
        for _ in range(2):
            fresh = set()
            for w in level:
                for read, printed in GLYPHS:
                    at = w.find(read)
                    while at >= 0:
                        fresh.add(w[:at] + printed + w[at + len(read):])
                        at = w.find(read, at + 1)
            level = fresh - seen
            seen |= level
            hits = {w for w in level if w in self.model.counts and len(w) > 1 and w.isalpha()}
            found |= hits
            if found or len(level) > 400:
                break
        return found

    def linked(self, word: str) -> tuple[str, ...]:
        if word not in self.links:
            if len(self.links) > 200_000:
                self.links.clear()
            self.links[word] = tuple(sorted(c for c in self._edits(word) if self.model.dwarfs(c, word) and c not in self.suspect))
        return self.links[word]

    def correct(self, text: str) -> tuple[str, int]:
        """Misrecognised words replaced where a linked word fits the context."""
        if not text:
            return text, 0
        odd = set(chain.from_iterable(map(self.pieces.__getitem__, text.split())))
        if not odd:
            return text, 0
        spans = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
        lows = [s[2].lower() for s in spans]
        out, last, changed = [], 0, 0
        for i, (start, end, word) in enumerate(spans):
            if lows[i] not in odd or word.isupper() and len(word) < 3 or i == len(spans) - 1 > 6 and lows[i] in self.beginnings and CUT_OFF.fullmatch(text, end):
                continue  # codes, and a last word that may be a frequent one cut off
            around = ["0" if w.isdigit() else w for w in lows[max(0, i - WINDOW):i] + lows[i + 1:i + 1 + WINDOW]]
            fits = sorted(((self.model.fit(c, around), c) for c in self.linked(lows[i])), reverse=True)
            if fits and fits[0][0] >= FIT:
                best = fits[0][1]
                best = best.upper() if word.isupper() and len(word) > 1 and word.isalpha() else best.capitalize() if word[0].isupper() or word.startswith("'I'") or i == 0 and not word[0].islower() or self._starts(text, start) and not word[0].isalpha() else best
                out += [text[last:start], best]
                last, changed = end, changed + 1
        return "".join([*out, text[last:]]), changed

    @staticmethod
    def _starts(text: str, at: int) -> bool:
        before = text[:at].rstrip()
        return not before or before[-1] in ".!?"

    def repair(self, text: str | None) -> tuple[str | None, int, int, int, int]:
        """(text, words joined, words closed, glyphs corrected, furniture removed)."""
        if not text:
            return text, 0, 0, 0, 0
        furniture = 0
        if "\n" in text:
            parts = text.split("\n")
            kept = []
            for line in parts:
                if PAGE_LINE.match(line) or (t := line_template(line)) is not None and t in self.model.headers and len(parts) > 1:
                    furniture += 1
                else:
                    kept.append(line)
            if furniture:
                text = "\n".join(kept)
        text, inline = PAGE_INLINE.subn(" ", text)
        furniture += inline
        joined = 0
        if "\n" in text or "\xad" in text or "¬" in text:
            text, joined = BREAK.subn("", text)
        closed = 0

        def close(m: re.Match) -> str:
            nonlocal closed
            plain = close_spaced(m.group())
            letters, digits = sum(c.isalpha() for c in plain), sum(c.isdigit() for c in plain)
            if letters < 4 or letters + digits < 0.6 * len(plain) or any(c in plain for c in "={}$\\<>"):
                return m.group()
            closed += 1
            return plain

        if "  " in text or SPACED.search(text):
            text = SPACED.sub(close, text)
        text, glyphs = self.correct(text)
        if furniture or joined:
            text = reflow(text)
        return text, joined, closed, glyphs, furniture


def reflow(text: str) -> str:
    """Lines broken in mid-sentence run on; paragraphs, lists and marked-up lines stay."""
    lines = text.split("\n")
    out: list[str] = []
    for line in lines:
        s = line.strip()
        if out and s and out[-1] and not SENTENCE_END.search(out[-1]) and (s[0].islower() or s[0].isdigit()):
            out[-1] = f"{out[-1].rstrip()} {s}"
        else:
            out.append(line.rstrip())
    return re.sub(r"[ \t]{2,}", " ", "\n".join(out))


def repaired(rows: DataFrame, columns: list[str], model: ScanModel) -> DataFrame:
    """``rows`` with, for each named column c, ``c`` repaired and ``traces``, the number of repairs of the row by kind."""
    kinds = ("joined", "closed", "glyphs", "furniture")
    fields = [f for f in rows.schema.fields if f.name not in kinds]
    rows = rows.select(*[f.name for f in fields])
    schema = T.StructType([*fields, *[T.StructField(k, T.IntegerType()) for k in kinds]])
    at = [rows.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Repairer(model)
        for batch in batches:
            sums = np.zeros((batch.num_rows, 4), dtype=np.int32)
            arrays = list(batch.columns)
            for i in at:
                done = [fix.repair(t) for t in arrays[i].to_pylist()]
                arrays[i] = pa.array([r[0] for r in done], pa.string())
                if done:
                    sums += np.array([r[1:] for r in done], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(sums[:, k]) for k in range(4)]], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def repaired_clauses(clauses: DataFrame) -> DataFrame:
    model = learn(clauses.select("title", "text"))
    return repaired(clauses.select("clause_key", "title", "text"), ["title", "text"], model)


def scanned_clauses(clauses: DataFrame) -> DataFrame:
    """(clause_key) of the rows with a trace of scanning in title or text."""
    return repaired_clauses(clauses).filter("joined + closed + glyphs + furniture > 0").select("clause_key").distinct()
