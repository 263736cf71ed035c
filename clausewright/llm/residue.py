"""Template residue, filler and error-page text found by character n-gram likelihood ratios.

Three character models (order ``ORDER``, interpolated down to single characters) are fitted:
filler and placeholders, error and script notices, and natural prose. The first two learn from
the seed phrases below, the third from all rows of the corpus: tasks add up hashed n-gram counts in
tables of fixed size, which are summed by range of hashes before the driver reads them. Rows that
already look like residue under one fit are taken off the counts for the next.
Every text is then scanned whole: the log-likelihood ratio of each character is looked up
in hashed tables, summed over sliding windows, and stretches above the threshold are residue.
An exact check of the located stretch follows (is it a placeholder, a seed-like sentence, or only
a blank form line?). Rows whose residue coverage exceeds a limit can be excluded whole.

Defined results: null, empty and blank texts hold no residue; rows keep their number and order;
repeated rows are judged alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = 5
#: size of the hashed tables, as a power of two, of 1-grams to 5-grams
BITS = (12, 16, 18, 20, 20)
WINDOWS = (10, 28, 60)
CLIP = 7.0
UNSEEN = -0.5
SCALE = 1024
NEVER = -32768
FIRST_CUT = (40.0, 45.0, 50.0)
CANDIDATE = (3.0, 6.0, 9.0)
LEAST = (16.0, 16.0, 18.0)
PAD = max(WINDOWS)
SHARDS = 256
TASKS_PER_CORE = 8
BLOCK = 1 << 15
COPY_SHARE = 1e-3
LEAST_COPIES = 50
NONE = np.uint64((1 << 64) - 1)

# Seed phrases of filler and unfinished templates.
FILLER = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Vivamus semper porta nostra, ullam tempor magnis quare ipsa dolet velit viva, neque vorem quisquam est qui dolorem.",
    "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.",
    "asdf asdf qwer", "asdf jkl qwerty", "xxxxx xxxxxx xxx xxxxxxxx xxxx", "xxxxxxxxxxxx", "XXXX XXXX XXXX", "bla bla bla", "foo bar baz", "test test test", "Text text text text text text.",
    "Sample text. Replace with the final wording.", "Sample text", "This is sample text.", "Dummy text", "Placeholder text", "Placeholder paragraph, wording to follow from the drafting group.", "Wording to follow.",
    "TODO: write this clause", "TODO", "TBD", "TBC", "FIXME", "To be completed", "To be defined", "To be determined", "To be added", "Text to be added here", "Text to be inserted", "Draft text, to be replaced",
    "Click here to add text.", "Click to add title", "Click to add text", "Click or tap here to enter text.", "Choose an item.", "Enter text here", "Type the text of the paragraph here", "Type your text here", "Write your text here",
    "Insert heading here", "Insert text here", "Insert title here", "Insert paragraph here", "TITLE GOES HERE", "Title goes here", "Text goes here", "Heading goes here", "Body copy goes here - 0 words", "Your text here", "Your title here", "Add your text here",
    "Hier Text einfügen", "Platzhaltertext", "Blindtext, bitte ersetzen", "Text folgt", "Insérer le texte ici", "Texte à compléter", "Texte provisoire", "Insertar texto aquí", "Texto de ejemplo", "Texto pendiente de redactar",
)
# Seed phrases of error pages, script notices and export faults.
NOTICES = (
    "404 Not Found. The requested page could not be located on this server.", "The requested regulation page could not be located on this server.", "The requested URL was not found on this server.", "404 Page not found", "The page you are looking for does not exist.",
    "HTTP Error 500: Internal Server Error", "HTTP Error 403: access to /path/file is forbidden", "Internal server error, reference", "403 Forbidden", "Access denied.", "You do not have permission to view this content. Contact your administrator.", "You are not authorized to view this page.",
    "503 Service Temporarily Unavailable - gateway 0, request", "Service unavailable", "502 Bad Gateway", "504 Gateway Timeout", "The server is temporarily unable to service your request.", "The connection has timed out.", "Server error, please try again later.",
    "Please enable JavaScript in your browser to view this document.", "JavaScript is required to view this page.", "JavaScript is disabled in your browser.", "This application needs scripts to be switched on. Turn them on and reload.", "You need to enable JavaScript to run this app.", "This page requires scripts.", "Please turn on JavaScript and reload the page.",
    "Just a moment... We are checking your browser before you may proceed. Cookies and JavaScript must be active.", "Checking your browser before accessing the site.", "Please enable cookies.", "Verify you are human", "Complete the captcha to continue.",
    "Your session has expired. Sign in again to continue reading.", "Session expired, please log in again.", "Please log in to continue.", "This page has moved. You will be redirected in 0 seconds.", "You are being redirected.", "Loading... If this page does not appear within 0 seconds, click here.", "Loading, please wait.", "If you are not redirected, click here.",
    "Oops! Something went wrong while loading section 0. Try again later.", "Something went wrong. Please try again.", "An unexpected error occurred.", "An error occurred while processing your request.", "Sorry, this content is not available.", "This content is no longer available.",
    "Traceback (most recent call last): File \"export.py\", line 0, in render KeyError: 'text'", "ValueError: invalid literal", "TypeError: object is not callable", "java.lang.NullPointerException at doc.Render.clause(Render.java:0)", "java.lang.IllegalStateException at com.example.App.main(App.java:0)", "Unhandled exception at line 0", "Fatal error: Uncaught exception in /var/www/html/index.php on line 0", "Warning: mysql_connect(): access denied for user", "Segmentation fault (core dumped)", "Error 0x80070005", "#REF! #VALUE! #N/A",
    "Unable to convert this object: unsupported format (code 0).", "Error! Reference source not found.", "Error! Bookmark not defined.", "The image cannot be displayed.", "Could not open the file.", "File could not be converted.",
    "Diese Seite ist nicht verfügbar (Fehler 0). Bitte aktivieren Sie JavaScript.", "Seite nicht gefunden", "Interner Serverfehler", "Zugriff verweigert", "Bitte aktivieren Sie Cookies.", "Ihre Sitzung ist abgelaufen.", "Ein Fehler ist aufgetreten. Bitte versuchen Sie es später erneut.",
    "Cette page est introuvable. Activez JavaScript puis actualisez.", "Page non trouvée", "Erreur interne du serveur", "Accès refusé", "Veuillez activer JavaScript.", "Votre session a expiré.", "Une erreur est survenue. Veuillez réessayer plus tard.",
    "Página no encontrada", "Esta página no está disponible. Active JavaScript y vuelva a cargar.", "Error interno del servidor", "Acceso denegado", "Su sesión ha caducado.", "Se ha producido un error. Inténtelo de nuevo más tarde.",
)
# Delimiters and names of template placeholders.
DELIMITERS = (("{{", "}}"), ("{{ ", " }}"), ("${", "}"), ("{%", "%}"), ("{% ", " %}"), ("<%", "%>"), ("<%= ", " %>"), ("<<", ">>"), ("<", ">"), ("[", "]"), ("[[", "]]"), ("@@", "@@"), ("%%", "%%"), ("##", "##"), ("$", "$"), ("__", "__"), ("{", "}"))
NAMES = (
    "TO BE COMPLETED", "INSERT VALUE", "INSERT TEXT", "insert text here", "insert vehicle type", "INSERT section title", "enter name of applicant", "enter_date", "date to be inserted", "your text here", "applicant.name", "approval_no", "limit_value", "section.text", "section.title", "title", "name",
    "CLAUSE_TITLE", "REG_TITLE", "CLAUSE_TEXT", "company_name", "DATE", "value", "number to be added", "TBD", "placeholder", "type approval number", "manufacturer", "document.title", "paragraph text",
)
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,80}\}\}|\$\{[^{}\n]{1,80}\}|\{%[^{}\n]{1,80}%\}|<%[^<>\n]{1,80}%>|<<[^<>\n]{1,80}>>|@@[^@\n]{1,80}@@|%%[^%\n]{1,80}%%|##[\w .]{2,60}##|__[A-Za-z][\w. ]{2,60}__"
    r"|[<\[]{1,2}\s*(?:to be |insert |enter |your |add |type |date to |tbd|tbc|todo|placeholder|xx)[^<>\[\]\n]{0,80}[>\]]{1,2}|<[A-Z][A-Z0-9]*_[A-Z0-9_]+>|<[a-z]+_[a-z_]+>|<[a-z]+\.[a-z.]+>|\[[A-Za-z]+[_.][A-Za-z_.]+\]|\bTO BE (?:COMPLETED|INSERTED|ADDED|DEFINED|CONFIRMED)\b",
    re.I,
)
BLANK_FORM = re.compile(r"^[\s._…\-–()\d:]*$")


def _folded() -> np.ndarray:
    """Code point to a code of twelve bits: digits as "0", blanks as " ", those beyond 4,095 folded; 0 stays 0."""
    at = np.arange(0x110000)
    out = np.where(at < 4096, at, 0x800 | (at & 0x7FF))
    out[48:58] = 48
    out[[9, 10, 160]] = 32
    return out.astype(np.uint16)


CODE = _folded()


def codes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the lower-case characters of all texts, zeros of length PAD around each; start of each text."""
    lows = [t.replace("\x00", " ").lower() if t else "" for t in texts]
    gap = "\x00" * PAD
    flat = gap + gap.join(lows) + gap
    codes = CODE[np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    sizes = np.fromiter(map(len, lows), np.int64, len(lows))
    starts = PAD + np.concatenate(([0], np.cumsum(sizes + PAD)[:-1])) if len(texts) else np.zeros(0, np.int64)
    return codes, starts.astype(np.int64)


def keys_of(codes: np.ndarray) -> np.ndarray:
    """The ORDER codes that end at each position in one number, the last one lowest."""
    keys = codes.astype(np.uint64)
    wide = keys.copy()
    for k in range(1, ORDER):
        keys[k:] |= wide[:-k] << np.uint64(12 * k)
    return keys


def cells(keys: np.ndarray, n: int) -> np.ndarray:
    """Hash of the last n codes of each key."""
    return ((keys & np.uint64((1 << 12 * n) - 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS[n - 1])).view(np.int64)


def blocks_of(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of about BLOCK characters, so that the arrays of a run stay in a core's cache."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += PAD + (len(t) if t else 0)
        if held >= BLOCK:
            yield slice(first, i + 1)
            first, held = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def seed_sentences() -> re.Pattern:
    """The seed phrases, and their sentences of three words or more, in any letter case and with any numbers."""
    parts = {p.strip() for t in (*FILLER, *NOTICES) for p in (t, *re.split(r"(?<=[.!?:])\s+", t)) if len(p.split()) >= 3}
    # no blank form or single word, which prose may hold too
    literal = [re.sub(r"\d+", r"\\d+", re.escape(p.rstrip(".!"))) for p in sorted(parts, key=lambda p: (-len(p), p))]
    return re.compile("|".join(literal), re.I)


SEEDED = seed_sentences()
#: the longest part without a number of each seed sentence, in lower case: a text without any holds no seed sentence
SEED_PARTS = tuple(sorted({max(re.split(r"\d+", p.rstrip(".!").lower()), key=len) for t in (*FILLER, *NOTICES) for p in (t, *re.split(r"(?<=[.!?:])\s+", t)) if len(p.strip().split()) >= 3}))
SEED_PARTS = tuple(p for p in SEED_PARTS if not any(q != p and q in p for q in SEED_PARTS))


def spans_of(keys: np.ndarray) -> np.ndarray:
    """Hash of the 2 * ORDER codes that end at each position."""
    wide = keys.copy()
    wide[ORDER:] += keys[:-ORDER] * np.uint64(0xD6E8FEB86659FD93)
    return (wide * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS[-1])).view(np.int64)


def _seed_spans() -> np.ndarray:
    """Per hash of 2 * ORDER codes: whether the stretch of a seed part with the rarest characters falls there."""
    often = Counter("".join(SEED_PARTS))
    out = np.zeros(1 << BITS[-1], bool)
    for p in SEED_PARTS:
        k = min(range(len(p) - 2 * ORDER + 1), key=lambda i: sum(math.log(often[c]) for c in p[i:i + 2 * ORDER]))
        codes, starts = codes_of([p[k:k + 2 * ORDER]])
        out[spans_of(keys_of(codes))[starts + 2 * ORDER - 1]] = True
    return out


SEED_SPANS = _seed_spans()


#: what a match of PLACEHOLDER holds: one of these, a bracket before a letter, or "to be "
DOUBLE = ("{{", "${", "{%", "<%", "<<", "@@", "%%", "##", "__")
BRACKET = re.compile(r"[<\[]\s*[^\W\d_]")


def has_placeholder(text: str) -> bool:
    maybe = any(d in text for d in DOUBLE) or ("<" in text or "[" in text) and BRACKET.search(text) or "to be " in text.lower()
    return bool(maybe) and PLACEHOLDER.search(text) is not None


def has_seed(text: str) -> bool:
    low = text.lower()
    return any(p in low for p in SEED_PARTS) and SEEDED.search(text) is not None


def is_seeded(text: str) -> bool:
    """Whether the text holds a placeholder by its syntax or a seed sentence."""
    return has_placeholder(text) or has_seed(text)


def part_of(table: np.ndarray, shard: int) -> slice:
    width = len(table) // SHARDS
    return slice(shard * width, (shard + 1) * width)


class Tally:
    """Counts of the n-grams by hash; of the (1 to ORDER-1)-grams how many end a text and so have no character after
    them; and of each hash of 5-grams and 3-grams the smallest gram itself."""

    def __init__(self, parts: int = 1, kind: type = np.int64):
        """``parts``: into how many ranges of hashes the tables are cut, of which this holds one."""
        self.counts = [np.zeros((1 << BITS[k % ORDER]) // parts, kind) for k in range(2 * ORDER - 1)]
        self.grams = {n: np.full((1 << BITS[n - 1]) // parts, NONE) for n in (ORDER, 3)}

    def add(self, texts: list[str], seeded: bool = False) -> None:
        """Counts ``texts``, but those with a placeholder or seed sentence only if ``seeded``."""
        held: list[list[np.ndarray]] = []
        for part in blocks_of(texts):
            block = texts[part]
            codes, starts = codes_of(block)
            keys = keys_of(codes)
            top = cells(keys, ORDER)
            inside = codes > 0
            ends = np.append(starts[1:], len(codes)) - PAD - 1
            filled = ends >= starts
            if not seeded:
                # a text with a seed sentence holds its part's stretch; such texts are looked at one by one
                maybe = np.logical_or.reduceat(SEED_SPANS[spans_of(keys)], starts - PAD)
                for i in range(len(block)):
                    if has_placeholder(block[i]) or maybe[i] and has_seed(block[i]):
                        inside[starts[i]:ends[i] + 1] = False
                        filled[i] = False
            keys, top, last = keys[inside], top[inside], keys[ends[filled]]
            held.append([*[cells(keys, n) for n in range(1, ORDER)], top, *[cells(last, n) for n in range(1, ORDER)]])
            self.smallest(3, held[-1][2], keys & np.uint64((1 << 36) - 1))
            self.smallest(ORDER, top, keys)
        for k, total in enumerate(self.counts):
            if held:
                np.add(total, np.bincount(np.concatenate([h[k] for h in held]), minlength=len(total)), out=total, casting="unsafe")

    def smallest(self, order: int, at: np.ndarray, keys: np.ndarray) -> None:
        known = self.grams[order]
        better = keys < known[at]
        if better.any():
            np.minimum.at(known, at[better], keys[better])

    def contexts(self) -> list[np.ndarray]:
        """Per length from 1 to ORDER-1 how often the gram comes before a character; cell 0 also stands for a text's start."""
        out = [a - b for a, b in zip(self.counts, self.counts[ORDER:])]
        for c in out:
            c[0] += self.counts[ORDER].sum()
        return out

    def parts(self) -> Iterator[tuple[int, bytes]]:
        """(shard, counts and grams of its range of hashes)."""
        for shard in range(SHARDS):
            if any(c[part_of(c, shard)].any() for c in self.counts):
                yield shard, self.packed(shard)

    def packed(self, shard: int | None = None) -> bytes:
        own = [c if shard is None else c[part_of(c, shard)] for c in self.counts]
        counts = [(np.flatnonzero(c).astype(np.int32), c[c != 0]) for c in own]
        return pickle.dumps((counts, {n: (g if shard is None else g[part_of(g, shard)])[counts[n - 1][0]] for n, g in self.grams.items()}))

    def merge(self, blob: bytes, shard: int = 0) -> None:
        """Adds what ``packed`` gave; ``shard``: the range of the whole tables where it belongs."""
        counts, grams_ = pickle.loads(blob)
        for total, (i, n) in zip(self.counts, counts):
            total[i + part_of(total, shard).start] += n
        for n, keys in grams_.items():
            self.smallest(n, counts[n - 1][0] + part_of(self.grams[n], shard).start, keys)

    def keys(self, order: int) -> np.ndarray:
        """One gram per counted hash."""
        return self.grams[order][self.counts[order - 1] > 0]


def once_each(texts: DataFrame) -> DataFrame:
    """``texts`` (one string column) with those texts once only that are more than COPY_SHARE of the rows.

    There are fewer than 1 / COPY_SHARE of these, so the driver may read their hashes; only they are shuffled.
    """
    hashed = texts.select(F.col(texts.columns[0]).alias("t")).filter("t <> ''").withColumn("h", F.xxhash64("t"))
    least = COPY_SHARE * texts.count()
    hot = [r["h"] for r in hashed.groupBy("h").count().filter(F.col("count") > max(LEAST_COPIES, least)).collect()]
    if not hot:
        return hashed.select("t")
    return hashed.filter(~F.col("h").isin(hot)).select("t").unionByName(hashed.filter(F.col("h").isin(hot)).select("t").distinct())


def tallied(texts: DataFrame, model: ResidueModel | None = None, cut: tuple[float, ...] = LEAST) -> Tally:
    """Counts over all rows of ``texts`` (one string column) without a placeholder or seed sentence; with a ``model``, over those of them above ``cut``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            rows = [t for t in batch.column(0).to_pylist() if t]
            if model is not None:
                rows = [t for t, s in zip(rows, model.scores(rows)) if (s >= np.array(cut)).any()]
            tally.add(rows)
        yield blobs(list(tally.parts()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, Tally] = {}
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard not in shards:
                    shards[shard] = Tally(SHARDS)
                shards[shard].merge(blob)
        yield blobs([(shard, t.packed()) for shard, t in shards.items()])

    def blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])

    schema = "shard int, blob binary"
    total = Tally()
    # each task sends tables of up to 2**BITS cells: with TASKS_PER_CORE tasks at most, however large the corpus
    context = texts.sparkSession.sparkContext
    few = texts.coalesce(TASKS_PER_CORE * max(context.defaultParallelism, 1))
    for r in few.mapInArrow(count, schema).repartition("shard").mapInArrow(merge, schema).collect():
        total.merge(bytes(r["blob"]), r["shard"])
    return total


class CharModel:
    """Hashed counts of an interpolated character model."""

    def __init__(self, tally: Tally):
        self.counts, self.contexts = tally.counts[:ORDER], tally.contexts()
        self.size = max(1, int(self.counts[0].sum()))

    def prob(self, keys: np.ndarray, order: int) -> np.ndarray:
        """P(last code | the order-1 codes before it) of each key."""
        p = np.full(len(keys), 1 / 120, np.float64)
        for n in range(1, order + 1):
            context = self.contexts[n - 2][cells(keys >> np.uint64(12), n - 1)] if n > 1 else np.float64(self.size)
            weight = 1.0 if n > 1 else 60.0
            p = (self.counts[n - 1][cells(keys, n)] + weight * p) / (context + weight)
        return p


@dataclass
class ResidueModel:
    """Log-likelihood ratios of both residue classes (two columns), in steps of 1 / SCALE, by hashed 5-gram (NEVER where not seen) and 3-gram.

    Sums of whole numbers don't depend on how texts are cut into blocks.
    """

    full: np.ndarray
    short: np.ndarray

    def ratios(self, codes: np.ndarray) -> np.ndarray:
        keys = keys_of(codes)
        # one look-up of four bytes serves both classes
        both = self.full.view(np.int32).ravel().take(cells(keys, ORDER))
        pairs = both.view(np.int16).reshape(-1, 2)
        miss = np.flatnonzero(pairs[:, 0] == NEVER)
        both[miss] = self.short.view(np.int32).ravel().take(cells(keys[miss], 3))
        both[codes == 0] = 0
        return pairs

    def scan(self, texts: list[str | None]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """By blocks of texts: which, per text and window width the highest window sum over both classes, starts and running sums to locate it."""
        for part in blocks_of(texts):
            codes, starts = codes_of(texts[part])
            pairs = self.ratios(codes)
            totals = [np.zeros(len(codes) + 1, np.int32) for _ in range(2)]
            for k, total in enumerate(totals):
                np.cumsum(pairs[:, k], dtype=np.int32, out=total[1:])  # differences are right even if the sum wraps round
            best = np.empty((len(starts), len(WINDOWS)))
            for k, w in enumerate(WINDOWS):
                sums = totals[0][w:] - totals[0][:-w]
                np.maximum(sums, totals[1][w:] - totals[1][:-w], out=sums)
                best[:, k] = np.maximum.reduceat(sums, starts - PAD)
            yield part, best / SCALE, starts, totals

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.concatenate([np.zeros((0, len(WINDOWS))), *[best for _, best, _, _ in self.scan(texts)]])


def stretches(totals: list[np.ndarray], start: int, size: int, window: int, least: float) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows above ``least`` in the text of ``size`` characters at ``start``."""
    spans: list[tuple[int, int]] = []
    first = start - PAD
    hot = np.zeros(0, np.int64)
    for total in totals:
        part = total[first:start + size + window]
        hot = np.union1d(hot, np.flatnonzero(part[window:] - part[:-window] >= least * SCALE))
    for s in (hot - PAD).tolist():
        a, b = max(0, s), min(size, s + window)
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    return spans


def shuffled_latin(sentences: int = 120, seed: int = 3) -> list[str]:
    """Sentences of the filler's Latin words in random order, for the transitions between words."""
    words = [w.strip(".,").lower() for t in FILLER[:6] for w in t.split()]
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(words, 9)).capitalize() + "." for _ in range(sentences)]


def placeholder_samples() -> list[str]:
    return [f"{a}{n}{b}" for a, b in DELIMITERS[:13] for n in NAMES]


def fit_models(texts: DataFrame, rounds: int = 4) -> ResidueModel:
    """``texts``: natural rows (one string column), which may hold some residue; rows with a placeholder by its
    syntax or with a seed sentence are left out at once, rows above FIRST_CUT, then LEAST, from the next round.

    In the first round prose is modelled by character pairs only: a higher order would have
    learnt the residue among it by heart.
    """
    texts = once_each(texts)
    classes, own = [], []
    for seeds in ((*FILLER, *FILLER, *shuffled_latin(), *placeholder_samples()), NOTICES * 2):
        tally = Tally(kind=np.int32)
        tally.add([f" {t} " for t in seeds], seeded=True)
        classes.append(CharModel(tally))
        own.append({n: tally.keys(n) for n in (ORDER, 3)})
    every = tallied(texts)
    counts = every.counts
    model = None
    for turn in range(rounds):
        if turn:
            odd = tallied(texts, model, LEAST if turn > 1 else FIRST_CUT)
            every.counts = [a - b for a, b in zip(counts, odd.counts)]
            del odd
        natural = CharModel(every)
        model = ResidueModel(np.full((1 << BITS[-1], 2), NEVER, np.int16), np.full((1 << BITS[2], 2), round(UNSEEN * SCALE), np.int16))
        for order, table in ((ORDER, model.full), (3, model.short)):
            for keys in (every.keys(order), *(k[order] for k in own)):
                below = natural.prob(keys, order if turn else 2)
                for k, c in enumerate(classes):
                    table[cells(keys, order), k] = np.round(SCALE * np.clip(np.log(c.prob(keys, order) / below), -CLIP, CLIP))
    return model


def located(text: str, start: int, totals: list[np.ndarray]) -> list[tuple[int, int]]:
    """Residue stretches that pass the exact check: a placeholder's syntax in or next to a candidate window,
    or a window above LEAST whose letters are words rather than a blank form line, a page mark or a rule."""
    out: set[tuple[int, int]] = set()
    size = len(text.lower())
    for window, low, high in zip(WINDOWS, CANDIDATE, LEAST):
        for a, b in stretches(totals, start, size, window, low):
            for m in PLACEHOLDER.finditer(text, max(0, a - 90), min(len(text), b + 90)):
                if m.start() < b + 4 and m.end() > a - 4:
                    out.add(m.span())
        for a, b in stretches(totals, start, size, window, high):
            # one odd word alone is a misspelling
            words = window > WINDOWS[0] or re.search(r"\w\W+\w", text[a:b])
            if words and sum(c.isalpha() for c in text[a:b]) >= 8 and not BLANK_FORM.match(text[a:b]):
                out.add((a, min(b, len(text))))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def residue_rows(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, residue, coverage): whether any of ``columns`` holds residue, and the share of characters it covers."""
    model = fit_models(rows.select(F.concat_ws("\n", *columns).alias("t")))
    schema = T.StructType([rows.schema[key], T.StructField("residue", T.BooleanType()), T.StructField("coverage", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            covered, size = np.zeros(n), np.zeros(n)
            for column in batch.columns[1:]:
                texts = column.to_pylist()
                for part, scores, starts, totals in model.scan(texts):
                    for i in np.flatnonzero((scores >= np.array(CANDIDATE)).any(axis=1)):
                        covered[part.start + i] += sum(b - a for a, b in located(texts[part.start + i], int(starts[i]), totals))
                size += [len(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(covered > 0), pa.array(np.minimum(1.0, covered / np.maximum(size, 1)))], names=[key, "residue", "coverage"])

    return rows.select(key, *columns).mapInArrow(run, schema)


def residue_clauses(clauses: DataFrame) -> DataFrame:
    """(clause_key) of the rows with residue in title or text."""
    return residue_rows(clauses, "clause_key", ["title", "text"]).filter("residue").select("clause_key").distinct()


def without_residue(clauses: DataFrame, limit: float = 0.0) -> DataFrame:
    """``clauses`` without the rows whose residue covers more than ``limit``."""
    bad = residue_rows(clauses, "clause_key", ["title", "text"]).filter(F.col("residue") & (F.col("coverage") > limit)).select("clause_key").distinct()
    return clauses.join(bad, "clause_key", "left_anti")
