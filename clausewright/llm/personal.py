"""Personal information in free text: candidate spans, boosted trees, calibrated thresholds.

Generators with high recall propose overlapping spans of five kinds (email, phone, id_number,
address, person). Boosted trees score each from its format and its surroundings (words around it
by class, neighbouring characters, whether its words occur in lower case in the corpus). Per kind,
a threshold calibrated on held-out documents decides; of overlapping spans the best one stays, and
placeholders take the place of the kept ones. Training documents are written by
``training_documents`` from invented names; the corpus contributes only its vocabulary of
lower-case words, counted over all distinct texts, of which the driver reads those in more than
``DOCUMENT_SHARE`` of them (so no more than an average text's words over that share). Words that
only open sentences may be given names too: names are proposed with and without them.

Defined results: null, empty and blank texts hold nothing; positions count code points; repeated
documents are treated alike; a null doc_id is kept; empty tables give empty results; extra
columns are ignored. Whole texts are searched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.boosting import BoostedTrees

DOCUMENT_SHARE = 2e-4
KINDS = ("email", "phone", "id_number", "address", "person")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    form: int


# Words around personal data, by class, in English, German, French and Spanish.
CUES = {
    "phone": "tel phone telephone telefon téléphone teléfono call mobile mobil fax appeler ring handy móvil rufnummer contact kontakt urgent contacto",
    "id": "passport licence license identity national document documento nr n° number personal ausweis identité identidad dni id ssn nie card karte carte pièce führerschein permis numéro número personalausweis reisepass wies insurance",
    "paper": "certificate report serial batch file part approval reference ref order invoice drawing tag component zertifikat bericht teil rapport référence informe referencia certificat certificado bestellung lot charge version item page lieferung register calibration systems bears under filed",
    "person": "mr mrs ms dr prof by from with an to driver fahrer conducteur conductor herr frau monsieur madame señor señora contact kontakt contacto present regards sincerely signed witness and for consultas demandeur as call matter par por mit",
    "act": "signed disagreed pointed said wrote checked agreed asked declared wies unterschrieb déclare firmó added noted reported objected called confirmed replied présenté lives vive demeurant wohnt on at tel licence correo via hat in",
    "home": "lives address home return demeurant vive wohnt adresse dirección domicilio anschrift resident deliver send gehen ship an to",
    "firm": "laboratory centre center institute board office components metrology authority systems works hill valley park test safety braking road approval vehicle limited ltd gmbh inc ag sa group company university ministry department service technical factory site station proving ground track gate",
}
CUE_SETS = {k: frozenset(v.split()) for k, v in CUES.items()}
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Eng|Sir|Herr|Frau|Mme|Mlle|Sr|Sra|Ing|Dipl)\b\.?"
PARTICLES = r"(?:(?:van|von) de[rn]?|van|von|de|del|da|di|zu|ter|VAN|VON|DE|Van|Von)"
PARTICLE_SET = frozenset(("van de", "van der", "van den", "von de", "von der", "von den", "van", "von", "de", "del", "da", "di", "zu", "ter", "VAN", "VON", "DE", "Van", "Von"))
TITLE = re.compile(TITLES)
AFTER_TITLE = re.compile(TITLES + r"\s+$")
WORD = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’]+|[A-ZÀ-ÖØ-Þ]{2,}"
# patterns that begin with one set of characters are found fastest
NAME_TOKEN = re.compile(rf"[A-ZÀ-ÖØ-Þ](?:(?:[a-zß-öø-ÿ'’]+|[A-ZÀ-ÖØ-Þ]+)(?:-(?:{WORD}))*|(?<!\w.)\.)")
SMALL_PARTICLE = re.compile(r"[dtvz](?<!\w.)(?:(?:an|on)(?: de[rn]?)?|e[l]?|a|i|u|er)\b")
CITY = r"[A-ZÀ-ÖØ-Þ][\wÀ-ÿ'’-]+(?: (?:am |an der |de |sur |del )?[A-ZÀ-ÖØ-Þ][\wÀ-ÿ'’-]+){0,2}"
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|\s?[\[(](?:at|AT|ät|arroba)[\])]\s?)[A-Za-z0-9-]+(?:(?:\.|[ ]?[\[(](?:dot|punkt|point)[\])][ ]?)[A-Za-z0-9-]+)+")
PHONE = re.compile(r"(?<![\w+./-])(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d[\d .-]{5,14}\d|00\d{1,3}[ .-]\d[\d .-]{5,14}\d|\(0?\d{2,4}\)[ .-]?\d{2,4}[ .-]?\d{2,6}(?:[ .-]\d{2,4})?|0\d{1,4}[/ -]\d{3,8}(?:[ -]\d{1,5}){0,3}|\d{3}-\d{4}|\+\d{8,14})(?![\w]|[-./]\d)")
ID = re.compile(r"(?<![\w.+/-])(?:\d{3}-\d{2}-\d{4}|\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}|\d{2} \d{3} \d{3} \d{3}|[A-Z]{1,3}\d{6,9}[A-Z]?|\d{7,9}[A-Z]|\d{6}-\d{4}|\d{9,12}|\d{3} \d{2} \d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z])(?![\w]|[-/]\d|\.\d)")
STREETS = (
    rf"(?:Flat|Apt\.?|Apartment|Unit|Suite) \d+[a-zA-Z]?, \d+ (?:{CITY}) (?:Road|Street|Lane|Avenue|Close|Court|Drive|Way|Place|Square|Gardens|Terrace|Crescent)\b",
    rf"\d+ ?[a-zA-Z]?,? (?:{CITY}) (?:Road|Street|Lane|Avenue|Close|Court|Drive|Way|Place|Square|Gardens|Terrace|Crescent|Rd|St|Ave)\b",
    rf"(?:{CITY}) (?:Road|Street|Lane|Avenue|Close|Court|Drive|Way|Place|Square|Gardens|Terrace|Crescent) \d+ ?[a-z]?\b",
    r"[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer) ?\d+(?: ?[a-z]\b)?",
    r"(?:Am|An der|Im|Auf dem) [A-ZÄÖÜ][\wäöüß-]+ \d+(?: ?[a-z]\b)?",
    r"\d+(?: ?(?:bis|ter|[a-z]))?,? (?:rue|avenue|boulevard|chemin|place|impasse|allée|quai|route) (?:de la |de l'|du |des |de |d')?[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)?",
    r"(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|C/) (?:de la |del |de )?[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)?,? (?:n\.?º ?)?\d+",
)
STREET_RE = [re.compile(r"(?<![\wÀ-ÿ-])" + p) for p in STREETS]
ENGLISH_STREETS = ("Road", "Street", "Lane", "Avenue", "Close", "Court", "Drive", "Way", "Place", "Square", "Gardens", "Terrace", "Crescent")
#: per pattern of STREETS words of which a match holds one
STREET_WORDS = (
    ENGLISH_STREETS, (*ENGLISH_STREETS, "Rd", "St", "Ave"), ENGLISH_STREETS, ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ring", "damm", "ufer"), ("Am ", "An der ", "Im ", "Auf dem "),
    ("rue ", "avenue ", "boulevard ", "chemin ", "place ", "impasse ", "allée ", "quai ", "route "), ("Calle ", "Avenida ", "Avda. ", "Plaza ", "Paseo ", "Camino ", "C/ "),
)
PLACE = re.compile(rf"[,\s]{{1,3}}(?:\d{{4,5}} {CITY}|{CITY} \d{{4,5}}|{CITY}(?=[.,;\n]|$))")
AROUND = re.compile(r"[^\W\d_]+|n°")


def name_tokens(text: str) -> list[re.Match]:
    """Capitalised words, initials and particles in order; a particle inside a word ("O'de") is none."""
    small = [m for m in SMALL_PARTICLE.finditer(text) if m.group() in PARTICLE_SET]
    if not small:
        return list(NAME_TOKEN.finditer(text))
    out: list[re.Match] = []
    for m in sorted([*NAME_TOKEN.finditer(text), *small], key=lambda m: m.start()):
        if not out or m.start() >= out[-1].end():
            out.append(m)
    return out


def name_spans(text: str, known: frozenset[str], openers: frozenset[str] = frozenset()) -> Iterator[Span]:
    """Runs of capitalised words outside the lower-case vocabulary, with initials and particles; single ones after a title.

    Runs that hold ``openers``, known words only seen to open sentences, are proposed whole as well.
    """
    tokens = [(m.start(), m.end(), m.group()) for m in name_tokens(text) if not text[m.start() - 1:m.start()].isalnum() and not text[m.end():m.end() + 1].isalnum()]
    run: list[tuple[int, int, str]] = []

    def is_particle(w: str) -> bool:
        return w in PARTICLE_SET

    def is_initial(w: str) -> bool:
        return len(w) == 2 and w[1] == "."

    def ordinary(w: str) -> bool:
        return not is_initial(w) and not is_particle(w) and all(p.lower() in known for p in w.split("-"))

    def surname(tokens: list[tuple[int, int, str]]) -> list[str]:
        """The words of the run after its last ordinary word or title, without particles."""
        out: list[str] = []
        for _, _, w in tokens:
            if ordinary(w) or TITLE.fullmatch(w):
                out = []
            elif not is_particle(w):
                out.append(w)
        return out

    def pieces_of(parting: Callable[[str], bool]) -> list[list[tuple[int, int, str]]]:
        pieces: list[list[tuple[int, int, str]]] = [[]]
        for t in run:
            if parting(t[2]) or TITLE.fullmatch(t[2]):
                pieces.append([])
            else:
                pieces[-1].append(t)
        return pieces

    def flush() -> Iterator[Span]:
        pieces = pieces_of(ordinary)
        if openers and any(t[2].lower() in openers for t in run):
            whole = pieces_of(lambda w: ordinary(w) and w.lower() not in openers)
            for p in whole:
                # an opener after the name belongs to the next sentence, but for "HOLTMIRE, Fenmora"
                while len(p) > 1 and p[-1][2].lower() in openers and text[p[-2][1]:p[-1][0]] != ", ":
                    p.pop()
            pieces += [p for p in whole if p not in pieces and any(not ordinary(t[2]) and not is_initial(t[2]) and not is_particle(t[2]) for t in p)]
        for piece in pieces:
            while piece and (is_particle(piece[-1][2]) and piece[-1][2].islower()):
                piece.pop()
            full = [t for t in piece if not is_initial(t[2]) and not is_particle(t[2])]
            if not full:
                continue
            start, end = piece[0][0], piece[-1][1]
            titled = AFTER_TITLE.search(text[max(0, start - 8):start]) is not None
            parts = len(full) + sum(is_initial(t[2]) for t in piece)
            if parts >= 2 or titled:
                yield Span("person", start, end, min(7, parts + 3 * titled))

    for t in tokens:
        if run:
            gap = text[run[-1][1]:t[0]]
            comma = gap == ", " and run[-1][2].isupper() and len(run[-1][2]) > 2 and not t[2].isupper() and not ordinary(t[2]) and len(surname(run)) == 1
            # "GRAVFELD, Quaano" is one name; other commas and line ends part names
            if gap != " " and gap != "" and not comma and gap != "\xa0":
                yield from flush()
                run = []
        if not run and is_particle(t[2]) and t[2].islower() and AFTER_TITLE.search(text[max(0, t[0] - 8):t[0]]) is None:
            continue
        run.append(t)
    yield from flush()


def candidates(text: str, known: frozenset[str], openers: frozenset[str] = frozenset()) -> list[Span]:
    out = [Span("email", m.start(), m.end(), int("@" in m.group())) for m in EMAIL.finditer(text)] if any(c in text for c in "@[(") else []
    if any(c.isdigit() for c in text):
        for m in PHONE.finditer(text):
            s = m.group()
            out.append(Span("phone", m.start(), m.end(), 0 if s[0] == "+" else 1 if s[0] == "(" else 2 if s.startswith("00") else 3 if s[0] == "0" else 4))
        for m in ID.finditer(text):
            s = re.sub(r"\d+", "9", re.sub(r"[A-Z]+", "A", m.group()))
            out.append(Span("id_number", m.start(), m.end(), ("9-9-9", "9.9.9-9.9", "9 9 9 9", "A9", "9A", "9-9", "9", "9 9 9").index(s) if s in ("9-9-9", "9.9.9-9.9", "9 9 9 9", "A9", "9A", "9-9", "9", "9 9 9") else 8))
        for form, (pattern, words) in enumerate(zip(STREET_RE, STREET_WORDS)):
            for m in pattern.finditer(text) if any(w in text for w in words) else ():
                start = m.start()
                # a known word before the street's name is no part of it
                while (w := re.match(r"([A-ZÀ-Þ][\w'’-]*) (?=[A-ZÀ-Þ])", text[start:m.end()])) and w[1].lower() in known and w[1] not in ("Flat", "Apt", "Unit", "Suite", "Calle", "Avenida", "Plaza", "Paseo", "Camino", "Am", "An", "Im", "Auf"):
                    start += w.end()
                place = PLACE.match(text, m.end())
                out.append(Span("address", start, place.end() if place else m.end(), form + 10 * bool(place)))
    out.extend(name_spans(text, known, openers))
    return out


def featurise(text: str, span: Span, known: frozenset[str]) -> list[float]:
    before, after = text[max(0, span.start - 60):span.start], text[span.end:span.end + 50]
    left = [w.lower() for w in AROUND.findall(before.rpartition("\n")[2])][-4:]
    right = [w.lower() for w in AROUND.findall(after.partition("\n")[0])][:3]
    body = text[span.start:span.end]
    words = [w for w in re.findall(r"[^\W\d_]+", body)]
    near = {k: max((1.0 - 0.2 * i for i, w in enumerate(reversed(left)) if w in s), default=0.0) for k, s in CUE_SETS.items()}
    follow = {k: max((1.0 - 0.3 * i for i, w in enumerate(right) if w in CUE_SETS[k]), default=0.0) for k in ("act", "firm", "paper")}
    prev_char, next_char = before[-1:], after[:1]
    return [
        float(KINDS.index(span.kind)), float(span.form), float(len(body)), float(sum(c.isdigit() for c in body)), float(len(words)),
        *near.values(), *follow.values(),
        float(sum(w.lower() in known for w in words)), float(sum(w.lower() in CUE_SETS["firm"] for w in words)), float(any(w.isupper() and len(w) > 1 for w in words)), float("," in body), float("-" in body), float(bool(re.search(r"\b[A-Z]\.", body))),
        float(prev_char in ("", "\n")), float(next_char in ("", "\n")), float(next_char in (".", ",", ";", ":", "|")), float(next_char.isdigit() or after[1:2].isdigit()), float(bool(AFTER_TITLE.search(before))),
        float(before.rstrip()[-1:] in (".", ":", "|", "\n", "") or not before.strip()), float(bool(left) and left[-1] not in known), float(bool(right) and after[1:2].isupper() and right[0] not in known), float(bool(re.search(r"[A-Z]-\d+$|[A-Z]{2}-$", before))), float(after[:2] == "\n" or bool(re.match(r"\s*[|(<\[]|\s+(?:at|on)\b", after))),
    ]


# Syllables of invented names, street and firm stems, and sentences of the training documents.
FIRST = ("Ari", "Belo", "Cora", "Dema", "Enzo", "Fila", "Gori", "Hesta", "Iva", "Jolan", "Karo", "Lemi", "Mirel", "Nolv", "Oria", "Petro", "Ralu", "Sela", "Timo", "Ursi")
FIRST_END = ("na", "ric", "beth", "mar", "lin", "dan", "ta", "vin", "rie", "son")
LAST = ("Aldan", "Berg", "Corr", "Dahl", "Ekk", "Fars", "Grell", "Harn", "Ils", "Jorm", "Kell", "Lor", "Mand", "Norr", "Ollen", "Pell", "Rask", "Sund", "Torv", "Ull")
LAST_END = ("berg", "stad", "ley", "mann", "ova", "ez", "wick", "heim", "ier", "sen", "ton", "ard")
TOWNS = ("Altona", "Brinley", "Castrel", "Dornfeld", "Elmsworth", "Port Vale", "Saint-Elm", "Nieder-Holz", "Villa Serena", "Greymouth")
FIRMS = ("{t} Vehicle Laboratory", "{t} Test Centre", "{t} Braking Institute", "{t} Road Safety Board", "{t} Metrology", "{t} Components", "{t} Approval Office", "{t} Systems GmbH")
PLAIN = (
    "The applicant records the result in the test protocol.", "Report no. {rep}", "Test report {rep}", "Calibration certificate {c6} covers the sensor.", "Serial {part}, batch {batch}, passed.", "All runs took place at {t} Hill, gate {n}.", "All runs took place at {t} Valley, gate {n}.", "All runs took place at {t} North, gate {n}.", "The run took place at {t} Loop, gate {n}.", "All runs took place at {t} Circuit, gate {n}.", "Ticket {rep}: sensor fails", "The run at {t} East, gate {n}, was repeated.", "{firm} presented a proposal on the lamp.",
    "Item {n}: {firm} presented a proposal.", "The measuring chain of {firm} was calibrated on {date}.", "Site: {firm}, climate chamber", "Vehicle: {prod} {h}", "Compatible with {prod} {h} from 2016.", "The meeting closed at 14:0{d}.", "See page {n} of the file.", "Best regards", "Dear colleagues,", "Every lamp bears the number {part} and the month of production.",
    "Filed under {rep}.", "We refer to approval {rep} and to the extension filed on {date}.", "Systems of generation K{d}/{n} with the software tag {part} need no new file.", "Der Bericht {rep} nennt die Masse und die Kennung {part}.", "Le rapport {rep} mentionne la charge ainsi que la référence {part}.", "El informe {rep} recoge la masa y la referencia {part}.",
    "The distance is {n}.{d} m in paragraph 3.{d}.", "Present: a delegate of {firm}.", "Certificate {c6} was renewed on {date}.", "Calibration certificate {c6} covers the lamp of {firm}.", "Order {batch} was sent to {firm}.", "Exercise {d}: find out who may record the speed.", "The {prod} {h} was tested on {date}.", "Part {part}, drawing {c6}.", "Batch {batch} passed.", "Invoice {c6} of {date}", "Subject: {prod} {h}, file {rep}",
    "The Type Approval Authority has no objection.", "Technical Service: {firm}", "Action {n}: revise the approval record by {date}.", "{n}.{d}. The manual warning lamp is approved as a separate unit.", "From 2019. {n}.{d}. The lamp is approved.", "Evidence is kept for {n} years from 2020.", "Certificate no. {c6}", "Zertifikat {c6} gilt für den Sensor.", "Le certificat {c6} couvre le capteur.", "El certificado {c6} cubre el sensor.",
)
CARRIERS = (
    "{person} disagreed.", "The file was checked by {person}; nobody objected.", "Questions on this matter go to {person} at {email}.", "Driver of the test vehicle: {person}, licence {id_number}.", "Identity of the witness was checked (national number {id_number}).", "Invoices to {email}, urgent matters to {phone}.", "Copy sent to {email} and {email}.", "Contact: {person} | {email} | {phone}",
    "Please call {person} on {phone} before the next session.", "Write to {email} or phone {phone} if it fails again.", "My passport is {id_number} and my home address is {address}, in case you need it.", "The sample was handed over by {person}, who lives at {address}.", "Return the unit to {address}.", "Der Fahrer {person} wies sich mit Nr. {id_number} aus.", "Rückfragen bitte an {person}, Tel. {phone}.", "Die Unterlagen gehen an {person}, {address}.",
    "Antworten an {email} genügen.", "Le conducteur, {person}, demeurant {address}, a signé le procès-verbal.", "Pièce d'identité n° {id_number} présentée par {person}.", "Pour toute question, écrire à {email} ou appeler le {phone}.", "El conductor {person}, con documento {id_number}, vive en {address}.", "Teléfono de contacto: {phone}.", "Consultas a {person}, correo {email}.", "As {person} pointed out, the lamp was never tested.", "{person} signed the protocol on {date}.",
    "Personal no. {id_number} was entered for {person} in the record.", "Present: {person}, {person} and a delegate of {firm}.", "{person}", "{person} {plain}", "{phone} {plain}", "{id_number} {plain}", "{email} {plain}", "{address} {plain}", "{plain} {person} {plain}", "{plain} {phone}\n{plain}", "{plain} {id_number}\n{plain}", "Best regards\n{person}", "{person}\n{firm}", "A: {person}", "Tel. {phone}", "{id_number} was entered for {person} in the sheet.", "Best regards\n\n{person}\n{phone}",
)


def invented(rng: np.random.Generator) -> dict:
    """Makers of the values that the sentences name."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    dig = lambda n: "".join(str(int(x)) for x in rng.integers(0, 10, n))
    given = lambda: pick(FIRST) + pick(FIRST_END)
    family = lambda: (pick(LAST) + pick(LAST_END)).capitalize()
    town = lambda: pick(TOWNS)
    stem = lambda: pick(LAST).capitalize() + pick(("moor", "gate", "field", "brook", "mere"))

    def person() -> tuple[str, int]:
        f, l = given(), family()
        if rng.random() < 0.12:
            l += "-" + family()
        if rng.random() < 0.1:
            l = "van " + l
        form = int(rng.integers(12))
        if form == 0:
            return f"{f[0]}. {l}", 0
        if form == 1:
            return f"{l.upper()}, {f}", 0
        if form == 2:
            return f"{f.upper()} {l.upper()}", 0
        if form == 3:
            return f"{f} {pick('ABCDEFGHIKLMNOPQRSTUVW')}. {l}", 0
        if form in (4, 5):
            title = pick(("Mr ", "Mrs ", "Ms ", "Dr ", "Dr. ", "Prof. ", "Herr ", "Mme "))
            return title + (l if form == 4 else f"{f} {l}"), len(title)
        return f"{f} {l}", 0

    def email() -> tuple[str, int]:
        user = pick((f"{given()}.{family()}", f"{family()}_{given()}", f"{given()}{dig(2)}", f"{given()[0]}{family()}", f"{given()}+approval", "info.desk", "type-approval.desk")).lower()
        s = f"{user}{pick(('@', '@', '@', '@', '[at]', '(at)'))}{pick(TOWNS).split()[0].lower()}{pick(('', '-lab', '-auth', '.mail', '.office'))}.{pick(('example', 'test', 'invalid', 'org'))}"
        if rng.random() < 0.12:
            s = s.upper().replace("[AT]", "[at]").replace("(AT)", "(at)")
        return ("mailto:" + s, 7) if rng.random() < 0.1 else (s, 0)

    def phone() -> tuple[str, int]:
        a, b = dig(2), dig(4)
        return pick((f"+999 {a} 555 {b}", f"+999 (0){a} 555-{b}", f"(0{a}) 555 {b}", f"0{a}/555{b}-{dig(2)}", f"+999{a}55{dig(6)}", f"00999-{a}-555{b}", f"555-{b}", f"+999.{a}.555.{b}", f"+49 {dig(3)} {dig(6)}")), 0

    def id_number() -> tuple[str, int]:
        return pick((f"000-{dig(2)}-{dig(4)}", f"{dig(2)}.{dig(2)}.{dig(2)}-{dig(3)}.{dig(2)}", f"{dig(2)} {dig(3)} {dig(3)} {dig(3)}", f"{pick('XZKAT')}{pick('WVQRS')}{dig(7)}", f"{dig(8)}{pick('ABCKLMZ')}", f"{dig(6)}-{dig(4)}", f"{dig(6)}-{dig(4)}")), 0

    def address() -> tuple[str, int]:
        n, z = int(rng.integers(1, 240)), dig(5)
        kind = pick(("Road", "Lane", "Avenue", "Close", "Street", "Drive", "Square"))
        return pick((f"{n} {stem()} {kind}, {town()} {z}", f"{stem()} {kind} {n}\n{town()} {z}", f"{stem()} {kind} {n}, {town()} {z}", f"Flat {n % 40}, {n} {stem()} Court, {town()}", f"{stem()}{pick(('straße', 'str.', 'gasse', 'weg', 'allee'))} {n}{pick(('', 'a', ' b'))}, {z} {town()}", f"{n}, {pick(('rue', 'chemin'))} de {stem()}, {z} {town()}", f"Calle {stem()} {n}, {z} {town()}")), 0

    def plain() -> str:
        return pick(PLAIN).format(
            rep=f"{pick('ABKTZ')}{pick('CDFR')}-20{dig(2)}-{dig(4)}-{dig(2)}", c6=f"{dig(6)}-{dig(4)}", part=f"{pick('KXP')}{dig(4)}-{dig(3)}", batch=f"{int(rng.integers(1, 40))}00 {dig(4)} {dig(3)}", t=pick((stem(), pick(TOWNS).split()[0])), n=int(rng.integers(2, 40)), d=int(rng.integers(1, 9)),
            h=100 * int(rng.integers(1, 9)), firm=pick(FIRMS).format(t=stem()), prod=pick(("Velara", "Quanta", "Mistero", "Corvex")), date=f"{int(rng.integers(1, 28))} {pick(('May', 'June', 'March'))} 20{dig(2)}")

    return {"person": person, "email": email, "phone": phone, "id_number": id_number, "address": address, "plain": plain, "firm": lambda: pick(FIRMS).format(t=stem()), "date": lambda: f"{int(rng.integers(1, 28))} June 20{dig(2)}"}


def training_documents(n: int, seed: int) -> list[tuple[str, set[tuple[str, int]]]]:
    """(text, {(kind, start)}) of invented documents."""
    rng = np.random.default_rng(seed)
    make = invented(rng)
    out = []
    for _ in range(n):
        text, truth = "", set()
        for _ in range(int(rng.integers(2, 8))):
            template = CARRIERS[int(rng.integers(len(CARRIERS)))] if rng.random() < 0.5 else "{plain}"
            for part in re.split(r"(\{\w+\})", template):
                if re.fullmatch(r"\{\w+\}", part):
                    value = make[part[1:-1]]()
                    if isinstance(value, tuple):
                        truth.add((part[1:-1], len(text) + value[1]))
                        value = value[0]
                    text += value
                else:
                    text += part
            text += (" ", " ", "\n", "\n\n")[int(rng.integers(4))]
        out.append((text, truth))
    return out


# Function words of the four languages, which start sentences with a capital.
FUNCTION_WORDS = (
    "a an the this that these those it its he she they we you his her their our your my and or but if when where while as at by for from in into of off on onto out over per than then to under until up upon with within without no not nor so such both each either neither every all any some once only after before during since unless whether nothing there here what which who whose how why "
    "der die das den dem des ein eine einen einem einer eines kein keine und oder aber wenn wo als bei bis durch für gegen im in ins mit nach ohne seit über um unter vom von vor während wegen zu zum zur es er sie wir ihr ihre sein seine dieser diese dieses jeder jede jedes alle nicht nur auch sowie nachdem "
    "le la les un une des du de et ou mais si quand où comme à au aux avec chez dans dès en entre jusque lors par pendant pour sans selon sous sur vers il elle ils elles nous vous ce cet cette ces son sa ses leur leurs tout toute tous toutes aucun aucune après avant au-delà chaque "
    "el los las unos unas y o pero si cuando donde como al con contra desde durante en entre hasta hacia para por según sin sobre tras él ella ellos ellas nosotros este esta estos estas ese esa su sus todo toda todos todas ningún ninguna cada después antes"
)
#: words that training documents use in lower case, whatever the corpus
BASE_WORDS = frozenset(FUNCTION_WORDS.split()) | frozenset(w.lower() for t in (*PLAIN, *CARRIERS) for w in re.findall(r"[^\W\d_]{2,}", re.sub(r"\{\w+\}", "", t))) | frozenset(w for s in CUE_SETS.values() for w in s)


class Detector:
    def __init__(self, trees: BoostedTrees, thresholds: dict[str, float], known: frozenset[str], openers: frozenset[str] = frozenset()):
        self.trees, self.thresholds, self.known, self.openers = trees, thresholds, known, openers

    def scored(self, texts: list[str | None]) -> list[list[tuple[float, Span]]]:
        spans, rows, owner = [], [], []
        for i, t in enumerate(texts):
            for s in candidates(t, self.known, self.openers) if t else ():
                spans.append(s)
                rows.append(featurise(t, s, self.known))
                owner.append(i)
        p = self.trees.probabilities(np.array(rows)) if rows else np.zeros(0)
        out: list[list[tuple[float, Span]]] = [[] for _ in texts]
        for i, s, q in zip(owner, spans, p):
            out[i].append((float(q), s))
        return out

    def detect(self, texts: list[str | None]) -> list[list[Span]]:
        """Kept spans of each text in order: above their kind's threshold, best first where they overlap."""
        result = []
        for rows in self.scored(texts):
            kept: list[Span] = []  # by start
            for q, s in sorted((r for r in rows if r[0] >= self.thresholds[r[1].kind]), key=lambda r: (-RANK[r[1].kind], -round(r[0], 2), r[1].start - r[1].end, r[1].start)):
                i = bisect_left(kept, s.start, key=lambda k: k.start)
                if (i == len(kept) or s.end <= kept[i].start) and (i == 0 or s.start >= kept[i - 1].end):
                    kept.insert(i, s)
            result.append(kept)
        return result


#: which kind wins where two accepted spans overlap
RANK = {"email": 4, "address": 3, "phone": 1, "id_number": 1, "person": 0}


@lru_cache(maxsize=4)
def trained(documents: int = 2500, seed: int = 7) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees fitted on invented documents; per kind the threshold with the best F1 on held-out ones."""

    def rows(docs: list) -> tuple[np.ndarray, np.ndarray, list[str]]:
        x, y, kinds = [], [], []
        for text, truth in docs:
            for s in candidates(text, BASE_WORDS):
                x.append(featurise(text, s, BASE_WORDS))
                y.append((s.kind, s.start) in truth)
                kinds.append(s.kind)
        return np.array(x), np.array(y), kinds

    x, y, _ = rows(training_documents(documents, seed))
    trees = BoostedTrees().fit(x, y)
    x, y, kinds = rows(training_documents(documents // 3, seed + 1))
    p = trees.probabilities(x)
    thresholds = {}
    for k in KINDS:
        own = np.array([q == k for q in kinds])
        best = (-1.0, 0.0, 0.5)
        for t in np.linspace(0.1, 0.9, 33):
            hit = (p[own] >= t) & y[own]
            f1 = 2 * hit.sum() / max(1, (p[own] >= t).sum() + y[own].sum())
            best = max(best, (round(float(f1), 3), -abs(t - 0.5), float(t)))  # the middle one of equal ones
        thresholds[k] = best[-1]
    return trees, thresholds


LOWER_WORD = re.compile(r"[a-zß-öø-ÿ](?<![^\W_].)[a-zß-öø-ÿ]+(?![^\W_])")
#: a capitalised word that opens a sentence (of a text with a line end put before it) and is followed by a small one, no particle of a name; not after initials and titles
OPENING_WORD = re.compile(r"[.!?\n](?:(?<=\n)|(?<![A-Z].)(?<!Dr.)(?<!Mr.)(?<!Ms.)(?<!Mrs.)(?<!Prof.)(?<!Eng.)\s)[^\S\n]*([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)(?=\s+(?!(?:van|von|de[rn]?|del|da|di|zu|ter)\s)[a-zß-öø-ÿ])")


def _lower_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n, lower): in how many texts a word is written in lower case or opens a sentence, and the first alone; "" counts the texts."""
    counts: Counter[str] = Counter()
    lower: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        cols = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([lower[w] for w in counts], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["word", "n", "lower"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts[""] += 1
            if text:
                bare = EMAIL.sub(" ", text) if any(c in text for c in "@[(") else text
                small = set(LOWER_WORD.findall(bare))
                lower.update(small)
                counts.update(small.union(map(str.lower, OPENING_WORD.findall("\n" + bare))))
        if len(counts) > 500_000:
            yield rows()
            counts.clear(), lower.clear()
    yield rows()


def ordinary_words(texts: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Words that the corpus writes in lower case, or opens sentences with, in more than a share of its
    distinct texts; and those of them that reach the share by opening sentences only."""
    counts = texts.distinct().mapInArrow(_lower_words, "word string, n long, lower long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("lower").alias("lower")).persist()
    try:
        total = counts.filter("word = ''").first()
        least = max(3, int(DOCUMENT_SHARE * (total["n"] if total else 0)))
        rows = counts.filter((F.col("n") >= least) & (F.col("word") != "")).collect()
    finally:
        counts.unpersist()
    return frozenset(r["word"] for r in rows), frozenset(r["word"] for r in rows if r["lower"] < least)


def corpus_detector(documents: DataFrame) -> Detector:
    known, openers = ordinary_words(documents.select("text"))
    return Detector(*trained(), known | BASE_WORDS, openers - BASE_WORDS)


def found_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos) of every span."""
    detector = corpus_detector(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, s.kind, s.start, s.end) for d, spans in zip(batch.column(0).to_pylist(), detector.detect(batch.column(1).to_pylist())) for s in spans]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["doc_id", "kind", "start_pos", "end_pos"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, kind string, start_pos long, end_pos long")


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[PERSON]`` in place of the spans."""
    detector = corpus_detector(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = []
            for text, spans in zip(texts, detector.detect(texts)):
                for s in reversed(spans):
                    text = f"{text[:s.start]}[{s.kind.upper()}]{text[s.end:]}"
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string")
