"""Markup residue to clean text with a tree-structured graphical model.

A text is parsed into one tree for all dialects (HTML, Markdown, wiki, LaTeX): the root is the
text, inner nodes are elements, environments, lists and tables, leaves are inline signs. The parser
is generous: everything that could be markup becomes a node. Each node has a hidden state, markup or
plain sign. Node potentials are a logistic model of its spelling and surroundings, edge potentials
couple parent and child by their kinds; one upward and one downward sum-product pass gives the exact
marginals. All parameters are trained here, from labelled pages that ``labelled_pages`` writes in the
four dialects, with plain uses of the same signs and unfilled placeholders as counter-examples.

Nodes whose marginal passes ``LEAST`` are converted: headings, list items, table cells, code and
formulas stay, tags and signs go, entities are decoded; other signs stay as they are.

Defined results: null gives null and holds no markup; empty and blank texts stay; whole texts are
parsed; repeated rows are converted alike; empty tables give empty results; extra columns are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 0.5
PAGES = 1500
VOID = frozenset("br hr img col meta link input area base wbr".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
CELLS = frozenset(("td", "th"))
BLOCKS = frozenset("p div ul ol li table tr td th thead tbody tfoot caption h1 h2 h3 h4 h5 h6 pre blockquote section article html head body title".split())
#: a new element of these closes an open one of the same family
IMPLIED = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "p": {"p"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "thead": {"td", "th", "tr"}, "item": {"item"}}

COMMENT = r"(?P<comment><!--(?:[^-]|-(?!->))*-->)|"
OTHERS = (
    r"(?P<tag></?[A-Za-z][A-Za-z0-9]*(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))?)*\s*/?>)|(?P<angle><[^<>\n]{1,60}>)|(?P<entity>&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});)"
    r"|(?P<env>\\(?:begin|end)\{[A-Za-z*]+\}(?:\{[lcr|p ]+\})?)|(?P<display>\\\[[^\[\]]+?\\\]|\$\$[^$]+\$\$)|(?P<math>\$(?!\{[\w .]+\}(?![ \t]*[_^]))[^$\n]+\$(?!\{[\w .]+\})|\\\([^\n]+?\\\))|(?P<rowend>\\\\(?=\s))|(?P<command>\\[A-Za-z]+\*?(?:\{[^{}\n]*\})?)"
    r"|(?P<fence>^[ \t]*(?:```|~~~)[^\n`]*$)|(?P<code>`[^`\n]+`)|(?P<wikitable>^[ \t]*\{\|[^\n]*$|^[ \t]*\|\}[ \t]*$)|(?P<wikirow>^[ \t]*\|-[^\n|]*$|^[ \t]*[!|][ \t][^\n|]*(?:(?:!!|\|\|)[^\n]*)?$)"
    r"|(?P<rule>^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$)|(?P<row>^[ \t]*\|[^\n]*\|[ \t]*$)|(?P<wikihead>^[ \t]*(?P<eq>={1,6})[ \t]*[^=\n]+?[ \t]*(?P=eq)[ \t]*$)"
    r"|(?P<head>^[ \t]{0,3}#{1,6}[ \t]+[^\n]+$)|(?P<bullet>^[ \t]*[*+\-•][ \t]+(?=\S))|(?P<quote>^[ \t]{0,3}>[ \t]+)|(?P<wikilink>\[\[[^\[\]\n]+\]\])|(?P<link>!?\[[^\[\]\n]+\]\([^()\s\n]+\))"
    r"|(?P<quotes>'{2,5}(?=\S)[^'\n]+'{2,5})|(?P<strong>\*\*(?=\S)[^*\n]+\*\*|__(?=\S)[^_\n]+__)|(?P<emph>(?<![\w*])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_]))|(?P<strike>~~[^~\n]+~~)"
    r"|(?P<hash>#\d+)|(?P<bar>\|[^|\n]{1,20}\|)|(?P<star>\*)|(?P<template>\{\{[^{}\n]{1,80}\}\})"
)
TOKEN, AFTER_COMMENTS = re.compile(COMMENT + OTHERS, re.M | re.S), re.compile(OTHERS, re.M | re.S)
#: where a token can start: a sign, or a line whose first character is one
STARTS = re.compile(r"^[ \t]*(?=[-+*•#>=|{!`~:])|[<&\\$`#*_=|{\['~!]", re.M)
#: what no text with markup can do without
MAY_HOLD = r"[<&\\$`#*_=|{\['~•]|(?m)^[ \t]*[+\-][ \t]"
PLACEHOLDER_LIKE = re.compile(r"(?i)^\W*(?:(?:to be|insert|enter|your|add|type|date to|tbd|tbc|todo|placeholder)\b.*|[A-Z]+(?:_[A-Z]+)+|[a-z]+_[a-z_]+|[a-z]+\.[a-z.]+)\W*$")


#: what follows the sign of a page number's line, and words that formulas hardly hold
PAGE_MARK = re.compile(r"[\d\s.,/]*[-–—]?\s*")
PLAIN_WORD = re.compile(r"(?<![\\{A-Za-z])[A-Za-z]{3,}(?![}A-Za-z])")


class Node:
    __slots__ = ("kind", "name", "start", "end", "parent", "closed", "features", "until")

    def __init__(self, kind: str, name: str, start: int, end: int, parent: int):
        self.kind, self.name, self.start, self.end, self.parent = kind, name, start, end, parent
        self.closed, self.features, self.until = False, (), -1


#: inline spans of any length, whose inside is parsed as well, and what may stand in them
INLINE = frozenset(("math", "strong", "emph", "quotes", "strike", "link", "wikilink"))
INNER = frozenset(("tag", "comment", "entity", "command", "code"))


def tokens(text: str) -> Iterator[tuple[re.Match, bool]]:
    """TOKEN's matches, tried only where one can start, and whether each stands inside the last inline span."""
    done = inner = end = 0  # the last inline span's closing sign is at inner to end
    last_comment = text.rfind("-->")
    for s in STARTS.finditer(text):
        at = s.start()
        if at < done or inner <= at < end or (m := (TOKEN if at < last_comment else AFTER_COMMENTS).match(text, at)) is None:
            continue
        if at < inner:
            if m.lastgroup in INNER and m.end() <= inner:
                done = m.end()
                yield m, True
            continue
        done = m.end()
        if m.lastgroup in INLINE:
            token = m.group()
            end, inner, done = done, at + len(token.rstrip("*_~'$])\\")), at + len(token) - len(token.lstrip("*_~'$[!(\\"))
        yield m, False


def parse(text: str) -> list[Node]:
    """The nodes in document order; node 0 is the root."""
    nodes = [Node("root", "", 0, len(text), -1)]
    stack = [0]
    group, group_end = -1, -1  # open list or table of consecutive lines
    fence = -1
    span = -1
    for m, within in tokens(text):
        kind, start, end = m.lastgroup if m.lastgroup != "eq" else "wikihead", m.start(), m.end()
        token = m.group()
        if fence >= 0 and kind != "fence":
            continue
        if kind == "tag":
            name = re.match(r"</?(\w+)", token)[1].lower()
            if token[1] == "/":
                depth = next((d for d in range(len(stack) - 1, 0, -1) if nodes[stack[d]].kind == "tag" and nodes[stack[d]].name == name), 0)
                node = Node("close", name, start, end, stack[depth] if depth else stack[-1])
                nodes.append(node)
                if depth:
                    nodes[stack[depth]].closed = node.closed = True
                    nodes[stack[depth]].until = end
                    del stack[depth:]
                continue
            while len(stack) > 1 and nodes[stack[-1]].name in IMPLIED.get(name, ()):
                nodes[stack[-1]].until = start
                stack.pop()
            nodes.append(Node("tag", name, start, end, stack[-1]))
            if name not in VOID and not token.endswith("/>"):
                stack.append(len(nodes) - 1)
        elif kind == "env":
            name = re.search(r"\{([^{}]+)\}", token)[1]
            if token.startswith("\\begin"):
                nodes.append(Node("env", name, start, end, stack[-1]))
                stack.append(len(nodes) - 1)
            else:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if nodes[stack[d]].kind == "env" and nodes[stack[d]].name == name), 0)
                node = Node("envend", name, start, end, stack[depth] if depth else stack[-1])
                nodes.append(node)
                if depth:
                    nodes[stack[depth]].closed = node.closed = True
                    nodes[stack[depth]].until = end
                    del stack[depth:]
        elif kind == "wikitable":
            if token.strip().startswith("{|"):
                nodes.append(Node("wikitable", "{|", start, end, stack[-1]))
                stack.append(len(nodes) - 1)
            else:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if nodes[stack[d]].kind == "wikitable"), 0)
                node = Node("wikiend", "|}", start, end, stack[depth] if depth else stack[-1])
                nodes.append(node)
                if depth:
                    nodes[stack[depth]].closed = node.closed = True
                    del stack[depth:]
        elif kind == "fence":
            if fence >= 0:
                nodes[fence].closed, nodes[fence].until = True, end
                nodes.append(Node("fenceend", "", start, end, fence))
                nodes[-1].closed = True
                fence = -1
            else:
                nodes.append(Node("fence", "", start, end, stack[-1]))
                fence = len(nodes) - 1
        elif kind in ("bullet", "row", "rule", "quote"):
            family = "list" if kind == "bullet" else "quotes" if kind == "quote" else "table"
            line_end = text.find("\n", end)
            line_end = len(text) if line_end < 0 else line_end
            if group < 0 or nodes[group].name != family or nodes[group].parent != stack[-1] or text[group_end:start].strip(" \t") != "\n":
                nodes.append(Node("group", family, start, end, stack[-1]))
                group = len(nodes) - 1
            else:
                nodes[group].closed = True  # more than one line
            nodes.append(Node(kind, token.strip()[:1], start, end, group))
            group_end = line_end
        else:
            name = re.match(r"\\?[A-Za-z]+", token)[0] if kind == "command" else token.strip("&;") if kind == "entity" else token[:2]
            nodes.append(Node(kind, name, start, end, span if within else stack[-1]))
            if kind in INLINE:
                span = len(nodes) - 1
    return nodes


def _class(c: str) -> str:
    return "none" if not c else "line" if c == "\n" else "blank" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else c


def featurise(text: str, nodes: list[Node]) -> None:
    counts = Counter(n.kind for n in nodes)
    for n in nodes[1:]:
        token = text[n.start:n.end]
        rest = "-"
        if n.kind in ("bullet", "quote"):
            line = text[n.end:].partition("\n")[0]
            rest = "cells" if "\t" in token.strip(" ") or "\t" in line else "number" if PAGE_MARK.fullmatch(line) else "digit" if line[:1].isdigit() else "words"
        inner = token.strip("<>/&;\\{}[]*_`'|=#$~!() ")
        shape = "placeholder" if PLACEHOLDER_LIKE.match(token) else "number" if inner.replace(".", "").isdigit() else "words" if " " in inner else "word" if inner.isalpha() else "none" if not inner else "mixed"
        k = n.kind
        n.features = (
            f"kind {k}", f"name {k} {n.name}", f"closed {k} {n.closed}", f"shape {k} {shape}", f"left {k} {_class(text[n.start - 1:n.start])}", f"right {k} {_class(text[n.end:n.end + 1])}",
            f"attr {k} {'=' in token}", f"size {k} {min(6, len(token) // 8)}", f"many {k} {min(3, counts[k])}",
            f"math {k} {any(c in token for c in chr(92) + '^_{}=') if k in ('math', 'display') else '-'}",
            f"known {k} {(n.name in BLOCKS or n.name in VOID or n.name in ('b', 'i', 'em', 'strong', 'a', 'sup', 'sub', 'span', 'ref', 'u', 'code', 'small', 'font', 'center', 'tt', 'nowiki', 's')) if k in ('tag', 'close') else '-'}",
            f"rest {k} {rest}", f"said {k} {min(5, len(PLAIN_WORD.findall(token))) if k in ('math', 'code', 'display') else '-'}",
            f"decodes {k} {html.unescape(token) != token if k == 'entity' else '-'}",
        )


class TreeModel:
    """Logistic node potentials and parent-child potentials."""

    def __init__(self, weights: dict[str, float], bias: float, edges: dict[tuple[str, str], np.ndarray]):
        self.weights, self.bias, self.edges = weights, bias, edges

    def unary(self, node: Node) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in node.features)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(markup) of each node by one upward and one downward sum-product pass. Parents come before children."""
        flat = np.zeros((2, 2))
        log = [np.array([0.0, 0.0])] + [np.array([0.0, self.unary(n)]) for n in nodes[1:]]
        edge = [flat] + [self.edges.get((nodes[n.parent].kind, n.kind), flat) for n in nodes[1:]]
        up = [x.copy() for x in log]
        message: list[np.ndarray] = [flat[0]] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            message[i] = np.logaddexp(edge[i][:, 0] + up[i][0], edge[i][:, 1] + up[i][1])
            up[nodes[i].parent] += message[i]
        belief = list(up)
        for i in range(1, len(nodes)):
            rest = belief[nodes[i].parent] - message[i]
            belief[i] = up[i] + np.logaddexp(edge[i][0] + rest[0], edge[i][1] + rest[1])
        return [float(1 / (1 + np.exp(np.clip(b[0] - b[1], -60, 60)))) for b in belief]


# Wording of the labelled pages.
SUBJECTS = ("the control unit", "the braking system", "the test vehicle", "the applicant", "the warning signal", "the lamp", "the approval authority", "the sensor")
ACTIONS = ("shall report the speed", "may record the result", "is tested on a dry road", "must stay within the limit", "keeps the file", "refers to paragraph 4.2", "is replaced after each run", "has to be fitted")
SIGNS = (
    "the offset |d| is at most 3.4 m", "each run costs 7 $ and 9 $ per day", "if v_rel < 30 and the gap > 2.5, the test ends", "mark #15 is placed next to the lamp*, at 3 m", "values & units are kept", "see note [13] below the table", "x = a / b holds for all of them", "R&D of the maker",
    "the range is 3 < x < 9 and y > 2", "class A* and class B* are alike", "use C# or F# names", "5 * 3 * 2 = 30", "the fields a_b and c_d are set", "a deviation of +/- 5 % is tolerated", "Smith & Sons; AT&T; others", "price: 5$ to 6$ each", "|x| + |y| <= 2", "(a) first; (b) second", "the sign * marks a change", "the column speed [$k m / h$] holds 50 $k m / h$ or 60 $m / s$", "each run costs 7 $ if x = a / b holds for it, and 9 $ per day after that", "the track charges 22 $ per run while the observation unit of the trailer stays coupled for as long as the ignition is switched on, and 39 $ per day", "the key <Enter> is pressed", "page 3 -- see below",
)
HOLES = ("{{title}}", "${section.title}", "<TO BE COMPLETED>", "<insert vehicle type>", "<your text here>", "<<title>>", "[TO BE COMPLETED]", "[[INSERT title HERE]]", "<approval_no>", "<applicant.name>", "<%= limit_value %>", "__TO BE COMPLETED__", "__limit_value__", "@@name@@", "%%CLAUSE_TITLE%%", "{% title %}", "<INSERT VALUE>", "<REG_TITLE>", "__your text here__", "<enter_date>")


def labelled_pages(pages: int = PAGES, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """(text, spans of true markup) pages in the four dialects, mixed with plain signs and placeholders."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    say = lambda: f"{pick(SUBJECTS)} {pick(ACTIONS)}"
    short = lambda: pick(SUBJECTS)[4:]
    cap = lambda s: s[0].upper() + s[1:]

    def piece() -> tuple[str, bool]:
        k = int(rng.integers(48))
        s, t = cap(say()), short()
        items = [cap(say()) for _ in range(int(rng.integers(2, 5)))]
        cells = [[short() for _ in range(2)] for _ in range(int(rng.integers(1, 4)))]
        made = {
            0: f"<p>{s}.</p>", 1: f"{s} <b>{t}</b>.", 2: "<ul>" + "".join(f"<li>{i}" + pick(["</li>", ""]) for i in items) + "</ul>", 3: f"<h{rng.integers(1, 5)}>{cap(t)}</h2>".replace("</h2>", "</h3>"),
            4: "<table>" + "".join("<tr>" + "".join(pick([f"<td>{c}</td>", f"<td rowspan=1 colspan=2>{c}</td>", f"<TD>{c}"]) for c in r) + "</tr>" for r in cells) + "</table>", 5: f'<div class="x" id="c{rng.integers(99)}">{s}.<br/>{cap(say())}.</div>', 6: f'See <a href="annex{rng.integers(9)}.html#p3">the {t}</a>.', 7: f"{s}.<sup>{rng.integers(9)}</sup>", 8: f'{s}.<ref name="n{rng.integers(9)}">{t}</ref>', 9: f"{s}<br>{cap(say())}",
            10: f"{s} {pick(['&nbsp;', '&amp;', '&lt;', '&gt;', '&deg;', '&le;', '&#8805;', '&eacute;', '&quot;', '&#x2264;'])} {rng.integers(99)}", 11: f"&lt;b&gt;{s}.&lt;/b&gt;", 12: s.replace(" ", "&nbsp;"), 13: f"\n{'#' * int(rng.integers(1, 6))} {cap(t)}\n", 14: f"{s} **{t}**.", 15: f"{s} *{t}* and _{short()}_.", 16: f"**Note:** `{t.replace(' ', '_')}` is set.", 17: "\n" + "\n".join(f"{pick(['- ', '* ', '+ '])}{i}." for i in items) + "\n",
            18: "\n" + "\n".join(["| item | limit |", "|---|---:|", *[f"| {a} | {rng.integers(99)} |" for a, _ in cells]]) + "\n", 19: f"\n```{pick(['', 'python'])}\nif gap < {rng.integers(99)}:\n    warn('{t}')\n```\n", 20: f"[{t}](annex-{rng.integers(9)}.md) applies.", 21: f"\n> {s}.\n", 22: f"\n== {cap(t)} ==\n", 23: f"'''{cap(t)}''' and ''its'' part.", 24: f"[[Annex {rng.integers(9)}|{t}]] refers.", 25: "\n{| class=\"grid\"\n! " + t + "\n|-\n| " + str(rng.integers(99)) + "\n|}\n",
            26: "\\begin{itemize}\n" + "\n".join(f"\\item {i}." for i in items) + "\n\\end{itemize}", 27: f"\\section*{{{cap(t)}}}\n{s}.", 28: f"\\textbf{{{t}}}: {s}.", 29: f"{s}.\\footnote{{See the {t}.}}", 30: f"$v_{{rel}} \\leq {rng.integers(99)}~\\mathrm{{km/h}}$", 31: "\\[ d = \\frac{v^2}{2a} \\]", 32: f"$ {{ \\bf Q _ {{ {rng.integers(9)} }} }} $", 33: "\\begin{tabular}{ll}\n" + "\n".join(f"{a} & {b} \\\\" for a, b in cells) + " \\hline\n\\end{tabular}",
            34: f"<!-- page break -->{s}.", 35: f"<pre>if v &lt; {rng.integers(99)}: stop</pre>", 36: f"<html><head><title>{cap(t)}</title></head><body>{s}</body></html>", 37: "<UL><LI>" + "<LI>".join(items) + "</UL>", 38: f"$d^2 + {t[:1]}_1 = 4$", 39: f"\n=== {cap(t)} ===\n", 40: f"[[{cap(t)}]]", 41: f"<span style='x'>{s}</span>", 42: f"the value {rng.integers(9)}&times;{rng.integers(9)}", 43: f"<i>{t}</i> {s}",
            44: "$" + " + ".join(f"a_{{{i}}} x^{{{i}}}" for i in range(int(rng.integers(8, 30)))) + " \\leq v$", 45: f"**{', '.join(items)} and {s}.**", 46: f"_{', '.join(items)}_", 47: f"[{', '.join(items)}](https://example.org/{'/'.join(short().replace(' ', '-') for _ in range(12))})",
        }
        return made[k], True

    def other() -> str:
        """Plain lines that begin like lists or quotations: page marks, comparisons, cells of tabbed tables."""
        n, m = (int(x) for x in rng.integers(1, 300, 2))
        return pick([
            f"{cap(say())} \n- {n} -\n and {say()}.", f"{cap(say())} \n- {n}\n and {say()}.", f"if v_rel < {n} and the gap \n > {m}.5, the test ends.", f"if the gap is\n> {m} m, {say()}.",
            f"{short()}\t{short()}\n-\t{n}\n{m}\t{n}.{m}\n", f"{short()}\t{short()} [m]\n{n}\t{m}\n> {n}\t{m}\n-\t{m} *\n", f"- {n} -\n",
        ])

    out = []
    for _ in range(pages):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 7))):
            roll = rng.random()
            if roll < 0.22:
                body, is_markup = piece()
            elif roll < 0.32:
                body, is_markup = f"{cap(say())} {pick(HOLES)} {say()}." if rng.random() < 0.6 else pick(HOLES), False
            elif roll < 0.62:
                body, is_markup = cap(pick(SIGNS)) + ".", False
            elif roll < 0.72:
                body, is_markup = other(), False
            else:
                body, is_markup = cap(say()) + ".", False
            if is_markup:
                spans.append((len(text), len(text) + len(body)))
            text += body + pick([" ", " ", "\n"])
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained_model() -> TreeModel:
    """Node weights by logistic regression, edge potentials by smoothed pointwise mutual information."""
    rows: list[tuple[tuple[str, ...], int]] = []
    joint: dict[tuple[str, str], np.ndarray] = defaultdict(lambda: np.full((2, 2), 2.0))
    for text, spans in labelled_pages():
        nodes = parse(text)
        featurise(text, nodes)
        state = [int(bool(spans))] + [int(any(a <= n.start < b for a, b in spans)) for n in nodes[1:]]
        for n, y in zip(nodes[1:], state[1:]):
            rows.append((n.features, y))
            if n.parent:
                joint[nodes[n.parent].kind, n.kind][state[n.parent], y] += 1
    names = {f: i for i, f in enumerate(sorted({f for fs, _ in rows for f in fs}))}
    at = np.array([[names[f] for f in fs] for fs, _ in rows])
    y = np.array([r[1] for r in rows], dtype=float)
    w, bias, g2 = np.zeros(len(names)), 0.0, np.full(len(names), 1e-6)
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(w[at].sum(axis=1) + bias, -30, 30)))
        g = np.bincount(at.ravel(), weights=np.repeat(y - p, at.shape[1]), minlength=len(names)) - 0.3 * w
        g2 += g**2
        w += 0.2 * g / np.sqrt(g2)
        bias += 0.5 * float((y - p).mean())
    edges = {}
    for key, n in joint.items():
        p = n / n.sum()
        edges[key] = 0.5 * np.log(p / (p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)))
    return TreeModel({f: float(w[i]) for f, i in names.items()}, bias, edges)


def markup_nodes(text: str | None, model: TreeModel) -> tuple[list[Node], list[float]]:
    """Nodes and marginals; empty if nothing could be markup."""
    if not text:
        return [], []
    nodes = parse(text)
    if len(nodes) == 1:
        return nodes, [0.0]
    featurise(text, nodes)
    return nodes, model.marginals(nodes)


# LaTeX symbols kept as characters.
SYMBOLS = {"leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "times": "×", "cdot": "·", "pm": "±", "deg": "°", "circ": "°", "neq": "≠", "approx": "≈", "mu": "µ", "alpha": "α", "beta": "β", "Delta": "Δ", "infty": "∞", "sqrt": "√"}


def plain_formula(s: str) -> str:
    s = s.replace("$", " ").replace("\\[", " ").replace("\\]", " ").replace("\\(", " ").replace("\\)", " ")
    s = re.sub(r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"(\1)/(\2)", s)
    s = re.sub(r"\\(?:mathrm|mathbf|text|bf|rm|it)\b", "", s)
    s = re.sub(r"\\([A-Za-z]+)", lambda m: SYMBOLS.get(m[1], m[1]), s).replace("~", " ").replace("\\", "")
    s = re.sub(r"\s*([_^])\s*\{\s*([^{}]*?)\s*\}", r"\1\2", s)
    return re.sub(r"\s+", " ", s.replace("{", "").replace("}", "")).strip()


#: noncharacters that stand for a cell's border, and for blanks and line ends of code, until the text is tidied
CELL, BLANK, LINE = "\ufdd2", "\ufdd0", "\ufdd1"
CODE_MARKS = str.maketrans({" ": BLANK, "\t": BLANK * 4, "\n": LINE})
MARKED = str.maketrans({CELL: "\t", BLANK: " ", LINE: "\n"})


def clean_text(text: str | None, model: TreeModel) -> tuple[str | None, int]:
    """The text without its markup, and how many nodes were markup.

    Table rows become lines with a tab between cells (empty cells too), code keeps its lines and indents.
    """
    nodes, p = markup_nodes(text, model)
    hit = [i for i in range(1, len(nodes)) if p[i] >= LEAST and nodes[i].kind != "group"]
    if not hit:
        return text, 0
    out, last = [], 0
    tables = cells = code = tabular = 0
    in_row = False

    def plain(s: str) -> str:
        """A stretch between two nodes."""
        if code:
            return s.translate(CODE_MARKS)
        if tabular:
            return re.sub(r"[ \t]*(?<!\\)&[ \t]*", CELL, s)
        if in_row:
            return re.sub(r"\s+", " ", s)
        return " " if tables and s.isspace() else s

    for i in hit:
        n = nodes[i]
        if n.start < last:
            continue
        out.append(plain(text[last:n.start]))
        token = text[n.start:n.end]
        last = n.end
        k, name = n.kind, n.name
        if k in ("tag", "close"):
            opens = k == "tag"
            if name == "table":
                tables, in_row = max(0, tables + (1 if opens else -1)), False
                out.append("\n")
            elif name == "tr":
                in_row, cells = opens, 0
                out.append("\n" if opens else "")
            elif name in CELLS:
                if opens:
                    out.append(CELL if cells else "")
                    in_row, cells = True, cells + 1
            elif name in ("thead", "tbody", "tfoot"):
                in_row = False
            elif name == "pre":
                code = int(opens and n.closed)
                out.append("\n")
            elif in_row and (name in BLOCKS or name in ("br", "hr")):
                out.append(" ")  # a cell stays on its row's line
            elif name == "li":
                out.append("\n- " if opens else "")
            elif name in BLOCKS or name in ("br", "hr"):
                out.append("\n")
        elif k == "env" and name.rstrip("*") in ("tabular", "array", "tabularx", "longtable"):
            tabular = int(n.closed)
        elif k == "envend" and name.rstrip("*") in ("tabular", "array", "tabularx", "longtable"):
            tabular = 0
        elif k == "fence":
            code = int(n.closed)
            last += text[last:last + 1] == "\n"
        elif k == "fenceend":
            code = 0
        elif k == "entity":
            out.append(html.unescape(token))
        elif k in ("math", "display"):
            out.append(plain_formula(token))
        elif k == "command":
            inner = re.search(r"\{([^{}]*)\}", token)
            if name == "\\item":
                out.append("-" if text[last:last + 1] == " " else "- ")
            elif name in ("\\section", "\\subsection", "\\chapter", "\\paragraph", "\\caption"):
                out.append(f"\n{inner[1] if inner else ''}\n")
            elif name == "\\footnote":
                out.append(f" ({inner[1]})" if inner else "")
            elif name != "\\hline":
                out.append(inner[1] if inner else SYMBOLS.get(name[1:], ""))
        elif k in ("code", "strong", "emph", "strike", "quotes"):
            out.append(token.strip("`*_~'"))
        elif k == "link":
            out.append(re.match(r"!?\[([^\]]*)\]", token)[1])
        elif k == "wikilink":
            out.append(token[2:-2].rpartition("|")[2])
        elif k in ("head", "wikihead"):
            out.append(token.strip().strip("#=").strip())
        elif k == "bullet":
            out.append("- ")
        elif k == "row":
            out.append(CELL.join(c.strip() for c in token.strip().strip("|").split("|")))
        elif k == "wikirow" and not token.strip().startswith("|-"):
            out.append(CELL.join(c.strip() for c in re.split(r"!!|\|\|", token.strip()[1:])))
        elif k in ("rule", "wikirow", "wikitable", "wikiend"):
            last += text[last:last + 1] == "\n"  # the line goes as a whole
    out.append(plain(text[last:]))
    joined = re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(rf" *{CELL} *", CELL, "".join(out)))
    return re.sub(r"\n{3,}", "\n\n", joined).strip().translate(MARKED).strip("\n"), len(hit)


def cleaned(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with each named column as clean text and ``markup_nodes``, how many nodes were markup."""
    fields = [f for f in rows.schema.fields if f.name != "markup_nodes"]
    rows = rows.select(*[f.name for f in fields])
    schema = T.StructType([*fields, T.StructField("markup_nodes", T.IntegerType())])
    at = [rows.columns.index(c) for c in columns]
    model = trained_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays, total = list(batch.columns), np.zeros(batch.num_rows, np.int32)
            for i in at:
                done = [clean_text(t, model) for t in arrays[i].to_pylist()]
                arrays[i] = pa.array([d[0] for d in done], pa.string())
                total += np.array([d[1] for d in done], dtype=np.int32) if done else 0
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total)], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def cleaned_sources(clauses: DataFrame, tables: DataFrame) -> DataFrame:
    """(src_table, src_key, field, text, markup_nodes) of every marked-up field, cleaned."""
    own = clauses.select(F.lit("clauses").alias("src_table"), F.col("clause_key").cast("string").alias("src_key"), F.lit("text").alias("field"), "text")
    raw = tables.select(F.lit("regulation_tables").alias("src_table"), F.col("table_id").alias("src_key"), F.inline(F.array(F.struct(F.lit("raw_html").alias("field"), F.col("raw_html").alias("text")), F.struct(F.lit("raw_markdown").alias("field"), F.col("raw_markdown").alias("text")))))
    return cleaned(own.unionByName(raw).filter(F.col("text").rlike(MAY_HOLD)), ["text"])


def marked_up(clauses: DataFrame, tables: DataFrame) -> DataFrame:
    """(src_table, src_key) of the rows that hold markup."""
    return cleaned_sources(clauses, tables).filter("markup_nodes > 0").select("src_table", "src_key").distinct()
