import pytest

from clausewright.llm import markup as M
from tests import hostile


@pytest.fixture(scope="module")
def model():
    return M.trained_model()


@pytest.mark.parametrize("text", [
    "if v < 3 and w > 5 then stop", "the offset |d| is at most 3 m", "mark #15 next to the lamp*", "costs 7 $ per run and 8 $ more", "R&D; Smith & Sons", "see [13] below", "x = a / b", "<TO BE COMPLETED> is open", "{{title}} of ${name}", "[[INSERT title HERE]]", "a_b and c_d", "(a) one; (b) two",
    "The tyres are warmed \n- 71 -\n up before the run.", "If v < 3 and the gap \n > 12.5, the test ends.", "speed\tgap\n-\t3.4\n> 2\t5 *", "speed [$k m / h$]\tgap\n50 $k m / h$\t3",
    "The track charges 22 $ per run " + "while the unit of the trailer stays coupled " * 8 + "and 39 $ per day.", "${title} of the lamp costs 10 $ per run", None, "", "  ",
])
def test_plain_signs(model, text):
    assert M.clean_text(text, model) == (text, 0)


@pytest.mark.parametrize("text, clean", [
    ("<h3>Scope</h3>\n<p>The <b>lamp</b> glows.</p>", "Scope\n\nThe lamp glows."), ("<ul><li>one<li>two</ul>", "- one\n- two"), ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "a\tb\n1\t2"), ("5&deg; &amp; more &#8805; 2", "5° & more ≥ 2"), ("== Scope ==\nThe '''lamp''' glows.", "Scope\nThe lamp glows."),
    ("[[Annex 2|the lamp]] refers", "the lamp refers"), ("## Scope\n- **one**\n- `two`", "Scope\n- one\n- two"), ("See [the lamp](annex-2.md).", "See the lamp."), ("\\section{Scope}\n\\begin{itemize}\n\\item one\n\\end{itemize}", "Scope\n\n\n- one".replace("\n\n\n", "\n\n")), ("$v_{rel} \\leq 65~\\mathrm{km/h}$", "v_rel ≤ 65 km/h"),
    ("```\nif a < 3:\n    stop()\n```", "if a < 3:\n    stop()"), ("| a | b |\n|---|---|\n| 1 | 2 |", "a\tb\n1\t2"), ("{| class=\"x\"\n! a\n|-\n| 1\n|}", "a\n1"),
    ("<table>\n<tr><td> 1 </td>\n<td></td>\n<td> <b>x</b> y<br>z </td>\n</tr>\n<tr><td></td><td>2</td><td>3</td></tr></table>\n<p>End.</p>", "1\t\tx y z\n\t2\t3\n\nEnd."),
    ("<pre>if a:\n    b &lt; 2\n</pre>", "if a:\n    b < 2"), ("\\begin{tabular}{ll}\na & b \\\\ \\hline\n1 & 2 \\\\\n\\end{tabular}", "a\tb\n1\t2"), ("<table><tr><td>a<td>b</table> <b>x</b> <i>y</i>", "a\tb\nx y"),
])
def test_conversion(model, text, clean):
    got, n = M.clean_text(text, model)
    assert n > 0 and got == clean


def test_long_inline_spans(model):
    """No length of a formula, an emphasis, a link or code hides it."""
    many = "the control unit may record the result, " * 12
    formula = "$" + " + ".join(f"a_{{{i}}} x^{{{i}}}" for i in range(40)) + " \\leq v$"
    assert M.clean_text(f"The sum {formula} holds.", model)[0] == "The sum " + " + ".join(f"a_{i} x^{i}" for i in range(40)) + " ≤ v holds."
    assert M.clean_text(f"Note: **{many}and so on.** It ends.", model)[0] == f"Note: {many}and so on. It ends."
    assert M.clean_text(f"See [{many}the annex](https://example.org/{'a/' * 150}) again.", model)[0] == f"See {many}the annex again."
    # markup between two prices is not lost
    assert M.clean_text(f"It costs 7 $ as {many}the <b>lamp</b> is &le; 5 or \\textbf{{more}}, and 9 $ per day.", model)[0] == f"It costs 7 $ as {many}the lamp is ≤ 5 or more, and 9 $ per day."


def test_held_out_accuracy(model):
    right = total = 0
    for text, spans in M.labelled_pages(300, seed=1234):
        nodes, p = M.markup_nodes(text, model)
        for n, q in zip(nodes[1:], p[1:]):
            total += 1
            right += (q >= M.LEAST) == any(a <= n.start < b for a, b in spans)
    assert right / total > 0.99


def test_marginals_equal_brute_force(model):
    """Sum-product on a small tree against the sum over all states."""
    from itertools import product

    import numpy as np

    text = "<p>a <b>x</b></p> if v < 3 and y > 2"
    nodes = M.parse(text)
    M.featurise(text, nodes)
    weight = np.zeros(len(nodes))
    whole = 0.0
    for states in product((0, 1), repeat=len(nodes)):
        score = sum(model.unary(n) * s for n, s in zip(nodes[1:], states[1:])) + sum(model.edges.get((nodes[n.parent].kind, n.kind), np.zeros((2, 2)))[states[n.parent], s] for n, s in zip(nodes[1:], states[1:]))
        whole += np.exp(score)
        weight += np.exp(score) * np.array(states)
    assert model.marginals(nodes) == pytest.approx(list(weight / whole), abs=1e-9)


def test_very_long_and_unclosed(model):
    assert M.clean_text("<p>word " * 30_000, model)[1] == 30_000
    assert M.clean_text("$a ** b ' c _d [[e `f ~~g " * 5000, model)[0] is not None
    assert M.clean_text("<!-- " * 60_000 + "\\[ " * 5000 + "$$ x " * 5000, model)[0] is not None


def test_hostile_tables(tables):
    c, t = tables("clauses"), tables("regulation_tables")
    found = lambda f: {tuple(r) for r in M.marked_up(f(c), f(t)).collect()}
    plain = found(lambda x: x)
    assert plain and found(hostile.clashing) == plain == found(hostile.repeated) and found(hostile.empty) == set() and found(hostile.with_nulls) >= plain
