import random

import pytest

from pagemill.llm import markup
from pagemill.llm.htmlblocks import norm


@pytest.fixture(scope="module")
def model():
    return markup.fit()


def found(model, body):
    return {(k, norm(t)) for _, k, t in model.elements(body) if k != "text"}


def test_held_out_documents(model):
    r = random.Random(99)
    hit = got = want = 0
    for i in range(200):
        body, true = markup._compose(r, ("md", "wiki", "tex")[i % 3])
        out = found(model, body)
        hit, got, want = hit + len(out & true), got + len(out), want + len(true)
    assert hit / got > 0.97 and hit / want > 0.97


def test_markdown(model):
    body = "---\ntitle: x\n---\n\n# A `b` **c** ##\n\nSub *d*\n-----\n\n## E {#e-1}\n\n- one [l](u)\n- two\\_x\n\n1. three\n\n```py\n# not a heading\n- not an item\n```\n\n    indented <li>x</li>\n\nIt costs $5 per month, and $9 more. $a_1^2$ ends.\n\n$$\nx = \\frac{1}{2}\n$$\n"
    assert found(model, body) == {
        ("heading", "a b c"), ("heading", "sub d"), ("heading", "e"), ("item", "one l"), ("item", "two_x"), ("item", "three"), ("code", "# not a heading - not an item"),
        ("code", "indented <li>x</li>"), ("formula", "a_1^2"), ("formula", "x = \\frac{1}{2}"),
    }


def test_wiki_and_latex(model):
    wiki = "== A ''b'' [[P|c]] ==\n\n# one '''x'''\n# two\n\n*three\n\n<syntaxhighlight lang=c>\n== no ==\n</syntaxhighlight>\n\n:<math>x^2</math>\n\n[[Category:Q]]\n"
    assert found(model, wiki) == {("heading", "a b c"), ("item", "one x"), ("item", "two"), ("item", "three"), ("code", "== no =="), ("formula", "x^2")}
    tex = "\\documentclass{article}\n\\begin{document}\n\\section*{A \\emph{b}}\\label{s:1}\n\n\\begin{itemize}\n  \\item one\\_x~\\cite{k}\n  \\item \\textbf{two}\n\\end{itemize}\n\n\\begin{verbatim}\n\\section{no}\n\\end{verbatim}\n\n\\begin{equation}\n  E = m c^2\n\\end{equation}\n\\end{document}\n"
    assert found(model, tex) == {("heading", "a b"), ("item", "one_x"), ("item", "two"), ("code", "\\section{no}"), ("formula", "e = m c^2")}


def test_odd_bodies(model):
    for body in (None, "", "  \n ", "---\n# only: front\n---\n", "$", "`", "\\", "```\n", "<!-- # x -->"):
        assert all(k == "code" for _, k, _ in model.elements(body) if k != "text")
    assert len(model.elements("# x\r\n\r\n" + "word " * 200_000)) == 2


def test_tables(spark):
    md = spark.createDataFrame([("m", "# A\n\n- b\n", 1), ("n", None, 1), ("m", "# A\n\n- b\n", 1)], "raw_md_path string, body string, path int")
    html = spark.createDataFrame([("h", "s", "<main><h1>T</h1><ul><li>i</li><li>j</li></ul><pre>c\nd</pre><p>\\(x^2\\)</p></main>", 1)], "raw_html_path string, site_name string, html string, kind int")
    got = {(r.raw_path, r.kind) for r in markup.structure(md, html).collect()}
    assert got == {("m", "heading"), ("m", "item"), ("h", "heading"), ("h", "item"), ("h", "code"), ("h", "formula")}
    texts = {r.raw_path: r.text for r in markup.clean_text(md, html).collect()}
    assert texts["m"] == "# A\n- b" and "```\nc\nd\n```" in texts["h"]
    assert markup.structure(md.limit(0), html.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ['<a href="', "`", "\\begin{a", "[", "[[", "<", "&", "<p>", "<!--", "*", "$a", "=", "#", "<li>", "_a", "|-", "\\begin{equation}x"])
def test_hostile_bodies_take_no_quadratic_time(model, piece):
    import time

    site = {"blocks": frozenset(), "often": frozenset(), "main": frozenset(), "wide": frozenset()}
    body = piece * (60_000 // len(piece))
    began = time.process_time()
    model.elements(body)
    model.page_elements(body, site)
    assert time.process_time() - began < 10


def test_nodes_hold_their_whole_subtree(model):
    site = {"blocks": frozenset(), "often": frozenset(), "main": frozenset(), "wide": frozenset()}
    page = "<main><h2>Head</h2><ul><li><p>one part</p><p>and more</p><ul><li><p>inner</p></li></ul></li><li>two <div>parts</div></li></ul><pre><div>a = 1</div><div>b = 2</div></pre><p>text</p></main>"
    got = [(k, t) for _, k, t in model.page_elements(page, site)]
    assert got == [("heading", "Head"), ("item", "one part and more"), ("item", "inner"), ("item", "two parts"), ("code", "a = 1\nb = 2"), ("text", "text")]


def test_wrapped_items_and_long_formulas(model):
    body = "- first item goes\n  on here\n- second\nlazily wrapped\n\nA paragraph.\n"
    assert found(model, body) == {("item", "first item goes on here"), ("item", "second lazily wrapped")}
    tex = " + ".join(f"x_{{{i}}}^{{2}}" for i in range(300))
    assert len(tex) > 2000 and ("formula", norm(tex)) in found(model, f"Here ${tex}$ ends.\n")
