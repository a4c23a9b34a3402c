"""HTML, Markdown, wiki and LaTeX markup to clean text whose structure stays known.

A text body is taken apart into candidate nodes: elements, marked lines, fenced, indented and
verbatim regions and delimited formulas. Gradient-boosted trees decide from a node's
features (its form and marks, the dialect of the whole body, content statistics, borders,
neighbours, depth, attribute tokens) whether it is a heading, an item, code,
a formula or none of these. Decoding goes from the outside in: an accepted code region
hides everything in it, a rejected one is opened again, so an ancestor and its descendant
never contradict each other. The trees are fitted on documents that the module composes
itself, with known structure and look-alikes (prices, rules, comments, marks in code).
Stored pages have a tree of elements already: every block-level node of their main body is a
candidate there (pagenodes.py).

Null, empty and blank bodies hold no elements; a front matter holds none either.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import pagenodes, template
from .gbt import Boosted
from .htmlblocks import key64, norm, parse

KINDS = ("heading", "item", "code", "formula")
CLASSES = (*KINDS, "none")

#: Forms of candidate nodes, grouped by the kind they can be.
FORMS = (
    "atx setext wikihead section htmlhead",
    "minus plus star hash digit texitem li",
    "fence indent pre wikicode verbatim",
    "dollars bracket paren dollar math mathenv",
)
FORM = {name: (k, i) for k, names in enumerate(FORMS) for i, name in enumerate(names.split())}

_CODE = re.compile(
    r"(?P<fence>^(?P<in> {0,3})(?P<f>`{3,}|~{3,})(?P<info>[^\n`]*)\n(?P<fc>.*?)(?:^ {0,3}(?P=f)[`~]*[ \t]*$|\Z))"
    r"|(?P<pre><pre\b[^>]*>(?P<pc>.*?)</pre\s*>)"
    r"|(?P<wikicode><(?P<wt>syntaxhighlight|source|nowiki)\b[^>]*>(?P<wc>.*?)</(?P=wt)\s*>)"
    r"|(?P<verbatim>\\begin\{(?P<env>verbatim|Verbatim|lstlisting|minted|alltt)\*?\}(?P<opt>(?:\[[^\]\n]*\]|\{[^}\n]*\})*)(?P<vc>.*?)\\end\{(?P=env)\*?\})"
    r"|(?P<comment><!--.*?(?:-->|\Z))",
    re.S | re.M | re.I,
)
_FRONT = re.compile(r"\A﻿?\s*(?:---[ \t]*\n.*?\n(?:---|\.\.\.)[ \t]*(?:\n|\Z)|\+\+\+[ \t]*\n.*?\n\+\+\+[ \t]*(?:\n|\Z))", re.S)
_HTML_NODE = re.compile(r"<h(?P<l>[1-6])\b(?P<ha>[^>]*)>(?P<h>.*?)</h(?P=l)\s*>|<li\b(?P<la>[^>]*)>(?P<i>.*?)(?=</li\s*>|<li\b|</[uo]l\s*>|\Z)", re.S | re.I)
_MATH = re.compile(
    r"\\begin\{(?P<e>equation|displaymath|math|align|gather|multline|eqnarray|flalign)(?P<st>\*?)\}(?P<ec>.*?)\\end\{(?P=e)(?P=st)\}"
    r"|<math\b[^>]*>(?P<mc>.*?)</math\s*>|\$\$(?P<dc>.+?)\$\$|\\\[(?P<bc>.+?)\\\]|\\\((?P<pc>.+?)\\\)",
    re.S | re.I,
)
_ATX = re.compile(r" {0,3}(#{1,6})([ \t]+|$)(.*)")
_WIKI = re.compile(r"(={1,6})([^=\n].*?)(={1,6})\s*$")
_SECTION = re.compile(r"\s*\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]]*\])?\{")
_ITEM = re.compile(r"(\s*)([-+*•]|#+|\*+|\d{1,9}[.)]|\\item(?:\[[^\]]*\])?)(\s*)(.*)")
_UNDER = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")


_INDENTED = re.compile(r"^(?:    |\t).*$", re.M)
_INDENT_REGION = re.compile(r"^(?: {4}|\t)[ \t]*\S[^\n]*(?:\n+(?:[ \t]*\n)*(?: {4}|\t)[ \t]*\S[^\n]*)*", re.M)
_TRAIL = re.compile(r"(?:(?:^|\s+)#+\s*|\s*\{[#.:][^{}]*\}\s*)+$")
_QUOTE_MARK = re.compile(r"^ {0,3}(?:> ?)+", re.M)
_TABLE_RULE = re.compile(r"^[ \t]*(?:\{\|.*|\|[-}].*|\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t:-]*)$", re.M)
_SETEXT_NO = re.compile(r"\s*(?:[-+*]|\d+[.)])\s")
_FRAME = re.compile(r"\\(?:begin|end|documentclass|usepackage)(?:\[[^\[\]\n]*\])?\{[^{}\n]*\}(?:\[[^\[\]\n]*\]|\{[^{}\n]*\})*")
_MD_SIGNS = re.compile(r"^#{2,6} \S|^.*\S\n(?:-{3,}|={3,})[ \t]*$|\]\([^)\n]*\)|\*\*\S|^[-+] \S|^\d+\. \S|^\$\$|`\S", re.M)
_WIKI_HEADS = re.compile(r"^(=+)[^=\n]+\1\s*$", re.M)
_WIKI_SIGNS = re.compile(r"'{2,3}\S|\[\[|^\{\||\[https?://\S+ |^\{\{[^{#]|</?(?:ref|math|nowiki)\b", re.M)
_TEX_COMMAND = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{((?:[^{}\\]|\\.)*)\}")
_TEX_SIGNS = re.compile(r"\\(?:sub)*section\*?\{|\\(?:begin|end|item|textbf|emph|texttt|href|cite|label|documentclass)\b")
_HTML_SIGNS = re.compile(r"</(?:p|h[1-6]|li|ul|table|pre|div)>", re.I)


def _bucket(n: int) -> int:
    return min(15, n.bit_length()) if n > 0 else 0


def dialect(body: str) -> tuple[int, int, int, int, int]:
    """How much of the body outside its code looks like Markdown, wiki, LaTeX and HTML, each 0 to 3, and the leading one of the first three."""
    body = _INDENTED.sub("", _CODE.sub("", body))
    md = len(_MD_SIGNS.findall(body))
    wiki = 2 * len(_WIKI_HEADS.findall(body)) + len(_WIKI_SIGNS.findall(body))
    tex = len(_TEX_SIGNS.findall(body))
    tags = len(_HTML_SIGNS.findall(body))
    lead = 2 if tex > max(md, wiki) else 1 if wiki > md else 0
    return (*(min(3, _bucket(n)) for n in (md, wiki, tex, tags)), lead)


def features(form: str, content: str, d: tuple, *, mark_space: int = 1, left: str = "", right: str = "", before: int = 1, after: int = 1, run: int = 0, size: int = 0, depth: int = 0, attrs: str = "", linked: int = 0) -> tuple[int, ...]:
    kind, i = FORM[form]
    c = content.strip()
    return (
        kind, i, kind * 8 + i, *d,
        _bucket(len(c)), _bucket(c.count(" ") + 1 if c else 0), _bucket(c.count("\n")),
        int(content[:1].isspace()), int(content[-1:].isspace()), int(c[:1].isdigit()), int("\\" in c or "^" in c), int("=" in c or "_" in c or "<" in c),
        min(3, mark_space), int(left[-1:].isalnum()), int(right[:1].isalnum()), before, after, min(3, run), _bucket(size), min(4, depth),
        int("math" in attrs) + 2 * int("code" in attrs or "language" in attrs or "highlight" in attrs), min(3, linked), int(c[-1:] in ".?!。") if c else 0, int(c[:1] in "*_" and c[-1:] in "*_") if c else 0,
    )


def clean(text: str, d: tuple) -> str:
    """A piece of text without inline markup, in the body's dialect."""
    wiki, tex = d[4] == 1, d[4] == 2
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\x00{len(held) - 1}\x00"

    if "`" in text and not tex:
        text = _INLINE_CODE.sub(lambda m: hold(m[2].strip() if len(m[1]) > 1 else m[2]), text)
    if "\\" in text or "~" in text:
        if tex:
            text = re.sub(r"(?<!\\)%.*", "", text)
            text = re.sub(r"~?\\(?:cite[a-z]*|label|ref|footnote|index)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
            text = re.sub(r"\\href\{[^{}]*\}\{", r"\\emph{", text)
            n = 1
            while n:  # from the inside out, one level a turn
                text, n = _TEX_COMMAND.subn(r"\1", text)
            text = text.replace("~", " ")
            text = re.sub(r"\\([#$%&_{}])", r"\1", text)
        else:
            text = re.sub(r"\\([\\`*_{}\[\]()#+\-.!|<>~$&])", lambda m: hold(m[1]), text)
    if "[" in text:
        if wiki and "]" in text:
            text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", text)
            text = re.sub(r"\[(?:https?:|mailto:|//)\S*\s+([^\]]*)\]", r"\1", text)
        else:
            text = re.sub(r"!?\[([^\[\]]*)\](?:\([^)\s]*(?:\s+\"[^\"]*\")?\)|\[[^\]]*\])", r"\1", text)
    if wiki:
        text = re.sub(r"<ref\b[^>]*?(?:/>|>.*?</ref\s*>)", "", text, flags=re.S | re.I)
        text = re.sub(r"\{\{[^{}]*\}\}", "", text)
        text = re.sub(r"'{2,5}", "", text)
    elif "*" in text or "_" in text or "~~" in text:
        text = re.sub(r"(\*{1,3}|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", text, flags=re.S)
        text = re.sub(r"(?<!\w)(_{1,3})(?=\S)([^_]+?)(?<=\S)\1(?!\w)", r"\2", text)
    if "<" in text:
        text = _TAG.sub("", re.sub(r"<br\s*/?>", " ", text, flags=re.I))
    text = _html.unescape(text)
    for i, s in enumerate(held):
        text = text.replace(f"\x00{i}\x00", s)
    return " ".join(text.split())


def _blank(m_or_text: str) -> str:
    return re.sub(r"[^\n]", " ", m_or_text)


class Model:
    """Candidate extraction and decoding with the fitted trees; without trees it collects candidates."""

    def __init__(self, trees: Boosted | None = None, nodes: Boosted | None = None):
        self.trees, self.nodes = trees, nodes
        self.seen: list[tuple[tuple[int, ...], str, str]] = []

    def decide(self, form: str, kind: str, text: str, row: tuple[int, ...]) -> bool:
        if self.trees is None:
            self.seen.append((row, kind, text))
            return True
        return self.trees.predict(row) == kind

    def elements(self, body: str | None, between: bool = True) -> list[tuple[int, str, str]]:
        """(position, kind, text) of headings, items, code, formulas and, if asked for, the text between them."""
        if not body or body.isspace():
            return []
        body = body.replace("\r\n", "\n").replace("\r", "\n")
        front = _FRONT.match(body)
        if front:
            body = _blank(front[0]) + body[front.end() :]
        d = dialect(body)
        out: list[tuple[int, str, str]] = []
        masked: list[str] = []
        pos = 0
        while True:
            m = _CODE.search(body, pos)
            if not m:
                break
            masked.append(body[pos : m.start()])
            pos = m.end()
            if m["comment"] is not None:
                masked.append(_blank(m[0]))
                continue
            name, content = self._code(m)
            row = features(name, content, d, before=int(body[max(0, m.start() - 2) : m.start()].strip() == ""), size=len(m["f"] or ""), attrs=(m["info"] or "") if name == "fence" else m[0][: m[0].find(">") + 1].lower())
            if self.decide(name, "code", content, row):
                out.append((m.start(), "code", content))
                masked.append(_blank(m[0]))
            else:  # not code: its inside is looked at again
                masked.append(m[0][0])
                pos = m.start() + 1
        masked.append(body[pos:])
        text = "".join(masked)
        text = self._indented(text, d, out)
        text = self._html(text, d, out)
        text = self._lines(text, d, out)
        text = self._formulas(text, d, out)
        if between:
            self._between(text, d, out)
        out.sort(key=lambda e: e[0])
        return out

    def _between(self, text: str, d: tuple, out: list) -> None:
        if "{%" in text:
            text = re.sub(r"^[ \t]*\{%.*?%\}[ \t]*$", lambda m: _blank(m[0]), text, flags=re.M)
        if "[[" in text:
            text = re.sub(r"^\[\[[^\[\]|]*:[^\[\]]*\]\][ \t]*$", lambda m: _blank(m[0]), text, flags=re.M)
        if "\n>" in text or text.startswith(">"):
            text = _QUOTE_MARK.sub(lambda m: _blank(m[0]), text)
        if "|-" in text or "-|" in text or "- |" in text or "{|" in text:
            text = _TABLE_RULE.sub(lambda m: _blank(m[0]), text)
        if d[2]:
            text = _FRAME.sub(lambda m: _blank(m[0]), text)
        for m in re.finditer(r"\S.*(?:\n.*\S.*)*", text):
            words = clean(m[0], d)
            if any(c.isalnum() for c in words):
                out.append((m.start(), "text", words))

    @staticmethod
    def _code(m: re.Match) -> tuple[str, str]:
        if m["fence"] is not None:
            return "fence", m["fc"]
        if m["pre"] is not None:
            c = re.sub(r"\A\s*<nowiki>|</nowiki>\s*\Z", "", m["pc"])
            return "pre", _html.unescape(_TAG.sub("", re.sub(r"<br\s*/?>", "\n", c))) if c == m["pc"] else c
        if m["wikicode"] is not None:
            return "wikicode", m["wc"]
        return "verbatim", m["vc"]

    def _indented(self, text: str, d: tuple, out: list) -> str:
        """Regions of four blanks or a tab after an empty line."""

        def take(m: re.Match) -> str:
            i = m.start()
            if i and text[text.rfind("\n", 0, i - 1) + 1 : i - 1].strip():
                return m[0]
            content = "\n".join(x[1:] if x[:1] == "\t" else x[4:] for x in m[0].rstrip().split("\n"))
            if self.decide("indent", "code", content, features("indent", content, d)):
                out.append((m.start(), "code", content))
                return _blank(m[0])
            return m[0]

        return _INDENT_REGION.sub(take, text) if "\n    " in text or "\t" in text or text.startswith("    ") else text

    def _html(self, text: str, d: tuple, out: list) -> str:
        if "<h" not in text and "<li" not in text and "<H" not in text and "<LI" not in text:
            return text

        def take(m: re.Match) -> str:
            form, kind = ("htmlhead", "heading") if m["h"] is not None else ("li", "item")
            content = m["h"] if m["h"] is not None else m["i"]
            words = clean(content, d)
            if words and self.decide(form, kind, words, features(form, content, d, attrs=(m["ha"] or m["la"] or "").lower(), depth=1)):
                self._formulas(content, d, out, m.start())
                out.append((m.start(), kind, words))
                return _blank(m[0])
            return m[0]

        return _HTML_NODE.sub(take, text)

    def _lines(self, text: str, d: tuple, out: list) -> str:
        lines = text.split("\n")
        n = len(lines)
        offset = [0] * (n + 1)
        for i, line in enumerate(lines):
            offset[i + 1] = offset[i] + len(line) + 1
        blank = [not x.strip() for x in lines]
        marks = [""] * n
        for i, line in enumerate(lines):
            m = _ITEM.match(line) if not blank[i] else None
            if m:
                marks[i] = "9" if m[2][0].isdigit() else m[2][:5]
        i = 0
        while i < n:
            line = lines[i]
            if blank[i]:
                i += 1
                continue
            before, after = int(i == 0 or blank[i - 1]), int(i + 1 >= n or blank[i + 1])
            done = 1
            form = content = ""
            extra: dict = {}
            m = None
            if (m := _SECTION.match(line)) is not None:
                form, content = "section", _braced(line, m.end())
            elif (m := _WIKI.match(line)) is not None:
                form, content, extra = "wikihead", m[2], {"size": len(m[1]), "run": int(len(m[1]) == len(m[3]))}
            elif (m := _ATX.match(line)) is not None:
                form, content, extra = "atx", m[3], {"size": len(m[1]), "run": sum(marks[k][:1] == "#" for k in (i - 1, i + 1) if 0 <= k < n)}
                content = _TRAIL.sub("", content)
            elif i + 1 < n and (m := _UNDER.match(lines[i + 1])) is not None and not _SETEXT_NO.match(line):
                form, content, extra = "setext", _TRAIL.sub("", line), {"size": len(m[1])}
                done = 2
                after = int(i + 2 >= n or blank[i + 2])
            if form:
                words = clean(content, d)
                if words and self.decide(form, "heading", words, features(form, content, d, before=before, after=after, **extra)):
                    self._formulas(content, d, out, offset[i])
                    out.append((offset[i], "heading", words))
                    for k in range(i, i + done):
                        lines[k], blank[k] = " " * len(lines[k]), True
                    i += done
                    continue
            m = _ITEM.match(line)
            if m and m[4]:
                mark = m[2]
                form = "texitem" if mark[0] == "\\" else "digit" if mark[0].isdigit() else {"-": "minus", "+": "plus", "*": "star", "#": "hash", "•": "minus"}[mark[0]]
                run = sum(marks[k] == marks[i] for k in (i - 1, i + 1) if 0 <= k < n)
                end = i + 1 if d[4] == 1 else _item_end(lines, blank, marks, i)  # a wiki item ends with its line
                whole = " ".join([m[4], *(x.strip() for x in lines[i + 1 : end])]) if end > i + 1 else m[4]
                words = clean(whole, d)
                if words and self.decide(form, "item", words, features(form, m[4], d, mark_space=min(2, len(m[3])), before=before, after=after, run=run, size=len(mark), depth=len(m[1]) // 2)):
                    self._formulas(whole, d, out, offset[i])
                    out.append((offset[i], "item", words))
                    for k in range(i, end):
                        lines[k], blank[k] = " " * len(lines[k]), True
            i += 1
        return "\n".join(lines)

    def _formulas(self, text: str, d: tuple, out: list, base: int = -1) -> str:
        if "$" not in text and "\\" not in text and "<math" not in text:
            return text
        if "`" in text:
            text = _INLINE_CODE.sub(lambda m: m[0] if "\n\n" in m[0] else " " * len(m[0]), text)

        def take(m: re.Match) -> str:
            form = "mathenv" if m["e"] else "math" if m["mc"] is not None else "dollars" if m["dc"] is not None else "bracket" if m["bc"] is not None else "paren"
            content = next(m[g] for g in ("ec", "mc", "dc", "bc", "pc") if m[g] is not None)
            if form == "math":
                content = _html.unescape(content)
            if content.strip() and self.decide(form, "formula", content, features(form, content, d)):
                out.append((m.start() if base < 0 else base, "formula", content.strip()))
                return _blank(m[0])
            return m[0]

        text = _MATH.sub(take, text)
        at = [m.start() for m in re.finditer(r"(?<!\\)\$", text)]
        i = 0
        cut: list[tuple[int, int]] = []
        while i + 1 < len(at):
            a, b = at[i], at[i + 1]
            content = text[a + 1 : b]
            if content.strip() and "\n\n" not in content:
                row = features("dollar", content, d, left=text[max(0, a - 1) : a], right=text[b + 1 : b + 2])
                if self.decide("dollar", "formula", content, row):
                    out.append((a if base < 0 else base, "formula", content.strip()))
                    cut.append((a, b + 1))
                    i += 2
                    continue
            i += 1
        for a, b in reversed(cut):
            text = text[:a] + _blank(text[a:b]) + text[b:]
        return text

    def page_view(self, page: str | None, site: dict) -> tuple[pagenodes.View, list[bool]]:
        """The nodes of a stored page, and which of its blocks are chrome."""
        nodes, blocks = parse(page)
        chrome = template.is_chrome(nodes, blocks, site)
        return pagenodes.View(nodes, blocks, chrome), chrome

    def page_elements(self, page: str | None, site: dict, between: bool = True) -> list[tuple[int, str, str]]:
        """The same for the main body of a stored page, over its element tree."""
        return self.view_elements(*self.page_view(page, site), between)

    def view_elements(self, view: pagenodes.View, chrome: list[bool], between: bool = True) -> list[tuple[int, str, str]]:
        blocks = view.blocks
        out: list[tuple[int, str, str]] = []
        d = (0, 0, 0, 3, 0)
        owner, kinds = pagenodes.decode(view, self.nodes)
        parts: dict[int, list[str]] = {}
        at: dict[int, int] = {}
        for k, (b, c) in enumerate(zip(blocks, chrome)):
            if c:
                continue
            i = owner[b.node]
            kind = kinds.get(i, "text")
            words = b.text if kind == "code" else " ".join(b.text.split())
            if kind != "code":
                self._formulas(b.text, d, out, k)
            if kind != "text":
                parts.setdefault(i, []).append(words)
                at.setdefault(i, k)
            elif between:
                out.append((k, kind, words))
        out.extend((at[i], kinds[i], ("\n" if kinds[i] == "code" else " ").join(x)) for i, x in parts.items())
        out.sort(key=lambda e: e[0])
        return out


def _item_end(lines: list[str], blank: list[bool], marks: list[str], i: int) -> int:
    """The line after the item that begins in line i: it goes on up to a blank line or one with a mark of its own."""
    k = i + 1
    while k < len(lines) and not blank[k] and not marks[k] and not _OWN_LINE.match(lines[k]):
        if k + 1 < len(lines) and _UNDER.match(lines[k + 1]):
            break
        k += 1
    return k


_OWN_LINE = re.compile(r"[ \t]*(?:#{1,6}[ \t]|[>|<]|={1,6}[^=]|\$\$|\\(?:\[|begin|end|(?:sub)*section|paragraph|chapter|part)|(?:[-*_][ \t]*){3,}$|`{3}|~{3}|\{[%|]|=+[ \t]*$)")

def _braced(line: str, i: int) -> str:
    """The text up to the brace that closes the one before position i."""
    level, j = 1, i
    while j < len(line) and level:
        c = line[j]
        if c == "\\":
            j += 1
        elif c == "{":
            level += 1
        elif c == "}":
            level -= 1
        j += 1
    return line[i : j - 1] if not level else line[i:]


# Documents with known structure, composed for the fit.

_WORDS = "alpha brook cedar delta ember flint grove haven iris junction kernel lantern meadow north orbit prism quartz river summit timber umbra valley willow xenon yarrow zephyr of the with and for in on to from by".split()
_TEX = [r"\frac{a}{b + 1}", r"x^{2} + y_{3}", r"\sum_{k=1}^{9} a_{k}", r"E = m c^2", r"\alpha + \beta \le 4", r"n \approx 10^{3}", r"a_{i} = b", r"f(x) = 2x", r"\max(p, q) < 3", r"x", r"n - 1", r"\int_0^1 z \, dz"]


def _sentence(r: random.Random, k: int = 0) -> str:
    return " ".join(r.choice(_WORDS) for _ in range(k or r.randint(3, 12))).capitalize()


def _compose(r: random.Random, kind: str) -> tuple[str, set[tuple[str, str]]]:
    """A document in one dialect and its true elements."""
    parts: list[str] = []
    tagged = r.random() < 0.5  # paragraphs in tags
    true: set[tuple[str, str]] = set()

    def add(k: str, text: str) -> str:
        true.add((k, norm(text)))
        return text

    def code() -> str:
        return "\n".join(r.choice(["x = 1", "# start the thing", "== 12 ==", "* file.db '''4'''", "\\section{7}", "- entry", "1. step", "echo $HOME $PATH", "if a < b and c > d:", "    return rows", "\"cost\": \"$5\"", "key: value", "<h2>t</h2>", "<li>q</li>", "$x$ not math"]) for _ in range(r.randint(1, 6)))

    for _ in range(r.choice((r.randint(1, 3), r.randint(3, 14)))):
        what = r.random()
        s = _sentence(r)
        if what < 0.22:
            t = add("heading", s)
            if kind == "md":
                f = r.random()
                parts.append(f"{'#' * r.randint(1, 6)} {t}" + r.choice(["", "", " ##"]) if f < 0.6 else f"{t}\n{r.choice('-=') * r.randint(3, 14)}" if f < 0.8 else f"<h{(l := r.randint(1, 6))} id=\"a\">{t}</h{l}>")
            elif kind == "wiki":
                e, sp = "=" * r.randint(1, 5), r.choice(["", " "])
                parts.append(f"{e}{sp}{t}{sp}{e}")
            else:
                parts.append(f"\\{r.choice(['', 'sub', 'subsub'])}section{r.choice(['', '*'])}{{{t}}}" + r.choice(["", "\\label{s:1}"]))
        elif what < 0.42:
            items = [add("item", _sentence(r)) for _ in range(r.randint(1, 5))]
            if kind == "md":
                m = r.choice(["-", "*", "+", "1.", "html"])
                parts.append("<ul>" + "".join(f"<li>{x}</li>\n" for x in items) + "</ul>" if m == "html" else "\n".join(f"{i + 1}. {x}" if m == "1." else f"{m} {x}" for i, x in enumerate(items)))
            elif kind == "wiki":
                m, sp = r.choice("*#"), r.choice(["", " "])
                parts.append("\n".join(f"{m}{sp}{x}" for x in items))
            else:
                e = r.choice(["itemize", "enumerate"])
                parts.append(f"\\begin{{{e}}}\n" + "\n".join(f"  \\item {x}" for x in items) + f"\n\\end{{{e}}}")
        elif what < 0.58:
            c = code()
            add("code", c)
            if kind == "md":
                f = r.random()
                fence = r.choice(["```", "~~~", "````"])
                parts.append(f"{fence}{r.choice(['', 'python', 'text'])}\n{c}\n{fence}" if f < 0.5 or parts and parts[-1][:1] == " " else "\n".join("    " + x for x in c.split("\n")) if f < 0.75 else f"<pre><code class=\"language-x\">{_html.escape(c, quote=False)}</code></pre>")
            elif kind == "wiki":
                t = r.choice(["syntaxhighlight", "source", "pre"])
                parts.append(f"<{t}{' lang=x' if t != 'pre' else ''}>\n{c}\n</{t}>" if t != "pre" else f"<pre><nowiki>{c}</nowiki></pre>")
            else:
                t = r.choice(["verbatim", "lstlisting"])
                parts.append(f"\\begin{{{t}}}\n{c}\n\\end{{{t}}}")
        elif what < 0.74:
            x = add("formula", r.choice(_TEX))
            if kind == "wiki":
                parts.append(r.choice([f":<math>{x}</math>", f"{s}. <math>{x}</math> {_sentence(r)}."]))
            elif kind == "md":
                parts.append(r.choice([f"$$\n{x}\n$$", f"$${x}$$", f"\\[{x}\\]", f"{s}. ${x}$ {_sentence(r)}.", f"{s} costs $5 now. ${x}$ is {_sentence(r)}.", f"{s} \\({x}\\) more."]))
            else:
                parts.append(r.choice([f"\\begin{{equation}}\n  {x}\n\\end{{equation}}", f"\\[{x}\\]", f"{s}. ${x}$ {_sentence(r)}.", f"{s} \\({x}\\) more."]))
        elif what < 0.86 and kind != "tex":
            parts.append(r.choice([f"One {s} costs ${r.randint(2, 900)} per month, and {_sentence(r)} costs ${r.randint(2, 900)} more.", f"Pay ${r.randint(1, 9)} or ${r.randint(10, 99)} for {s}.", f"Set $HOME and $PATH first. {s}.", f"{s} takes $ {r.randint(1, 9)} and $ {r.randint(1, 9)}."]))
        elif what < 0.9 and kind == "md":
            parts.append(r.choice(["---", "***", "----------", f"*{s}.*", f"**{s}.**"]))
        else:
            parts.append(f"<p>{s}. {_sentence(r)}.</p>" if tagged and kind == "md" else f"{s}. {_sentence(r)}.")
    return "\n\n".join(parts) + "\n", true


def fit(documents: int = 1200, seed: int = 7) -> Model:
    """Trees fitted on ``documents`` composed documents; the same for every call."""
    r = random.Random(seed)
    rows: list[tuple[int, ...]] = []
    labels: list[str] = []
    for i in range(documents):
        body, true = _compose(r, ("md", "md", "wiki", "tex")[i % 4])
        m = Model()
        m.elements(body)
        for row, kind, text in m.seen:
            rows.append(row)
            labels.append(kind if (kind, norm(text)) in true else "none")
    for k in range(60):  # formulas in the text of pages
        rows.append(features(("dollars", "bracket", "paren", "dollar")[k % 4], r.choice(_TEX), (0, 0, 0, 3, 0)))
        labels.append("formula")
        rows.append(features("dollar", f"{k} per month, and {_sentence(r)} costs ", (0, 0, 0, 3, 0), right=str(k)))
        labels.append("none")
    return Model(Boosted.fit(rows, labels, CLASSES), pagenodes.fit())


def _bodies(model: Model, text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _emit(b.column("path").to_pylist(), (model.elements(x, text) for x in b.column("body").to_pylist()), text)

    return run


def _pages(model: Model, text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            pages = zip(b.column("path").to_pylist(), b.column("html").to_pylist(), template.Sites(b, held))
            while part := list(islice(pages, 64)):  # whose nodes are classified together
                views = [model.page_view(h, s) for _, h, s in part]
                model.nodes.learn(row for v, _ in views for row in v.rows())
                yield _emit([p for p, _, _ in part], (model.view_elements(v, c, text) for v, c in views), text)

    return run


def _emit(paths: list, found: Iterator, text: bool) -> pa.RecordBatch:
    if text:
        rows = [(p, render(e)) for p, e in zip(paths, found)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["raw_path", "text"])
    ps, ks, hs = [], [], []
    for p, elements in zip(paths, found):
        own = dict.fromkeys((kind, key64(t)) for _, kind, t in elements if kind != "text" and t.strip())
        ps.extend([p] * len(own))
        ks.extend(k for k, _ in own)
        hs.extend(h for _, h in own)
    return pa.RecordBatch.from_arrays([pa.array(ps, pa.string()), pa.array(ks, pa.string()), pa.array(hs, pa.int64())], ["raw_path", "kind", "key"])


def render(elements: list[tuple[int, str, str]]) -> str:
    """Clean text with one notation for each kind."""
    show = {"heading": lambda t: f"# {t}", "item": lambda t: f"- {t}", "code": lambda t: "```\n" + t.strip("\n") + "\n```", "formula": lambda t: f"$$ {t} $$", "text": lambda t: t}
    return "\n".join(show[k](t) for _, k, t in elements)


def _both(raw_md: DataFrame, raw_html: DataFrame, text: bool, schema: str) -> DataFrame:
    model = fit()
    bodies = spread(raw_md.select(F.col("raw_md_path").alias("path"), "body")).mapInArrow(_bodies(model, text), schema)
    return bodies.unionByName(template.attach(raw_html, template.template(raw_html)).mapInArrow(_pages(model, text), schema))


def structure(raw_md: DataFrame, raw_html: DataFrame) -> DataFrame:
    """(raw_path, kind, text_key): distinct structural elements of every body."""
    found = _both(raw_md, raw_html, False, "raw_path string, kind string, key long")
    return found.select("raw_path", "kind", F.lower(F.lpad(F.hex("key"), 16, "0")).alias("text_key"))


def clean_text(raw_md: DataFrame, raw_html: DataFrame) -> DataFrame:
    """(raw_path, text): the clean text of every body in one notation."""
    return _both(raw_md, raw_html, True, "raw_path string, text string")
