"""Kinds of the block-level nodes of a page, by gradient-boosted trees over DOM features.

Every block-level node that holds main text is a candidate. Its features are its tag and those around it,
depth, subtree size and density (characters an element), share of links, statistics of its siblings,
attribute tokens and the shape of its text. Decoding is hierarchical, from the outside in: nothing inside
an accepted code block or heading is decided anew, an item may hold items, headings and code of its own,
and a node that is none of them leaves its text to the node around it. So no choice contradicts one above it.

The trees are fitted on pages that the module composes itself, with look-alikes: bold lines, table
heads, definition terms, captions, terms and titles that are no headings, lines of inline code that
are no code blocks, cells and paragraphs in lists that are no items.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections import Counter
from functools import lru_cache

from .gbt import Boosted
from .htmlblocks import Block, Node, parse

KINDS = ("heading", "item", "code", "none")

#: Tags with a number of their own; all others share the last one.
TAGS = (
    "#root", "html", "body", "main", "article", "section", "div", "header", "footer", "nav", "aside", "form",
    "p", "blockquote", "figure", "figcaption", "caption", "table", "tr", "th", "td", "ul", "ol", "dl", "dt", "dd",
    "li", "h1", "h2", "h3", "pre",
)
_TAG = {**{t: i for i, t in enumerate(TAGS)}, "h4": 29, "h5": 29, "h6": 29, "listing": 30, "xmp": 30}
_OTHER = len(TAGS)
#: Words in class, id or role that tell about a node.
_ATTRS = (re.compile("code|highlight|language|listing|source|terminal"), re.compile(r"\bheading\b"), re.compile("list|item|step"), re.compile("math|formula"))


_BUCKETS = tuple(min(15, n.bit_length()) for n in range(8192))


def _bucket(n: int) -> int:
    return _BUCKETS[n] if n < 8192 else min(15, n.bit_length())


class View:
    """The nodes of a page with what stands in them of its main text."""

    def __init__(self, nodes: list[Node], blocks: list[Block], chrome: list[bool]):
        n = len(nodes)
        self.nodes, self.blocks = nodes, blocks
        self.tags = [_TAG.get(x.tag, _OTHER) for x in nodes]
        self.leads: dict[int, tuple] = {}
        self.same: dict[int, Counter] = {}
        self.known: dict[int, tuple[int, ...]] = {}
        self.first: list[int] = [-1] * n
        self.chars, self.linked, self.texts = [0] * n, [0] * n, [0] * n
        self.below, self.deep = [0] * n, [0] * n
        self.kids: list[list[int]] = [[] for _ in range(n)]
        for k, (b, c) in enumerate(zip(blocks, chrome)):
            if not c:
                i = b.node
                if self.first[i] < 0:
                    self.first[i] = k
                self.chars[i] += b.chars
                self.linked[i] += min(b.chars, b.linked)
                self.texts[i] += 1
        for i in range(1, n):
            self.kids[nodes[i].parent].append(i)
        for i in range(n - 1, 0, -1):  # children stand after their parents
            up = nodes[i].parent
            self.chars[up] += self.chars[i]
            self.linked[up] += self.linked[i]
            self.texts[up] += self.texts[i]
            self.below[up] += 1 + self.below[i]
            if self.first[i] >= 0 and (self.first[up] < 0 or self.first[i] < self.first[up]):
                self.first[up] = self.first[i]
            self.deep[up] = max(self.deep[up], self.deep[i] + 1)

    def _lead(self, i: int) -> tuple[str, int, int, int, int]:
        """Of the first text block of a node its inline attributes, lines, words, end mark and marks of code or weight."""
        k = self.first[i]
        got = self.leads.get(k)
        if got is None:
            b = self.blocks[k]
            text = b.text.strip()
            inner = " ".join(b.inner).lower() if b.inner else ""
            got = self.leads[k] = (inner, _bucket(text.count("\n")), _bucket(text.count(" ") + 1), int(text[-1:] in ".?!。:"), int("code" in inner) + 2 * int("strong" in inner or inner.startswith("b")))
        return got

    def rows(self) -> list[tuple[int, ...]]:
        """The features of all nodes that hold main text, kept for the decoding."""
        self.known = {i: self.row(i) for i, k in enumerate(self.first) if k >= 0}
        return list(self.known.values())

    def row(self, i: int) -> tuple[int, ...]:
        got = self.known.get(i)
        return self._row(i) if got is None else got

    def _row(self, i: int) -> tuple[int, ...]:
        nodes, tags = self.nodes, self.tags
        n = nodes[i]
        up = n.parent if n.parent >= 0 else 0
        around, own, at, tag = self.kids[up], self.kids[i], n.index, tags[i]
        last = len(around) - 1
        same = self.same.get(up)
        if same is None:
            same = self.same[up] = Counter(tags[k] for k in around)
        chars, below, over = self.chars[i], self.below[i], nodes[up].parent
        inner, lines, words, mark, weight = self._lead(i)
        if own:
            held = [tags[k] for k in own]
            inside = (min(3, held.count(_LI)), min(3, held.count(_P)), int(_PRE in held), min(3, len(own)), min(7, self.deep[i]))
        else:
            inside = _NOTHING
        return (
            tag, tags[up], tags[over] if over >= 0 else 0, n.depth if n.depth < 31 else 31, _bucket(below), _bucket(chars // (1 + below)),
            _bucket(self.texts[i]), _bucket(chars), 4 * self.linked[i] // (chars or 1), _bucket(last + 1), at if at < 7 else 7, _bucket(same[tag]),
            tags[around[at - 1]] if 0 < at <= last + 1 else 31, tags[around[at + 1]] if at < last else 31,
            _flags(n.cls, inner) if n.cls or inner else 0, lines, words, mark, weight, *inside,
        )


_NOTHING = (0, 0, 0, 0, 0)
_LI, _P, _PRE = _TAG["li"], _TAG["p"], _TAG["pre"]


@lru_cache(100_000)
def _flags(cls: str, inner: str) -> int:
    attrs = f"{cls} {inner}".lower()
    return sum(1 << k for k, a in enumerate(_ATTRS) if a.search(attrs))


def decode(view: View, trees: Boosted) -> tuple[list[int], dict[int, str]]:
    """For every node the one that its text belongs to (-1: none), and the kinds of those."""
    owner = [-1] * len(view.nodes)
    kinds: dict[int, str] = {}
    for i, n in enumerate(view.nodes):
        up = owner[n.parent] if n.parent >= 0 else -1
        owner[i] = up
        if view.first[i] < 0 or (up >= 0 and kinds[up] in ("code", "heading")):
            continue
        kind = trees.predict(view.row(i))
        if kind != "none":
            owner[i] = i
            kinds[i] = kind
    return owner, kinds


# Pages with known structure, composed for the fit. The attribute data-k holds the kind of a node.

_WORDS = "amber brisk cobalt dune ember fjord gravel harbor inlet jasper knoll ledger mossy nickel ochre plinth quarry ripple sable talus umber vale willow of the for in with".split()
_CODE = ("x = 1", "run --fast now", "if a < b:", "    return rows", "key: value", "# comment here", "make install", "GET /v1/items", "{\"a\": 2}", "</end>")
#: Attributes that tell nothing, as authors give them to any node.
_NOISE = (" class=x1", " class=note", " class='math'", " class='list part'", " class=title", " id=code-2", " class=source", " id=a", " class='step'", " class=highlighted")
_KIND_OF = re.compile(r"data-k=(\w+)")


def _words(r: random.Random, most: int = 14) -> str:
    return " ".join(r.choice(_WORDS) for _ in range(r.randint(1, most))).capitalize()


def _noise(r: random.Random) -> str:
    return r.choice(_NOISE) if r.random() < 0.25 else ""


def _inline(r: random.Random, text: str) -> str:
    f = r.random()
    if f > 0.9:
        return f"{text} <span{_noise(r)}>{r.choice(('(x^2)', 'a, b', text))}</span>{r.choice(('', '.', ' and so on'))}"
    return f"<a href='/x'>{text}</a>" if f < 0.12 else f"{text} <code>{r.choice(_WORDS)}</code>" if f < 0.24 else f"<b>{text}</b>" if f < 0.3 else f"<code>{text}</code>" if f < 0.34 else text + "." * (f < 0.6)


def _code(r: random.Random) -> str:
    lines = [_html.escape(r.choice(_CODE), quote=False) for _ in range(r.randint(1, 7))]
    f = r.random()
    body = "".join(f"<div>{x}</div>" for x in lines) if f < 0.1 else "\n".join(lines)
    cls = r.choice(("", " class='language-sh'", " class='x1'"))
    pre = f"<pre data-k=code{cls}>{body}</pre>" if f < 0.6 else f"<pre data-k=code><code{cls}>{body}</code></pre>"
    return pre if r.random() < 0.6 else f"<div class='{r.choice(('highlight', 'wrap', 'x7'))}'>{pre}</div>"


def _list(r: random.Random, level: int = 0) -> str:
    tag = r.choice(("ul", "ol"))
    out = []
    for _ in range(r.randint(1, 6)):
        t = _inline(r, _words(r))
        t = f"<p{_noise(r)}>{t}</p>" if r.random() < 0.25 else t
        if level < 2 and r.random() < 0.12:
            t += _list(r, level + 1)
        elif r.random() < 0.06:
            t += _code(r)
        out.append(f"<li data-k=item{_noise(r)}>{t}</li>")
    return f"<{tag}{r.choice(('', ' class=simple', ' class=steps'))}>{''.join(out)}</{tag}>"


def _piece(r: random.Random, level: int = 0) -> str:
    f = r.random()
    t = _inline(r, _words(r))
    if f < 0.24:
        n = r.randint(1, 6)
        return f"<h{n} data-k=heading{_noise(r)}>{t}</h{n}>"
    if f < 0.27:
        return f"<div role=heading data-k=heading>{_words(r, 6)}</div>"
    if f < 0.45:
        return r.choice((f"<p{_noise(r)}>{t} {_words(r, 30)}.</p>", f"<div{_noise(r)}>{t} {_words(r, 20)}</div>", f"<p>{t}</p>"))
    if f < 0.6:
        return _list(r)
    if f < 0.72:
        return _code(r)
    if f < 0.76:
        return "<p>" + r.choice((f"<b>{_words(r, 4)}</b>", f"<code>{r.choice(_CODE[:3])}</code>", f"<strong>{_words(r, 3)}:</strong>", f"{_words(r, 3)}")) + "</p>"
    if f < 0.82:
        cells = "".join("<tr>" + "".join(f"<td{_noise(r)}>{_inline(r, _words(r, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4)))
        return f"<table><tr>{''.join(f'<th>{_inline(r, _words(r, 2))}</th>' for _ in range(3))}</tr>{cells}</table>"
    if f < 0.86:
        return "<dl>" + "".join(f"<dt>{_inline(r, _words(r, 3))}</dt><dd>{_inline(r, _words(r))}</dd>" for _ in range(r.randint(1, 3))) + "</dl>"
    if f < 0.9:
        return r.choice((f"<blockquote><p>{_words(r)}</p></blockquote>", f"<figure><figcaption>{_words(r, 6)}</figcaption></figure>", f"<div class='{r.choice(('note', 'title', 'x3'))}'><p>{_words(r)}</p></div>", f"<div{_noise(r)}>{_inline(r, _words(r, 8))}</div>"))
    if level < 3:
        tag = r.choice(("div", "section", "article", "div"))
        return f"<{tag}{r.choice(('', ' class=part', ' class=section', ' class=code-samples'))}>{''.join(_piece(r, level + 1) for _ in range(r.randint(1, 5)))}</{tag}>"
    return f"<p>{t}</p>"


def compose(r: random.Random) -> str:
    """A page whose nodes say in data-k what they are."""
    body = "".join(_piece(r) for _ in range(r.randint(1, 12)))
    for _ in range(r.randint(0, 4)):
        body = r.choice(("<div>{}</div>", "<main>{}</main>", "<div class=c1>{}</div>", "<article>{}</article>", "<table><tr><td>{}</td></tr></table>")).format(body)
    return r.choice(("<body>{}</body>", "<html><body>{}</body></html>", "{}")).format(body)


def examples(r: random.Random, pages: int) -> tuple[list[tuple[int, ...]], list[str]]:
    rows, labels = [], []
    for _ in range(pages):
        page = compose(r)
        kinds = [m[1] if (m := _KIND_OF.search(t)) else "none" for t in re.findall(r"<(?!/|a\b|b\b|code|strong|span)([a-z][^>]*)>", page)]
        nodes, blocks = parse(page)
        view = View(nodes, blocks, [False] * len(blocks))
        if len(kinds) != len(nodes) - 1:
            continue  # an end tag that the parser supplied
        for i in range(1, len(nodes)):
            if view.first[i] >= 0:
                rows.append(view.row(i))
                labels.append(kinds[i - 1])
    return rows, labels


def fit(pages: int = 400, seed: int = 11) -> Boosted:
    """Trees fitted on ``pages`` composed pages; the same for every call."""
    return Boosted.fit(*examples(random.Random(seed), pages), KINDS)
