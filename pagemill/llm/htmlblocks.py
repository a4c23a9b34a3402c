"""Text blocks and a light element tree of an HTML page.

A *text block* is the non-blank text between two neighbouring tags; inline tags do not
separate, ``br`` is white space, character references are decoded and the contents of
comments, head, script, style, noscript, template and svg do not count.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
import struct

import xxhash

#: Tags that do not separate text blocks.
INLINE = frozenset("a abbr b code em i kbd mark small span strong sub sup u button label img".split())
#: Elements without text.
SKIPPED = "script|style|noscript|template|svg"

_ATTRS = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_SKIP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<head\b{_ATTRS}>.*?(?:</head\s*>|(?=<body\b)|\Z)|<({SKIPPED})\b{_ATTRS}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>",
    re.S | re.I,
)
_INLINE = re.compile(rf"</?(?:{'|'.join(sorted(INLINE))})(?=[\s/>]){_ATTRS}>", re.I)
_BR = re.compile(rf"</?br(?=[\s/>]){_ATTRS}>", re.I)
_ANY = re.compile(rf"</?[a-zA-Z]{_ATTRS}>")
_TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRS})>")
_CLASS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


_CLOSED = re.compile(rf"(?:-->|</(?:head|{SKIPPED})\s*>|<[!?][^>]*>)\Z", re.I)


def _skipped(m: re.Match) -> str:
    # A skipped element separates, a comment or declaration does not.
    return "<p>" if m[0][1] not in "!?" else ""


_DIGITS = re.compile(r"\d+")
_KEY = struct.Struct(">q8x").unpack


def norm(text: str) -> str:
    """Lower case, every run of white space one blank, trimmed."""
    return " ".join(text.lower().split())


def key64(text: str) -> int:
    """The first 16 hex digits of the MD5 of norm(text), as a signed 64-bit number."""
    return norm_key64(norm(text))


def norm_key64(normal: str) -> int:
    """key64 of a text that is in normal form already."""
    return _KEY(hashlib.md5(normal.encode("utf-8", "surrogatepass")).digest())[0]


def hash64(token: str) -> int:
    """A 64-bit digest that is the same in every process."""
    try:
        h = xxhash.xxh64_intdigest(token)
    except UnicodeEncodeError:  # half a character
        h = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _visible(page: str) -> tuple[str, str]:
    """The page up to its last tag end without what holds no text, and the rest, where no tag can end."""
    end = page.rfind(">") + 1
    head, rest = page[:end], page[end:]
    last = None

    def skip(m: re.Match) -> str:
        nonlocal last
        last = m
        return _skipped(m)

    shown = _SKIP.sub(skip, head)
    if last is not None and last.end() == end and not _CLOSED.search(last[0]):
        rest = ""  # inside an element or comment that is never closed
    return shown, rest.partition("<!--")[0]


def text_blocks(page: str | None) -> list[str]:
    """The text blocks of a page in order, references decoded, white space as it stands."""
    if not page:
        return []
    page, rest = _visible(page)
    page = _BR.sub(" ", _INLINE.sub("", page))
    out = []
    parts = _ANY.split(page)
    parts[-1] += rest
    for part in parts:
        if part and not part.isspace():
            text = _html.unescape(part) if "&" in part else part
            if text and not text.isspace():
                out.append(text)
    return out


# Opening one of these ends a paragraph that was left open.
_ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Opening the key ends an open element of the values, up to the scope element.
_SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
}


class Block:
    """A text block: text, element that holds it, and the share of it inside links."""

    __slots__ = ("text", "node", "linked", "chars", "inner", "_norm", "_masked", "full_link")

    def __init__(self, text: str, node: int, linked: int, chars: int, inner: list):
        self.text, self.node, self.linked, self.chars, self.inner = text, node, linked, chars, inner
        self._norm: str | None = None
        self._masked: str | None = None
        self.full_link = 0 < chars <= linked

    @property
    def norm(self) -> str:
        n = self._norm
        if n is None:
            n = self._norm = " ".join(self.text.lower().split())
        return n


    @property
    def masked(self) -> str:
        """The normal form with every number a #."""
        m = self._masked
        if m is None:
            m = self._masked = _DIGITS.sub("#", self.norm)
        return m


class Node:
    __slots__ = ("tag", "cls", "parent", "depth", "kids", "index")

    def __init__(self, tag: str, cls: str, parent: int, depth: int, index: int):
        self.tag, self.cls, self.parent, self.depth, self.kids, self.index = tag, cls, parent, depth, 0, index


def _dense(text: str) -> int:
    return len(text) - text.count(" ") - text.count("\n")


_IS_INLINE, _IS_BR, _ENDS, _SIBLING, _IS_VOID = 1, 2, 4, 8, 16
_P_SCOPE = frozenset(("td", "th", "table", "div", "li"))
_KIND: dict[str, int] = dict.fromkeys(INLINE, _IS_INLINE)
for _t in (*_ENDS_P, *_SIBLINGS, *_VOID):
    _KIND.setdefault(_t, (_ENDS if _t in _ENDS_P else 0) | (_SIBLING if _t in _SIBLINGS else 0) | (_IS_VOID if _t in _VOID else 0))
_KIND["br"] = _IS_BR
for _t in ("#root", "body", "html", "main", "article", "aside", "div", "nav", "section", "header", "footer", "p", "ul", "ol", "pre", "td", "tr", "table"):
    _KIND.setdefault(_t, 0)
_CLASSES: dict[str, str] = {}


def _add(blocks: list[Block], buf: list[str], node: int, linked: int, inner: list[str]) -> None:
    raw = "".join(buf) if len(buf) > 1 else buf[0]
    text = _html.unescape(raw) if "&" in raw else raw
    if text and not text.isspace():
        blocks.append(Block(text, node, linked, _dense(raw), inner))


def parse(page: str | None) -> tuple[list[Node], list[Block]]:
    """Element tree (block-level elements only) and text blocks of a page.

    Recovery: void elements; p ends at the next block element; li, td, th, tr, dt and dd
    end at their next sibling; an end tag without an open element is ignored.
    """
    nodes = [Node("#root", "", -1, 0, 0)]
    blocks: list[Block] = []
    if not page:
        return nodes, blocks
    page, rest = _visible(page)
    stack, opened = [0], ["#root"]  # the open elements and their tags
    buf: list[str] = []
    inner: list[str] = []
    links = linked = 0
    parts = _TAG.split(page)  # a text, then of every tag its slash, name, attributes and the text behind it
    last = parts.pop()

    for part, closing, tag, attrs in zip(parts[::4], parts[1::4], parts[2::4], parts[3::4]):
        if part:
            if not part.isspace():
                buf.append(part)
                if links:
                    linked += _dense(part)
            elif buf:
                buf.append(" ")
        kind = _KIND.get(tag)
        if kind is None:
            tag = tag.lower()
            kind = _KIND.get(tag, 0)
        if kind == _IS_INLINE:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            elif not closing:
                inner.append(tag + attrs)
            continue
        if kind == _IS_BR:
            if buf:
                buf.append(" ")
            continue
        if buf:
            _add(blocks, buf, stack[-1], linked, inner)
            buf = []
        if inner:
            inner = []
        linked = links = 0
        if closing:
            if opened[-1] == tag:
                stack.pop()
                opened.pop()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if opened[i] == tag:
                    del stack[i:], opened[i:]
                    break
            continue
        if kind & _ENDS and "p" in opened:
            for i in range(len(stack) - 1, 0, -1):
                t = opened[i]
                if t == "p":
                    del stack[i:], opened[i:]
                    break
                if t in _P_SCOPE:
                    break
        if kind & _SIBLING:
            ends, scope = _SIBLINGS[tag]
            cut = 0
            for i in range(len(stack) - 1, 0, -1):
                t = opened[i]
                if t in scope:
                    break
                if t in ends:
                    cut = i
            if cut:
                del stack[cut:], opened[cut:]
        if kind & _IS_VOID:
            continue
        parent = stack[-1]
        p = nodes[parent]
        cls = ""
        if attrs:
            cls = _CLASSES.get(attrs)
            if cls is None:
                cls = ".".join(x or y or z for x, y, z in _CLASS.findall(attrs))
                if len(_CLASSES) < 50_000:
                    _CLASSES[attrs] = cls
        nodes.append(Node(tag, cls, parent, p.depth + 1, p.kids))
        p.kids += 1
        stack.append(len(nodes) - 1)
        opened.append(tag)
    if last or rest:
        buf.append(last + rest)
    if buf:
        _add(blocks, buf, stack[-1], linked, inner)
    return nodes, blocks
