"""A small element tree with the selectors that profiles use; pages are parsed once and changed in place.

Recovery rules: void elements have no end; script, style, textarea and title hold raw text;
p ends at the next block element; li, td, th, tr, dt, dd and option end at their next sibling;
an end tag without an open element is ignored; an inline element that is left open ends with
the block around it.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
_P_ENDERS = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "figcaption"}
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")


class Element:
    """An element; kids holds elements and strings (decoded text) in order.

    A root also knows which tags, classes, ids and attributes its page has at most, so that
    a selector that cannot match costs no walk.
    """

    __slots__ = ("tag", "attrs", "kids", "parent", "known")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Element | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.known: frozenset[tuple[str, str]] | None = None
        self.kids: list[Element | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def elements(self) -> list[Element]:
        return [k for k in self.kids if isinstance(k, Element)]

    def add(self, *kids: Element | str) -> Element:
        for k in kids:
            if isinstance(k, Element):
                k.parent = self
            self.kids.append(k)
        return self

    def walk(self) -> Iterator[Element]:
        """The element and all elements in it, in document order."""
        stack: list[Element] = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(k for k in reversed(e.kids) if isinstance(k, Element))

    def text(self) -> str:
        out: list[str] = []
        stack: list[Element | str] = [self]
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                out.append(k)
            else:
                stack.extend(reversed(k.kids))
        return "".join(out)

    def ancestors(self) -> Iterator[Element]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    def inside(self, *tags: str) -> bool:
        return any(a.tag in tags for a in self.ancestors())

    def outermost(self, tag: str) -> list[Element]:
        """The elements of a tag that stand in no other one of it, in document order."""
        out, stack = [], [k for k in reversed(self.kids) if isinstance(k, Element)]
        while stack:
            e = stack.pop()
            if e.tag == tag:
                out.append(e)
            else:
                stack.extend(k for k in reversed(e.kids) if isinstance(k, Element))
        return out

    def _place(self) -> int:
        return next(i for i, k in enumerate(self.parent.kids) if k is self)

    def drop(self) -> None:
        """Take the element out; the text after it stays."""
        if self.parent is not None:
            del self.parent.kids[self._place()]
            self.parent = None

    def swap(self, new: Element | str) -> None:
        """Put ``new`` in the element's place."""
        if self.parent is not None:
            parent, i = self.parent, self._place()
            parent.kids[i] = new
            if isinstance(new, Element):
                new.parent = parent
            self.parent = None

    def next_elements(self) -> Iterator[Element]:
        if self.parent is not None:
            yield from (k for k in self.parent.kids[self._place() + 1 :] if isinstance(k, Element))

    def select(self, selector: str) -> list[Element]:
        """Elements below (or at) this one that match, in document order."""
        groups = self._possible(selector)
        return [] if not groups else [e for e in self.walk() if any(_matches(e, g) for g in groups)]

    def _possible(self, selector: str) -> tuple[tuple[tuple, ...], ...]:
        groups = _compiled(selector)
        known = self.known
        if known is None:
            return groups
        return tuple(g for g in groups if all(t[0] in ("last", "first") or t[1] == "*" or t[:2] in known for t in g[-1]))

    def first(self, selector: str) -> Element | None:
        groups = self._possible(selector)
        return None if not groups else next((e for e in self.walk() if any(_matches(e, g) for g in groups)), None)

    def html(self) -> str:
        out: list[str] = []
        stack: list[Element | str] = [self]
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                out.append(k)  # an end tag or text made ready below
                continue
            if k.tag == "#root":
                stack.extend(_ready(x, k) for x in reversed(k.kids))
                continue
            out.append("<" + k.tag + "".join(f' {a}="{_html.escape(v)}"' for a, v in k.attrs.items()) + ">")
            if k.tag in VOID:
                continue
            stack.append(f"</{k.tag}>")
            stack.extend(_ready(x, k) for x in reversed(k.kids))
        return "".join(out)


def _ready(kid: Element | str, parent: Element) -> Element | str:
    if isinstance(kid, Element) or parent.tag in ("script", "style"):
        return kid
    return _html.escape(kid, quote=False)


# Elements that the cleaning steps make.
_MADE = (("tag", "p"), ("tag", "strong"), ("tag", "pre"), ("tag", "code"), ("tag", "span"), ("class", "code-block-line-group"))


def parse(page: str | None) -> Element:
    """The tree under a #root element; empty for null or empty input."""
    root = Element("#root")
    if not page:
        return root
    at = root
    known = set(_MADE)
    open_: Counter[str] = Counter()  # the elements around the place, by tag
    pos = 0
    n = len(page)
    tagged = page.rfind(">") + 1
    if page.count("<", tagged) <= 100:
        tagged = n  # otherwise what follows the last tag end is text, full of tags that never end
    while pos < n:
        m = _TOKEN.search(page, pos, tagged) if pos < tagged else None
        text = page[pos : m.start() if m else n]
        if text:
            at.kids.append(_html.unescape(text) if "&" in text else text)
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if open_[tag]:
                at = _up(at, _close(at, tag), open_)
            continue
        if tag in _P_ENDERS and open_["p"]:
            at = _up(at, _end(at, ("p",), ("td", "th", "table", "div", "li", "body", "button")), open_)
        if tag in _ENDS and any(open_[t] for t in _ENDS[tag][0]):
            at = _up(at, _end(at, *_ENDS[tag]), open_)
        raw = m[3]
        e = Element(tag, {a.lower(): _html.unescape(x or y or z) for a, x, y, z in reversed(_ATTR.findall(raw))} if raw and not raw.isspace() else None, at)
        known.add(("tag", tag))
        for a, v in e.attrs.items():
            known.add(("attr", a))
            if a == "class":
                known.update(("class", c) for c in v.split())
            elif a == "id":
                known.add(("id", v))
        at.kids.append(e)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            body = page[pos : end.start() if end else n]
            if body:
                e.kids.append(body if tag in ("script", "style") else _html.unescape(body))
            pos = end.end() if end else n
            continue
        if not raw.endswith("/") or tag in BLOCKS:
            at = e
            open_[tag] += 1
    root.known = frozenset(known)
    return root


def _up(at: Element, to: Element, open_: Counter[str]) -> Element:
    """From one element to one around it; those between are closed."""
    while at is not to:
        open_[at.tag] -= 1
        at = at.parent
    return to


def _close(at: Element, tag: str) -> Element:
    e: Element | None = at
    while e is not None and e.tag != "#root":
        if e.tag == tag:
            return e.parent
        if tag not in BLOCKS and e.tag in BLOCKS:
            return at  # an inline end tag never ends the block around it
        e = e.parent
    return at


def _end(at: Element, ends: tuple[str, ...], scope: tuple[str, ...]) -> Element:
    e: Element | None = at
    while e is not None and e.tag != "#root" and e.tag not in scope:
        if e.tag in ends:
            return e.parent
        e = e.parent
    return at


_PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:([*^$~|]?=)(?:\"([^\"]*)\"|'([^']*)'|([^\]]*)))?\]|:(last-child|first-child)|(\*|[a-zA-Z][\w-]*)")


@lru_cache(maxsize=512)
def _compiled(selector: str) -> tuple[tuple[tuple, ...], ...]:
    """Comma list of descendant chains; each link is a tuple of simple tests."""
    groups = []
    for group in re.split(r",(?![^\[]*\])", selector):
        chain = tuple(tuple(_simple(m) for m in _PART.finditer(link)) for link in re.split(r"\s+(?![^\[]*\])", group.strip()) if link)
        if chain:
            groups.append(chain)
    return tuple(groups)


def _simple(m: re.Match) -> tuple:
    if m[1]:
        return ("class" if m[1] == "." else "id", m[2])
    if m[3]:
        return ("attr", m[3].lower(), m[4] or "", m[5] or m[6] or m[7] or "")
    return ("last" if m[8] == "last-child" else "first", "") if m[8] else ("tag", m[9].lower())


def _test(e: Element, test: tuple) -> bool:
    kind = test[0]
    if kind == "tag":
        return test[1] == "*" or e.tag == test[1]
    if kind == "class":
        return test[1] in e.classes
    if kind == "id":
        return e.attrs.get("id") == test[1]
    if kind == "attr":
        have = e.attrs.get(test[1])
        if have is None:
            return False
        op, want = test[2], test[3]
        return {"": True, "=": have == want, "*=": want in have, "^=": have.startswith(want), "$=": have.endswith(want), "~=": want in have.split(), "|=": have == want or have.startswith(want + "-")}[op]
    if e.parent is None:
        return False
    own = e.parent.elements()
    return own[-1 if kind == "last" else 0] is e


def _matches(e: Element, chain: tuple[tuple, ...]) -> bool:
    if e.tag == "#root" or not all(_test(e, t) for t in chain[-1]):
        return False
    k = len(chain) - 2
    for a in e.ancestors():
        if k < 0:
            break
        if a.tag != "#root" and all(_test(a, t) for t in chain[k]):
            k -= 1
    return k < 0
