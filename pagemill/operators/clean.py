"""The cleaning chain: one tree per attempt, changed by the HTML steps, converted once, then Markdown steps.

Code is taken out of the tree before the conversion and put back after it; the store belongs
to one document, so pages can be cleaned in any order and in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from ..model import Profile
from . import markdown
from .convert import to_markdown
from .dom import Element, parse

#: What holds line numbers, and what keeps code inline.
GUTTERS = (".code-block-line-gutter", "td.gutter", ".linenos", ".line-number", ".code-line-row-number")
PHRASING = (
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "a", "span", "strong", "em", "b", "i", "u",
    "small", "sub", "sup", "label", "button", "figcaption", "dt", "dd",
)
SHELLS = ("bash", "sh", "shell", "zsh")
DROPPED = "script, style, noscript, iframe, svg, button, title"

_PROMPT = re.compile(r"^[$%]\s*", re.M)
_FENCED_TEXT = re.compile(r"```([^\s`]*)[^\S\n]*\n(.*?)```", re.S)


@dataclass
class Work:
    """A document on its way through the chain."""

    raw: str
    profile: Profile
    extractor: Callable[[str], str | None] | None = None
    tree: Element = field(default_factory=lambda: Element("#root"))
    text: str = ""
    store: list[str] = field(default_factory=list)

    def hold(self, block: str) -> str:
        """Keep a fenced block aside; letters and digits only, so that no step changes the mark."""
        self.store.append(block)
        return f"HELDCODE{len(self.store) - 1}KEPT"


def _own_tree(e: Element, of: Element) -> Element:
    root = Element("#root")
    root.known = of.known
    e.drop()
    return root.add(e)


def main_content(w: Work) -> None:
    """The first selector with a match gives its first element; else the extractor; else the page."""
    for selector in w.profile.main_selector.split(","):
        hit = w.tree.first(selector.strip()) if selector.strip() else None
        if hit is not None:
            w.tree = _own_tree(hit, w.tree)
            return
    found = w.extractor(w.raw) if w.extractor else densest_region(w.raw)
    if found:
        w.tree = parse(found)


def densest_region(page: str) -> str | None:
    """The element with most text outside links, if it holds text worth speaking of: shallow text features."""
    tree = parse(page)
    for e in tree.select("script, style, noscript, nav, header, footer, aside, form, svg"):
        e.drop()
    best, most = None, 0.0
    for e in tree.walk():
        if e.tag in ("div", "section", "article", "main", "td", "body"):
            own = sum(len(k.text()) - sum(len(a.text()) for a in k.select("a")) for k in e.elements() if k.tag in ("p", "pre", "ul", "ol", "table", "h1", "h2", "h3", "h4", "blockquote"))
            if own > most:
                best, most = e, own
    return best.html() if best is not None and most >= 25 else None


def nav_remnants(w: Work) -> None:
    for selector in w.profile.remove_selectors:
        for e in w.tree.select(selector):
            e.drop()


def boilerplate(w: Work) -> None:
    """Phrases go wherever they stand in the serialized page, attributes included, one after the other."""
    phrases = [p for p in w.profile.boilerplate_phrases if p]
    if not phrases:
        return
    for e in w.tree.walk():
        for i, k in enumerate(e.kids):
            if isinstance(k, str):
                for p in phrases:
                    k = k.replace(p, "")
                e.kids[i] = k
        for a, v in e.attrs.items():
            for p in phrases:
                v = v.replace(p, "")
            e.attrs[a] = v


def scripts(w: Work) -> None:
    for e in w.tree.select(DROPPED):
        e.drop()


def tab_content(w: Work) -> None:
    """Each panel opens with the label of its tab; the bar of tabs goes."""
    for bar in w.tree.select(".nav-tabs"):
        labels = [t for t in (b.text().strip() for b in bar.select("[role='tab'], button, .nav-link")) if t]
        panels = next((s for s in bar.next_elements() if s.tag == "div" and "tab-content" in s.classes), None)
        if not labels or panels is None:
            continue
        for label, panel in zip(labels, panels.select("[role='tabpanel'], .tab-pane")):
            mark = Element("p").add(Element("strong").add(f"{label}:"))
            mark.parent = panel
            panel.kids.insert(0, mark)
        bar.drop()


def _language(chain: Iterable[Element]) -> str:
    for e in chain:
        for c in e.classes:
            if c.startswith("language-"):
                return c[len("language-") :]
    return ""


def line_numbers(w: Work) -> None:
    """Gutters go; a table that shows numbered code becomes a code block; empty code blocks go."""
    for selector in GUTTERS:
        for e in w.tree.select(selector):
            e.drop()
    for table in w.tree.select("table"):
        if "code-block-line-group" not in table.classes and table.first(".code-block-line-content") is None:
            continue
        lines = [last.text().rstrip("\n") for row in table.select("tr") if (last := row.first("td:last-child")) is not None]
        if not lines:
            continue
        lang = _language(table.ancestors())
        code = Element("code", {"class": f"language-{lang}"} if lang else None).add("\n".join(lines))
        block = Element("pre", {"class": f"code-block-line-group language-{lang}" if lang else "code-block-line-group"}).add(code)
        place = table.parent
        wrapped = place is not None and place.tag == "div" and "fern-scroll-area" in place.classes
        (place if wrapped else table).swap(block)
    for e in w.tree.select("pre"):
        if not e.elements() and not e.text().strip():
            e.drop()


def remove_code_lang_labels(w: Work) -> None:
    for e in w.tree.select(".code-language-label"):
        e.drop()


def flatten_block_in_cells(w: Work) -> None:
    """A code block in a table cell becomes one line of inline code."""
    for e in w.tree.select("pre"):
        if e.inside("td", "th"):
            e.swap(Element("code").add(" ".join(e.text().split())))


def escape_cell_pipes_html(w: Work) -> None:
    """A bar in a cell's text is escaped, except in code; once, however cells are nested."""
    seen: set[int] = set()
    for cell in w.tree.select("td, th"):
        for e in cell.walk():
            if id(e) not in seen:
                seen.add(id(e))
                if e.tag not in ("code", "pre"):
                    e.kids = [k.replace("|", "\\|") if isinstance(k, str) else k for k in e.kids]


def code_text(code: Element) -> str:
    """Text of a code element: its children are lines if they hold all of its text, otherwise br ends a line."""
    parts = [k.text().rstrip("\r\n") for k in code.elements() if k.tag != "br"]
    if parts and "".join(parts).replace("\n", "") == code.text().replace("\n", ""):
        return "\n".join(parts)
    for e in code.select("br"):
        e.swap("\n")
    return code.text()


def block_code(pre: Element) -> str:
    table = pre.first("table")
    if table is not None:
        cells = (row.first(".code-block-line-content, td:last-child") for row in table.select("tr"))
        return "\n".join(c.text().rstrip("\n") for c in cells if c is not None)
    code = pre.first("code")
    return code_text(code) if code is not None else pre.text()


def fenced(lang: str, code: str) -> str:
    mark = "~~~" if "```" in code else "```"
    return f"{mark}{lang}\n{code}\n{mark}"


def protect_code(w: Work) -> None:
    """Code blocks, several lines of code outside phrasing elements and cells, and fences in text are held aside."""
    for pre in w.tree.outermost("pre"):
        first = pre.first("code")
        lang = _language([pre, *([first] if first is not None else []), *([pre.parent] if pre.parent is not None else [])])
        code = block_code(pre)
        if lang in SHELLS:
            code = _PROMPT.sub("", code)
        pre.swap(Element("span").add(w.hold(fenced(lang, code.strip()))))
    for code in w.tree.select("code"):
        if code.parent is None or code.parent.tag in PHRASING or code.inside("td", "th", "pre"):
            continue
        text = code.text()
        if "\n" in text:
            code.swap(Element("span").add(w.hold(fenced("", text.strip()))))
    for e in w.tree.walk():
        for i, k in enumerate(e.kids):
            if isinstance(k, str) and "```" in k:
                e.kids[i] = _FENCED_TEXT.sub(lambda m: w.hold(fenced(m[1], m[2])), k)


def flatten_nested_tables(w: Work) -> None:
    """A table in a cell becomes its rows joined by semicolons."""
    for table in w.tree.select("table"):
        if table.parent is None or not table.inside("td", "th"):
            continue
        rows = (" ".join(t for t in (c.text().strip() for c in row.select("td, th")) if t) for row in table.select("tr"))
        table.swap(Element("span").add("; ".join(r for r in rows if r)))


def html_to_md(w: Work) -> None:
    w.text = to_markdown(w.tree)


def restore_code(w: Work) -> None:
    w.text = markdown.restore(w.text, w.store)


def localize_assets(w: Work) -> None:
    """Assets stay where they are; the step keeps its place in the record of steps."""


def overrides(w: Work) -> None:
    w.text = markdown.overrides(w.text)


def unescape_code_underscores(w: Work) -> None:
    w.text = markdown.unescape_fences(w.text)


#: The steps by name, in order.
STEPS: dict[str, Callable[[Work], None]] = {
    f.__name__: f
    for f in (
        main_content, nav_remnants, boilerplate, scripts, tab_content, line_numbers, remove_code_lang_labels, flatten_block_in_cells,
        escape_cell_pipes_html, protect_code, flatten_nested_tables, html_to_md, restore_code, localize_assets, overrides, unescape_code_underscores,
    )
}


def run_chain(page: str | None, profile: Profile, skip: Iterable[str] = (), extractor: Callable[[str], str | None] | None = None, tree: Element | None = None) -> tuple[str, list[str]]:
    """Cleaned Markdown and the names of the steps that ran. Unknown names in ``skip`` change nothing.

    ``tree`` is the page's tree where the caller has parsed it already; it is used up.
    """
    left_out = set(skip)
    w = Work(page or "", profile, extractor, tree if tree is not None else parse(page))
    done = []
    for name, step in STEPS.items():
        if name not in left_out:
            step(w)
            done.append(name)
    return w.text if "html_to_md" in done else w.text or w.tree.html(), done
