"""Element tree to Markdown: ATX headings, dash bullets, pipe tables; markup characters in text are escaped."""

from __future__ import annotations

import re

from .dom import Element

_SPACE = re.compile(r"[ \t\r\n\f]+")
_ESCAPED = re.compile(r"([*_])")
_BLOCK = frozenset("address article aside blockquote body center details dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table ul tbody thead tfoot tr td th #root".split())
_MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}


def to_markdown(tree: Element) -> str:
    """Markdown of a tree, blocks one empty line apart."""
    text = _blocks(tree)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _inline(e: Element | str, escape: bool = True) -> str:
    if isinstance(e, str):
        text = _SPACE.sub(" ", e)
        return _ESCAPED.sub(r"\\\1", text) if escape else text
    t = e.tag
    if t == "br":
        return "  \n"
    if t in ("code", "kbd", "samp", "tt"):
        text = _SPACE.sub(" ", e.text())
        if not text.strip():
            return ""
        mark = "`" * (max((len(m) for m in re.findall(r"`+", text)), default=0) + 1)
        pad = " " if text[0] == "`" or text[-1] == "`" else ""
        return f"{mark}{pad}{text.strip()}{pad}{mark}"
    if t == "img":
        return f"![{e.attrs.get('alt', '')}]({e.attrs.get('src', '')})"
    if t in ("script", "style", "noscript", "template", "head"):
        return ""
    inner = "".join(_inline(k, escape) for k in e.kids)
    if t in _MARKS:
        return _wrapped(inner, _MARKS[t], _MARKS[t])
    if t == "a":
        href = e.attrs.get("href")
        return _wrapped(inner, "[", f"]({href})") if href else inner
    return inner


def _wrapped(text: str, left: str, right: str) -> str:
    """Marks sit next to the text, blanks outside."""
    core = text.strip()
    if not core:
        return text
    i = text.index(core)
    return text[:i] + left + core + right + text[i + len(core) :]


def _tidy(text: str) -> str:
    return re.sub(r"[ \t]*\n[ \t]*", lambda m: "  \n" if m[0].startswith("  \n") else "\n", text).strip()


def _blocks(e: Element) -> str:
    """Children of a block element: runs of inline content and blocks, each on its own."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = _tidy(re.sub(r" {2,}(?!\n)", " ", "".join(run)))
        run.clear()
        if text:
            out.append(text)

    for k in e.kids:
        if isinstance(k, Element) and k.tag in _BLOCK:
            end()
            text = _block(k)
            if text:
                out.append(text)
        elif isinstance(k, Element) and any(x.tag in _BLOCK for x in k.walk()):
            end()
            text = _blocks(k)
            if text:
                out.append(text)
        else:
            run.append(_inline(k))
    end()
    return "\n\n".join(out)


def _block(e: Element) -> str:
    t = e.tag
    if t in ("h1", "h2", "h3", "h4", "h5", "h6"):
        text = _SPACE.sub(" ", "".join(_inline(k) for k in e.kids)).strip()
        return f"{'#' * int(t[1])} {text}" if text else ""
    if t == "hr":
        return "---"
    if t == "pre":
        return f"```\n{e.text().strip(chr(10))}\n```"
    if t == "blockquote":
        return "\n".join(f"> {x}".rstrip() for x in _blocks(e).split("\n"))
    if t in ("ul", "ol"):
        return _list(e)
    if t == "table":
        return _table(e)
    if t == "dl":
        return "\n".join(f"{_blocks(k)}" if k.tag == "dt" else f":   {_blocks(k)}" for k in e.elements())
    if t == "head":
        return ""
    return _blocks(e)


def _list(e: Element) -> str:
    out = []
    number = int(e.attrs["start"]) if e.attrs.get("start", "").isdigit() else 1
    for item in e.elements():
        text = _blocks(item) if item.tag == "li" else _block(item)
        if not text:
            continue
        mark = f"{number}. " if e.tag == "ol" else "- "
        number += 1
        text = re.sub(r"\n\n(?=\s*(?:- |\d+\. ))", "\n", text)
        out.append(mark + text.replace("\n", "\n" + " " * len(mark)))
    return "\n".join(re.sub(r"^[ \t]+$", "", x, flags=re.M) for x in out)


def _cell(e: Element) -> str:
    return " ".join(_blocks(e).split())


def _table(e: Element) -> str:
    rows = [[_cell(c) for c in row.elements() if c.tag in ("td", "th")] for row in e.select("tr") if not row.inside("td", "th") or next(a for a in row.ancestors() if a.tag == "table") is e]
    rows = [r for r in rows if r]
    if not rows:
        return _blocks_of_text(e)
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
    return "\n".join(lines)


def _blocks_of_text(e: Element) -> str:
    return _SPACE.sub(" ", e.text()).strip()
