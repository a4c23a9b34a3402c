"""Markdown steps: held code put back, heuristic overrides, and the path of native Markdown.

All of them work on lines. One scanner tells which lines are code (fence marks included); what
holds outside code is a function on a run of prose lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import groupby

from ..model import Profile

Lines = list[str]

# Held code.

_HELD = re.compile(r"[ \t]*HELDCODE(\d+)KEPT[ \t]*")


def restore(text: str, store: list[str]) -> str:
    """Held blocks at column 0 with an empty line before and after; runs of empty lines outside code shrink to one."""
    if store:
        text = _HELD.sub(r"\n\nHELDCODE\1KEPT\n\n", text)
    text = re.sub(r"\n{3,}", "\n\n", text)
    if store:
        text = _HELD.sub(lambda m: store[int(m[1])] if int(m[1]) < len(store) else m[0], text)
    return text.strip("\n")


# The line scanner.


def code_lines(lines: Iterable[str]) -> list[bool]:
    """For every line whether it is a fence mark or stands between two of them."""
    out, inside = [], False
    for line in lines:
        mark = line.lstrip().startswith(("```", "~~~"))
        out.append(inside or mark)
        inside ^= mark
    return out


def in_prose(lines: Lines, change: Callable[[Lines], Lines]) -> Lines:
    """The lines with ``change`` applied to every run outside code."""
    out: Lines = []
    for code, run in groupby(zip(code_lines(lines), lines), key=lambda x: x[0]):
        part = [line for _, line in run]
        out += part if code else change(part)
    return out


def heading(line: str) -> tuple[int, str] | None:
    """Level and title of a heading line."""
    title = line.lstrip("#")
    level = len(line) - len(title)
    return (level, title.strip()) if 1 <= level <= 6 and title[:1].isspace() else None


def until_heading(lines: Lines, i: int, deepest: int) -> int:
    """The next line from i on that is a heading of at most that level, or the end."""
    while i < len(lines) and not ((h := heading(lines[i])) and h[0] <= deepest):
        i += 1
    return i


# Overrides, each on a run of prose lines.

#: Kinds of notes, and the ranges of characters that count as pictures.
NOTES = ("Note", "Caution", "Warning", "Important", "Tip")
PICTURES = ((0x1F300, 0x1F9FF), (0x1FA00, 0x1FAFF), (0x2600, 0x27BF), (0xFE0F, 0xFE0F), (0x2139, 0x2139))

_PICTURE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in PICTURES) + "]")
_IMAGE = re.compile(r"!\[[^\]]*\]\((?P<target>[^)]*)\)")


def _copy_image(lines: Lines) -> Lines:
    return _IMAGE.sub(lambda m: "" if "copycode" in m["target"].lower() else m[0], "\n".join(lines)).split("\n")


def _after_choice(lines: Lines, i: int) -> int | None:
    """The line after the answers Yes and No, each with at most one empty line before it."""
    for answer in ("Yes", "No"):
        i += lines[i : i + 1] == [""]
        if lines[i : i + 1] != [answer]:
            return None
        i += 1
    return i if i < len(lines) else None


def _feedback(lines: Lines) -> Lines:
    out, i = [], 0
    while i < len(lines):
        after = _after_choice(lines, i + 1) if lines[i].endswith("## Feedback") else None
        if after is None:
            out.append(lines[i])
            i += 1
        else:
            out.append(lines[i].removesuffix("## Feedback"))
            i = until_heading(lines, after, 6)
    return out


def _notes(lines: Lines) -> Lines:
    """A small heading that begins with a kind of note is a quoted label; the sign or line break after it goes."""
    out: Lines = []
    joins = False
    for i, line in enumerate(lines):
        h = heading(line)
        kind = next((k for k in NOTES if h[1].lower().startswith(k.lower())), None) if h and h[0] >= 4 else None
        rest = line
        goes_on = False
        if kind:
            rest = line.lstrip("#").lstrip()[len(kind) :]
            goes_on = not rest and i + 1 < len(lines)
            rest = f"> **{kind}:**" + (rest[1:] if rest[:1] == ":" or rest[:1].isspace() else rest)
        if joins:
            out[-1] += rest
        else:
            out.append(rest)
        joins = goes_on
    return out


def _feature_state(lines: Lines) -> Lines:
    out: Lines = []
    for line in lines:
        if out and out[-1] == "FEATURE STATE:" and line:
            out[-1] = f"> **FEATURE STATE:** {line}"
        else:
            out.append(line)
    return out


def _emoji(lines: Lines) -> Lines:
    return [_PICTURE.sub("", line) for line in lines]


def _anchors(lines: Lines) -> Lines:
    """Links of a single # to a place on the page."""
    out = []
    for line in lines:
        first, *more = line.split("[#](#")
        kept = [first]
        for part in more:
            _, closed, after = part.partition(")")
            kept.append(after if closed else "[#](#" + part)
        out.append("".join(kept))
    return out


def _contents(begins: Callable[[str], bool], deepest: int) -> Callable[[Lines], Lines]:
    """Without the blocks that begin so, down to the next heading; an empty line stays in their place."""

    def change(lines: Lines) -> Lines:
        out, i = [], 0
        while i < len(lines):
            if begins(lines[i]) and i + 1 < len(lines):
                out.append("")
                i = until_heading(lines, i + 1, deepest)
            else:
                out.append(lines[i])
                i += 1
        return out

    return change


def _contents_heading(line: str) -> bool:
    h = heading(line)
    return h is not None and h[0] <= 4 and h[1].lower() == "on this page"


#: The overrides by name, in order.
OVERRIDES: dict[str, Callable[[Lines], Lines]] = {
    "copy_image": _copy_image,
    "feedback": _feedback,
    "notes": _notes,
    "feature_state": _feature_state,
    "emoji": _emoji,
    "anchors": _anchors,
    "toc_heading": _contents(_contents_heading, 4),
    "toc_plain": _contents(lambda line: line.rstrip().lower() == "on this page", 6),
}


def overrides(text: str, only: str | None = None) -> str:
    """All overrides (or the named one) outside fenced code."""

    def change(run: Lines) -> Lines:
        for name, f in OVERRIDES.items():
            if only in (None, name):
                run = f(run)
        return run

    return "\n".join(in_prose(text.split("\n"), change)).strip()


def unescape_fences(text: str) -> str:
    """Escaped underscores inside backtick fences lose their backslash."""
    parts = re.split(r"^(?=```)", text, flags=re.M)  # every part but the first begins with a fence mark
    return "".join(p.replace("\\_", "_") if k % 2 else p for k, p in enumerate(parts))


# Native Markdown.

#: Layout tags of native Markdown sources.
LAYOUT_TAGS = (
    "columns", "column", "step", "steps", "stepper", "hint", "expand", "frame", "tabs", "tab",
    "note", "code", "content-ref", "embed", "updates", "update",
)

_TABLE_START, _TABLE_END = re.compile(r"<table(?![\w-])([^>]*)>", re.I), re.compile(r"</table>", re.I)
_CARDS_VIEW = re.compile(r"data-view=(?:\"cards\"|'cards')", re.I)
_TARGET = re.compile(r"\]\(([^)\s]+)\)")


def card_tables(text: str) -> str:
    """Without the tables that are shown as cards."""
    out, pos, at = [], 0, 0
    while (start := _TABLE_START.search(text, at)) is not None:
        at = start.end()
        end = _TABLE_END.search(text, at) if _CARDS_VIEW.search(start[1]) else None
        if end:
            out.append(text[pos : start.start()])
            pos = at = end.end()
    return "".join(out) + text[pos:]


def strip_sections(lines: Lines, titles: tuple[str, ...]) -> Lines:
    """Sections under the given headings, down to the next heading of the same or a higher level."""
    open_: list[tuple[int, bool]] = []  # the sections around a line: level, and whether it goes
    out = []
    for line in lines:
        h = heading(line)
        if h and h[1]:
            while open_ and open_[-1][0] >= h[0]:
                open_.pop()
            open_.append((h[0], h[1] in titles or bool(open_) and open_[-1][1]))
        if not (open_ and open_[-1][1]):
            out.append(line)
    return out


def layout_tag(line: str) -> tuple[str, bool, bool] | None:
    """Name of the layout tag that a line begins with, whether it is an end tag, and whether the line holds nothing else."""
    body = line.strip()
    if not body.startswith("{%"):
        return None
    inner = body[2:].lstrip()
    ends = inner.startswith("/")
    inner = inner.lstrip("/").lstrip()
    name = re.match(r"[\w-]*", inner)[0]
    if name not in LAYOUT_TAGS:
        name = name.partition("-")[0]
    if name not in LAYOUT_TAGS and name.startswith("end"):
        name, ends = name[3:], True
    if name not in LAYOUT_TAGS:
        return None
    alone = re.sub(r"%\s*\}$", "%}", inner).find("%}") == len(re.sub(r"%\s*\}$", "%}", inner)) - 2
    return name, ends, alone


def layout_tags(lines: Lines) -> Lines:
    """Lines that are only a layout tag go; the body of a code tag is fenced unless it is already."""
    out: Lines = []
    i = 0
    while i < len(lines):
        tag = layout_tag(lines[i])
        i += 1
        if tag is None or not tag[2]:
            out.append(lines[i - 1])
        elif tag[:2] == ("code", False):
            begin = i
            while i < len(lines) and (layout_tag(lines[i]) or ("", False))[:2] != ("code", True):
                i += 1
            body = lines[begin:i]
            i += 1
            if any(x.strip() for x in body):
                out += body if body[0].lstrip().startswith("```") else ["```", *body, "```"]
    return out


def _page_address(target: str) -> str:
    if target.endswith(".md"):
        return target.removesuffix(".md")
    path, mark, place = target.partition("#")
    return path.removesuffix(".md") + mark + place


def md_links(line: str) -> str:
    """Links to Markdown files lead to the pages."""
    return _TARGET.sub(lambda m: f"]({_page_address(m[1])})", line)


def boilerplate_line(line: str, phrases: tuple[str, ...]) -> bool:
    """A quoted or short line with one of the phrases."""
    s = line.strip()
    return bool(s) and (s.startswith(">") or len(s) < 100) and any(p and p in s for p in phrases)


def blank_runs(lines: Lines) -> Lines:
    """At most two empty lines in a row."""
    return [line for full, run in groupby(lines, key=bool) for k, line in enumerate(run) if full or k < 2]


def _literal(line: str) -> str:
    """Written-out line breaks break the line; an escaped underscore is one, unless its backslash is escaped."""
    first, *more = line.replace("\\n", "\n").split("\\_")
    out = first
    for part in more:
        out += ("\\_" if out.endswith("\\") else "_") + part
    return out


def literal_escapes(lines: Lines) -> Lines:
    return in_prose(lines, lambda run: [_literal(x) for x in run])


def normalize(text: str | None, profile: Profile) -> str:
    """Native Markdown put in order, without the HTML chain."""
    lines = layout_tags(strip_sections(card_tables(text or "").splitlines(), profile.markdown_strip_headings))
    lines = [x.rstrip() for x in map(md_links, lines) if not boilerplate_line(x, profile.boilerplate_phrases)]
    return "\n".join(literal_escapes(blank_runs(lines))).strip() + "\n"
