"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters of Markdown markup.
SYMBOLS = r"[#*`~>\[\]()!|-]"
LINK = r"\[([^\]]*)\]\(([^)]*)\)"


def count_of(c: Column, phrase: str) -> Column:
    """Occurrences of a phrase, not overlapping."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def strip_markdown(c: Column) -> Column:
    """Markup characters deleted, white space collapsed, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(c, SYMBOLS, ""), r"(?U)\s+", " "))


def size_text(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal, whole units lost at each step."""
    kb, mb, gb = F.floor(size / 1024), F.floor(F.floor(size / 1024) / 1024), F.floor(F.floor(F.floor(size / 1024) / 1024) / 1024)
    shown = F.when(size < 1024, F.concat(size.cast("string"), F.lit(".0B"))).when(kb < 1024, F.concat(kb.cast("string"), F.lit(".0KB"))).when(mb < 1024, F.concat(mb.cast("string"), F.lit(".0MB")))
    return shown.otherwise(F.concat(gb.cast("string"), F.lit(".0GB")))


def strip_frontmatter(c: Column) -> Column:
    """The body after a leading front matter; the text itself where there is none."""
    parts = F.split(c, "---", 3)
    return F.when(c.startswith("---") & (F.size(parts) >= 3), F.element_at(parts, 3)).otherwise(c)


def low_value(c: Column) -> Column:
    """Nothing worth cleaning: under 50 characters, under 5 filled lines, or links alone."""
    body = strip_frontmatter(F.coalesce(c, F.lit("")))
    chars = F.length(strip(body))
    lines = F.size(F.filter(F.split(body, "\n"), lambda x: strip(x) != ""))
    links = F.size(F.regexp_extract_all(body, F.lit(r"\[.*?\]\(.*?\)"), F.lit(0)))
    return (chars < 50) | (lines < 5) | ((links / F.greatest(F.lit(1.0), chars / 100.0) > 20) & (chars < 200))


def html_code_blocks(c: Column) -> Column:
    """Code blocks of a raw page: openings of pre, whatever their case."""
    return count_of(F.lower(c), "<pre")


def markdown_code_blocks(c: Column) -> Column:
    """Code blocks of a raw Markdown file: half of its fence lines."""
    return F.floor(F.size(F.regexp_extract_all(c, F.lit(r"(?md)^\s*(`{3,}|~{3,})[^`~]*$"), F.lit(0))) / 2).cast("long")
