"""Lines that one site repeats on many of its pages, found per site and taken out.

A line is a text block. Per site the lines form a weighted graph: a node weighs the number
of files that hold the line, an edge the number of files in which its two lines follow
one another. Nodes of high support are kept, the edges of high support between them link
them, and a connected component is one boilerplate block; a kept line without such an edge is a
block by itself. An occurrence of a block is a longest run of consecutive lines of a page that
belong to it; every occurrence is deleted as a whole. By the problem's definition each kept line is excessive,
so the lines of all blocks are the excessive ones.

Bounds: a site's kept nodes are at most (lines per file) / share, whatever the site's size,
since each kept line stands on that share of its files; so a site's graph fits in one task. Lines are
counted with partial aggregation, a large site is spread over all tasks while it is counted.
Null or empty html has no lines; a null site is a site of its own; a line that a file repeats counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, spread
from .htmlblocks import key64, text_blocks
from .meeting import meet

#: Fixed values of the problem.
MIN_FILES, MIN_SHARE = 5, 0.12


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [[key64(t) for t in text_blocks(h)] for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("site"), pa.array(keys, pa.list_(pa.int64()))], ["path", "site", "keys"])


def lines(pages: DataFrame, path: str = "raw_html_path", site: str = "site_name", html: str = "html") -> DataFrame:
    """(path, site, keys): the line keys of every file in order. A file given twice counts twice."""
    p = pages.select(F.col(path).alias("path"), F.coalesce(F.col(site), F.lit("")).alias("site"), F.col(html).alias("html"))
    return spread(p).mapInArrow(_lines, "path string, site string, keys array<long>")


def support(found: DataFrame, min_files: int = MIN_FILES, min_share: float = MIN_SHARE) -> DataFrame:
    """(site, key, files, total, least): nodes whose support reaches the site's least number of files."""
    sites = found.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    least = sites.select("site", "total", F.greatest(F.lit(float(min_files)), F.col("total") * F.lit(min_share) - F.lit(1e-9)).alias("least"))
    nodes = found.select("site", F.explode(F.array_distinct("keys")).alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("files"))
    return nodes.where(F.col("files") >= min_files).join(least, "site").where(F.col("files") >= F.col("least"))


def by_site(nodes: DataFrame) -> DataFrame:
    """(site, total, kept, least): a site's kept lines as one array, at most (lines per file) / share of them."""
    return nodes.groupBy("site").agg(F.first("total").alias("total"), F.collect_set("key").alias("kept"), F.first("least").alias("least"))


def _unsigned(k: int) -> int:
    return k & 0xFFFFFFFFFFFFFFFF


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for site, total, kept, edges in zip(*(b.column(c).to_pylist() for c in ("site", "total", "kept", "edges"))):
            root = {k: k for k in kept}  # of a block its smallest key, as unsigned numbers

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for e in edges or ():
                x, y = find(e["a"]), find(e["b"])
                if x != y:
                    root[max(x, y, key=_unsigned)] = min(x, y, key=_unsigned)
            out += [(site, total, k, find(k)) for k in kept]
        s, t, k, c = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(t, pa.int64()), pa.array(k, pa.int64()), pa.array(c, pa.int64())], ["site", "total", "key", "block"])


def boilerplate_blocks(found: DataFrame, min_files: int = MIN_FILES, min_share: float = MIN_SHARE, **limits: int) -> DataFrame:
    """(site, total, key, block): every kept line with the component it belongs to (its smallest key)."""
    nodes = checkpoint(support(found, min_files, min_share))
    per_site = by_site(nodes)
    runs = meet(found, per_site, "site", ["path", "keys"], 8 * nodes.count(), **limits).where("kept IS NOT NULL")
    n = F.greatest(F.size("keys") - 1, F.lit(0))
    next_to = F.zip_with(F.slice("keys", 1, n), F.slice("keys", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.array_distinct(F.filter(next_to, lambda p: F.array_contains("kept", p["a"]) & F.array_contains("kept", p["b"])))
    edges = runs.select("site", "least", F.explode(pairs).alias("e")).groupBy("site", "e").agg(F.count(F.lit(1)).alias("files"), F.first("least").alias("least"))
    edges = edges.where(F.col("files") >= F.col("least")).groupBy("site").agg(F.collect_list("e").alias("edges"))
    return per_site.join(edges, "site", "left").select("site", "total", "kept", "edges").mapInArrow(_components, "site string, total long, key long, block long")


def _kept(found: DataFrame, min_files: int, min_share: float, **limits: int) -> tuple[DataFrame, int]:
    """(site, total, kept, blocks) of the components' lines, line and block at the same place, and the bytes they hold together."""
    blocks = checkpoint(boilerplate_blocks(found, min_files, min_share, **limits))
    lists = blocks.groupBy("site").agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("key", "block"))).alias("b"))
    return lists.select("site", "total", F.col("b.key").alias("kept"), F.col("b.block").alias("blocks")), 16 * blocks.count()


def hex_key(c) -> object:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def excessive(pages: DataFrame, min_files: int = MIN_FILES, min_share: float = MIN_SHARE, **limits: int) -> DataFrame:
    """(raw_html_path, line_key): each file with each distinct line to be deleted from it."""
    found = checkpoint(lines(pages))  # 8 bytes a line; parsed once, read by all passes
    per_site, held = _kept(found, min_files, min_share, **limits)
    hit = meet(found, per_site, "site", ["path", "keys"], held, **limits).select("path", F.explode(F.array_intersect("keys", "kept")).alias("key"))
    return hit.select(F.col("path").alias("raw_html_path"), hex_key(F.col("key")).alias("line_key"))


def occurrences(keys: list[int], block_of: dict[int, int]) -> list[tuple[int, int]]:
    """(start, end) of every block's occurrences: longest runs of lines of one block."""
    out: list[tuple[int, int]] = []
    last = None
    for i, k in enumerate(keys):
        block = block_of.get(k)
        if block is not None:
            if block == last:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i, i + 1))
        last = block
    return out


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for b in batches:
        texts, removed = [], []
        for i, (page, site) in enumerate(zip(b.column("html").to_pylist(), b.column("site").to_pylist())):
            if site not in held:
                if len(held) > 512:
                    held.clear()
                held[site] = dict(zip(b.column("kept")[i].as_py() or (), b.column("blocks")[i].as_py() or ()))
            lines_ = text_blocks(page)
            left, pos = [], 0
            for start, end in occurrences([key64(t) for t in lines_], held[site]):
                left += lines_[pos:start]
                pos = end
            left += lines_[pos:]
            texts.append("\n".join(" ".join(t.split()) for t in left))
            removed.append(len(lines_) - len(left))
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["raw_html_path", "text", "lines_removed"])


def without_excessive(pages: DataFrame, min_files: int = MIN_FILES, min_share: float = MIN_SHARE, **limits: int) -> DataFrame:
    """(raw_html_path, text, lines_removed): every page's text without its site's repeated lines."""
    found = checkpoint(lines(pages))
    per_site, held = _kept(found, min_files, min_share, **limits)
    p = pages.select(F.col("raw_html_path").alias("path"), F.coalesce("site_name", F.lit("")).alias("site"), "html")
    met = meet(spread(p), per_site, "site", ["path", "html"], held, **limits)
    return met.select("path", "site", "html", "kept", "blocks").mapInArrow(_delete, "raw_html_path string, text string, lines_removed long")


def blocks(pages: DataFrame, min_files: int = MIN_FILES, min_share: float = MIN_SHARE, **limits: int) -> DataFrame:
    """(site_name, line_key, block_key, lines): every excessive line with its block, named by its smallest line, and the block's lines."""
    found = boilerplate_blocks(checkpoint(lines(pages)), min_files, min_share, **limits)
    sizes = found.groupBy("site", "block").agg(F.count(F.lit(1)).alias("lines"))
    return found.join(sizes, ["site", "block"]).select(F.col("site").alias("site_name"), hex_key(F.col("key")).alias("line_key"), hex_key(F.col("block")).alias("block_key"), "lines")
