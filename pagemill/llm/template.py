"""Main bodies of pages, by equivalence classes of the tokens of each site's template.

Tokens of a page are its text blocks (the words of a constant block always come together, so
they are one token beforehand), halves of blocks (of a constant block with a slot in it one half stays
constant), and its containers, told apart by their path. A token's occurrence vector says on which
pages of the site it stands, and how often; it is carried as a commutative digest, which partial
aggregation can build. Tokens of one site with equal vectors form an equivalence class.

A class is valid if it is frequent (support: its share of the site's pages) and large enough
(size: words of its texts and containers together). Valid classes nest by the containers around
their tokens. What the tokens of the valid classes leave open are the slots; each belongs to the class
of its innermost container. The main slot is the deepest container that holds most free text of the pages
it stands on. A nested slot is optional chrome where its text is links, or where it always stands
before or after the free text of the main slot and isn't filled by the texts of valid classes; other nested slots (lists, tables, notes in the
text) are part of the main body. So a page's main body is its main slot less the tokens of
valid classes and less the optional slots.

Sites of fewer than POOLED pages show no repetition: their containers are judged by the classes of all
sites together. Where nothing but headings would be left on a page, template text of the main slot that stands on less
than NEARLY all pages is kept, as a site can repeat it in place of content; failing that its optional slots are opened.

Bounds: a site's template has at most (tokens per page) / share members however large the
site, so it fits in one row. Tokens are counted with partial aggregation; a page meets its
site's template without a shuffle where all templates are small together, else a large site is
split over salts, so that a site of a third of all pages is no one task's. Null or empty html has no
blocks, a null site is a site of its own; a file given twice counts twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, spread
from .htmlblocks import Block, Node, hash64, norm_key64, parse
from .meeting import meet

#: Share of a site's pages that a template token stands on, in flowing text, and in list items, cells and code.
SHARE, SHARE_ITEM, LEAST = 0.09, 0.12, 3
#: Words and containers that a valid class has at least.
LEAST_SIZE = 2
#: Share of pages from which a container belongs to the site's template, and at which a text stands on nearly all pages.
BOX_SHARE, NEARLY = 0.02, 0.9
#: Share of the free text around it that the main slot holds; of links in a slot of links; least share of the free text before and after a slot of the main body.
MAIN, LINKS, WITHIN = 0.5, 0.9, 0.08
#: Share of a container's occurrences that texts of valid classes fill, from which it is no slot.
WRAPS = 0.5
#: Sites with fewer pages use the classes of all sites.
POOLED = 5
#: Fixed value: the number of the pool among the sites.
POOL = -1

_SIZE = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+")
_ITEM, _CELL, _HEAD = frozenset(("li", "dt", "dd")), frozenset(("td", "th")), frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CONTAINERS = frozenset("#root body div main article section table tr td aside nav header footer ul ol form dl".split())
_ROLES = {**dict.fromkeys(_ITEM, "i"), **dict.fromkeys(_CELL, "c"), **dict.fromkeys(_HEAD, "h"), "pre": "p"}


def role(node: Node) -> str:
    """The kind of element that holds a block; p and div take each other's place."""
    return _ROLES.get(node.tag, "f")


def block_token(b: Block, r: str) -> int:
    return hash64(f"{r}{'@' if b.full_link else ''}|{b.masked if r == 'f' else b.norm}")


def open_tokens(b: Block, r: str) -> tuple[int, ...]:
    """The block with a slot in it, known by its constant half: the text before and after the middle blank; flowing text of three words or more only."""
    if r != "f" or b.full_link:
        return ()
    text = b.masked
    if text.count(" ") < 2:
        return ()
    half = text.find(" ", len(text) // 2)
    if half < 0:
        half = text.rfind(" ")
    return hash64("<" + text[:half]), hash64(">" + text[half:])


_PATHS: dict[tuple[int, str], int] = {}


def containers(nodes: list[Node]) -> list[int]:
    """For every element the token of its innermost container, itself included: a digest of the path of tags with class and id, cells with their position."""
    out = [0] * len(nodes)
    for i, n in enumerate(nodes):
        up = out[n.parent] if n.parent >= 0 else 0
        if n.tag in _CONTAINERS:
            label = f"{n.tag}.{n.cls}" if n.tag != "td" else f"td{n.index}"
            t = _PATHS.get((up, label))
            if t is None:
                t = hash64(f"{up}>{label}")
                if len(_PATHS) < 100_000:
                    _PATHS[up, label] = t
            out[i] = t
        else:
            out[i] = up
    return out


def _extents(nodes: list[Node], blocks: list[Block]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Per element its first block, the one after its last, its characters and those in links."""
    first, last = [len(blocks)] * len(nodes), [0] * len(nodes)
    chars, linked = [0] * len(nodes), [0] * len(nodes)
    for k, b in enumerate(blocks):
        i = b.node
        if first[i] > k:
            first[i] = k
        last[i] = k + 1
        chars[i] += b.chars
        linked[i] += min(b.chars, b.linked)
    for i in range(len(nodes) - 1, 0, -1):  # children stand after their parents
        up = nodes[i].parent
        if chars[i]:
            chars[up] += chars[i]
            linked[up] += linked[i]
            if first[i] < first[up]:
                first[up] = first[i]
            if last[i] > last[up]:
                last[up] = last[i]
    return first, last, chars, linked


def page_tokens(html: str | None) -> tuple[list[int], ...]:
    """Text tokens (how often, words, place of the container around them) and container tokens (how often, depth, place of the one around, and sums of characters)."""
    nodes, blocks = parse(html)
    where = containers(nodes)
    first, last, chars, linked = _extents(nodes, blocks)
    upto = [0]  # free characters before each block
    for b in blocks:
        upto.append(upto[-1] + max(0, b.chars - b.linked))
    all_free = upto[-1]
    begin, end, deepest = 0, len(blocks), 0
    box: dict[int, list[int]] = {}
    order: dict[int, int] = {}
    held = [i for i, n in enumerate(nodes) if n.tag in _CONTAINERS]
    for i in held:  # the deepest container with most free text of the page
        if nodes[i].depth > deepest and last[i] and 2 * (upto[last[i]] - upto[first[i]]) >= all_free > 0:
            begin, end, deepest = first[i], last[i], nodes[i].depth
    span = upto[end] - upto[begin]
    for i in held:
        t = where[i]
        x = box.get(t)
        if x is None:
            order[t] = len(box)
            n = nodes[i]
            x = box[t] = [0, n.depth, order[where[n.parent]] if n.parent >= 0 else 0, 0, 0, 0, 0, 0]
        x[0] += 1
        if chars[i]:
            a, z = first[i], last[i]
            x[3] += upto[z] - upto[a]
            x[4] += chars[i]
            x[5] += linked[i]
            x[6] += max(0, min(upto[a] - upto[begin], upto[end] - upto[z]))
            x[7] += span
    found: dict[int, list[int]] = {}
    for b in blocks:
        r = role(nodes[b.node])
        up = order[where[b.node]]
        words = b.norm.count(" ") + 1 if b.norm.isascii() else len(_SIZE.findall(b.norm)) or 1
        for t in (block_token(b, r), *open_tokens(b, r)):
            x = found.get(t)
            if x is None:
                found[t] = [1, words, up]
            else:
                x[0] += 1
    n, words, up = map(list, zip(*found.values())) if found else ([], [], [])
    return list(found), n, words, up, list(box), *map(list, zip(*box.values()))


_TOKENS = ("tokens", "counts", "words", "ups", "boxes", "times", "depths", "outer", "free", "chars", "linked", "within", "span")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [page_tokens(h) for h in b.column("html").to_pylist()]
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("site"), *(pa.array([r[i] for r in rows], longs) for i in range(len(_TOKENS)))], ["path", "site", *_TOKENS])


def _source(pages: DataFrame) -> DataFrame:
    return spread(pages.select(F.col("raw_html_path").alias("path"), F.coalesce("site_name", F.lit("")).alias("site"), "html"))


_SUMS = ("n", "size", "around", "chars", "linked", "within", "span")


def _entries(pages: DataFrame) -> DataFrame:
    """(s, f, token, n, size, up, depth, sums of characters): one row a page and token; depth -1 for texts, -2 for the page as such, which the pool has as well."""
    t = _source(pages).mapInArrow(_tokens, "path string, site string, " + ", ".join(f"{c} array<long>" for c in _TOKENS))
    zero = "CAST(0 AS BIGINT)"
    texts = f"transform(arrays_zip(tokens, counts, words, ups), x -> named_struct('token', x.tokens, 'n', x.counts, 'size', x.words, 'up', boxes[int(x.ups)], 'depth', -1L, 'around', {zero}, 'chars', {zero}, 'linked', {zero}, 'within', {zero}, 'span', {zero}))"
    held = "transform(arrays_zip(boxes, times, depths, outer, free, chars, linked, within, span), x -> named_struct('token', x.boxes, 'n', x.times, 'size', x.free, 'up', boxes[int(x.outer)], 'depth', x.depths, 'around', free[0], 'chars', x.chars, 'linked', x.linked, 'within', x.within, 'span', x.span))"
    page = f"array(named_struct('token', {zero}, 'n', 1L, 'size', {zero}, 'up', {zero}, 'depth', -2L, 'around', {zero}, 'chars', {zero}, 'linked', {zero}, 'within', {zero}, 'span', {zero}))"
    both = t.select(F.xxhash64("site").alias("s"), F.xxhash64("path").alias("f"), F.expr(texts).alias("texts"), F.expr(f"concat({held}, {page})").alias("held"))
    each = F.array(F.struct("s", F.concat("texts", "held").alias("e")), F.struct(F.lit(POOL).cast("long").alias("s"), F.col("held").alias("e")))
    return both.select("f", F.explode(each).alias("g")).select("f", "g.s", F.explode("g.e").alias("e")).select("s", "f", "e.*")


def template(pages: DataFrame, share: float = SHARE, least: int = LEAST, least_size: int = LEAST_SIZE) -> DataFrame:
    """(s, token, kind, files, class_id, class_size, total, depth, up, sums): the tokens of the valid equivalence classes.

    kind b: block or block with a slot; n: container. class_id is the digest of the occurrence
    vector; tokens of one class stand on the same pages equally often. Of containers size is the free text in them,
    around that of the pages they stand on, within the lesser of the free text before and after
    them in the page's main text, and span that main text; up is the container around the token.
    """
    counted = _entries(pages).groupBy("s", "token").agg(
        F.count(F.lit(1)).alias("files"), F.bit_xor(F.xxhash64("f", "n")).alias("class_id"), F.max("depth").alias("depth"), F.min("up").alias("up"), F.max("size").alias("words"), *(F.sum(c).alias(c) for c in _SUMS)
    )
    kept = checkpoint(counted.where((F.col("files") >= least) | (F.col("depth") == -2)))
    totals = kept.where("depth = -2").select("s", F.col("files").alias("total"))
    text = F.col("depth") == -1
    supported = kept.where("depth <> -2").join(totals, "s").where(F.col("files") >= F.greatest(F.lit(float(least)), F.col("total") * F.when(text, share).otherwise(min(share, BOX_SHARE))))
    size = F.sum(F.when(text, F.col("words")).otherwise(F.lit(1)))
    classes = supported.groupBy("s", "class_id").agg(size.alias("class_size"), F.max("files").alias("support"))
    # Containers nest by their paths: with a container the ones around it are kept too, whatever the size of their classes.
    valid = supported.join(classes, ["s", "class_id"]).where(((F.col("class_size") >= least_size) & (F.col("support") == F.col("files"))) | ~text)
    return valid.select("s", "token", F.when(text, "b").otherwise("n").alias("kind"), "files", "class_id", "class_size", "total", "depth", "up", *_SUMS)


#: What a page gets of its site's template.
_SITE = ("blocks", "often", "most", "main", "optional")


def by_site(valid: DataFrame, share: float = SHARE, share_item: float = SHARE_ITEM) -> DataFrame:
    """(s, total, blocks, often, most, main, optional): per site the template in one row.

    blocks: texts of the valid classes for flowing text; often: those frequent enough for items and cells; most: those on
    nearly all pages; main: containers that are the main slot of the pages they stand on; optional: nested slots that are chrome.
    """
    is_block, is_box = F.col("kind") == "b", F.col("kind") == "n"
    fills = F.col("size") >= F.greatest(F.col("around"), F.lit(1)) * MAIN
    is_main = is_box & fills & ((F.col("files") >= F.col("total") * share) | (F.col("s") == POOL))
    links = (F.col("linked") >= F.col("chars") * LINKS) & (F.col("chars") > 0)
    beside = F.col("within") < F.col("span") * WITHIN

    def held(condition: Column, name: str) -> Column:
        return F.collect_list(F.when(condition, F.col("token"))).alias(name)

    # Where most occurrences of a container hold a text of some class, it wraps template texts and is no slot.
    each = valid.where("kind = 'b'").groupBy("s", F.col("up").alias("token"), "class_id").agg(F.max("files").alias("files"))
    wraps = each.groupBy("s", "token").agg(F.sum("files").alias("wrapped"))
    v = valid.join(wraps, ["s", "token"], "left").withColumn("beside", beside & (F.coalesce("wrapped", F.lit(0)) < F.col("n") * WRAPS))
    return v.groupBy("s").agg(
        F.max("total").alias("total"),
        held(is_block, "blocks"),
        held(is_block & (F.col("files") >= F.col("total") * share_item), "often"),
        held(is_block & (F.col("files") >= F.col("total") * NEARLY), "most"),
        held(is_main, "main"),
        held(is_box & ~fills & (links | F.col("beside")), "optional"),
    )


def is_chrome(nodes: list[Node], blocks: list[Block], site: dict, rescue: bool = True) -> list[bool]:
    """For every block of a page, whether it belongs to the site's template rather than to the main slot.

    Where nothing but headings would be left, ``rescue`` keeps the texts in the main slot that are not on
    nearly all pages, and failing that what stands in its optional slots without being template text.
    """
    flow, often, main, optional = site["blocks"], site["often"], site["main"], site.get("optional", ())
    where = containers(nodes)
    best = -1
    for i, n in enumerate(nodes):
        if n.tag in _CONTAINERS and where[i] in main and (best < 0 or n.depth > nodes[best].depth):
            best = i
    inside = [best <= 0] * len(nodes)  # of the main slot
    closed = [False] * len(nodes)  # an optional slot
    for i, n in enumerate(nodes):
        if n.parent >= 0:
            inside[i] = inside[n.parent] or i == best
            closed[i] = closed[n.parent]
        if n.tag in _CONTAINERS and i != best and where[i] in optional:
            closed[i] = True
    roles = [role(nodes[b.node]) for b in blocks]

    def is_template(k: int, tokens: frozenset, items: frozenset) -> bool:
        b, r = blocks[k], roles[k]
        if r in "fh":
            return block_token(b, r) in tokens or any(t in tokens for t in open_tokens(b, r))
        return block_token(b, r) in items

    titles = [nodes[b.node].tag == "h1" and not b.full_link for b in blocks]  # a page's title can stand before its main slot
    out = [not titles[k] and (closed[b.node] or not inside[b.node]) or is_template(k, flow, often) for k, b in enumerate(blocks)]
    if rescue and all(c or r == "h" for c, r in zip(out, roles)):
        left = [k for k, b in enumerate(blocks) if out[k] and inside[b.node] and not b.full_link]
        most = site.get("most", ())
        again = [k for k in left if flow and not closed[blocks[k].node] and not is_template(k, most, most)]
        for k in again or [k for k in left if closed[blocks[k].node] and not is_template(k, flow, often)]:
            out[k] = False
    return out


def attach(pages: DataFrame, valid: DataFrame, **limits: int) -> DataFrame:
    """Every page with its site's template, or the pool's: (s, path, html) and _SITE."""
    rows = _source(pages).withColumn("s", F.xxhash64("site"))
    every = checkpoint(by_site(valid))  # a row a site
    own = every.where((F.col("s") != POOL) & (F.col("total") >= POOLED))
    pool = every.where(F.col("s") == POOL).first()  # containers only, at most (containers a page) / BOX_SHARE of them
    met = meet(rows, own, "s", ["path", "html"], 16 * valid.count(), **limits)
    alone = F.col("main").isNull()
    of_pool = {c: F.lit(list(pool[c])).cast("array<bigint>") if pool else F.lit(None).cast("array<bigint>") for c in _SITE}
    return met.select(F.when(alone, F.lit(POOL).cast("long")).otherwise(F.col("s")).alias("s"), "path", "html", *(F.when(alone, of_pool[c]).otherwise(F.col(c)).alias(c) for c in _SITE))


class Sites:
    """The templates of a batch's pages as sets, made once for every site met."""

    def __init__(self, batch: pa.RecordBatch, held: dict):
        self.batch, self.held = batch, held

    def __iter__(self) -> Iterator[dict]:
        ids = self.batch.column("s").to_pylist()
        for i, s in enumerate(ids):
            site = self.held.get(s)
            if site is None:
                site = {c: frozenset(self.batch.column(c)[i].as_py() or ()) for c in _SITE}
                if len(self.held) > 512:
                    self.held.clear()
                self.held[s] = site
            yield site


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for b in batches:
        out_path: list[str] = []
        out_text: list[list[str]] = []
        for path, html, site in zip(b.column("path").to_pylist(), b.column("html").to_pylist(), Sites(b, held)):
            nodes, blocks = parse(html)
            out_path.append(path)
            out_text.append([x.text for x, c in zip(blocks, is_chrome(nodes, blocks, site)) if not c])
        yield pa.RecordBatch.from_arrays([pa.array(out_path, pa.string()), pa.array(out_text, pa.list_(pa.string()))], ["raw_html_path", "blocks"])


def main_bodies(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(raw_html_path, blocks): the text blocks of every page's main body in order."""
    return attach(pages, template(pages, share)).mapInArrow(_bodies, "raw_html_path string, blocks array<string>")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for b in batches:
        paths: list[str] = []
        keys: list[int] = []
        for path, html, site in zip(b.column("path").to_pylist(), b.column("html").to_pylist(), Sites(b, held)):
            nodes, blocks = parse(html)
            own = dict.fromkeys(norm_key64(x.norm) for x, c in zip(blocks, is_chrome(nodes, blocks, site)) if not c)
            paths.extend([path] * len(own))
            keys.extend(own)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(keys, pa.int64())], ["raw_html_path", "key"])


def body_keys(pages: DataFrame) -> DataFrame:
    """(raw_html_path, block_key): distinct keys of every page's main-body blocks."""
    found = attach(pages, template(pages)).mapInArrow(_keys, "raw_html_path string, key long")
    return found.select("raw_html_path", F.lower(F.lpad(F.hex("key"), 16, "0")).alias("block_key"))


def template_classes(pages: DataFrame) -> DataFrame:
    """(site_id, class_id, parent_class, tokens, containers, size, files, total): the template of every site as a tree of valid equivalence classes.

    A class hangs under the class of the container around its tokens, of several the one on
    fewest pages; the classes of the outermost containers have no parent.
    """
    v = checkpoint(template(pages).where(F.col("s") != POOL))
    outer = v.where("kind = 'n'").select("s", F.col("token").alias("up"), F.col("class_id").alias("parent_class"), F.col("files").alias("parent_files"))
    under = v.join(outer, ["s", "up"], "left").where("parent_class <> class_id AND parent_files >= files")
    parents = under.groupBy("s", "class_id").agg(F.min(F.struct("parent_files", "parent_class")).alias("p")).select("s", "class_id", "p.parent_class")
    classes = v.groupBy("s", "class_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.sum(F.when(F.col("kind") == "n", 1).otherwise(0)).alias("containers"), F.max("class_size").alias("size"), F.max("files").alias("files"), F.max("total").alias("total")
    )
    return classes.join(parents, ["s", "class_id"], "left").select(F.col("s").alias("site_id"), "class_id", "parent_class", "tokens", "containers", "size", "files", "total")
