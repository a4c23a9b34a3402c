"""Navigation trees as adjacency tables: one row per node, filtered and flattened natively.

Trees are walked by a recursive query; a node carries its preorder key, the ids above it and
whether it or a node above it is excluded or matches. Nodes whose parent is missing belong to
no tree. Null titles match nothing, a null priority counts as secondary, null or empty urls
are sections without a page.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..model import NAV_CAP, NAV_LINKS, NAV_SELECTORS
from ..session import checkpoint, spread
from .dom import Element, parse
from .quality import parse_reply

_STRIP = re.compile(urls.NAV_ATTRIBUTES)


def nav_html(page: str | None) -> str | None:
    """Outer HTML of the first navigation container by priority, attributes stripped, capped; else the first nav with enough links."""
    tree = parse(page)
    found: Element | None = None
    for selector in NAV_SELECTORS:
        found = tree.first(selector)
        if found is not None:
            break
    if found is None:
        found = next((n for n in tree.select("nav") if len(n.select("a")) >= NAV_LINKS), None)
    if found is None:
        return None
    out = "\n".join(_STRIP.sub("", line) for line in found.html().split("\n"))
    return out if len(out) <= NAV_CAP else out[:NAV_CAP] + "\n<!-- truncated -->"


def extract_nav(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, nav_html): null where a page has no navigation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([nav_html(h) for h in b.column("html").to_pylist()], pa.string())], ["key", "nav_html"])

    out = spread(pages.select(F.col(key).alias("key"), F.col(html).alias("html"))).mapInArrow(run, f"key {dict(pages.dtypes)[key]}, nav_html string")
    return out.withColumnRenamed("key", key)


def analyze(nav: str | None, ask: Callable[[str], str] | None) -> dict | None:
    """The navigation tree a model reads out of nav HTML; null without a model, on an error or a malformed reply."""
    if not nav or ask is None:
        return None
    try:
        return parse_tree(ask(nav))
    except Exception:
        return None


def parse_tree(reply: str | None) -> dict | None:
    """A reply with a list of sections, whatever stands around it."""
    return parse_reply((reply or "").strip(), "sections", list)


def to_nodes(tree: dict | None, site: str) -> list[tuple]:
    """Adjacency rows (site_name, node_id, parent_id, pos, title, url, priority) of a parsed tree."""
    rows: list[tuple] = []
    stack = [(s, None, i) for i, s in reversed(list(enumerate((tree or {}).get("sections") or [])))]
    while stack:
        node, parent, pos = stack.pop()
        if not isinstance(node, dict):
            continue
        me = len(rows) + 1
        rows.append((site, me, parent, pos, node.get("title"), node.get("url"), node.get("priority")))
        stack += [(c, me, i) for i, c in reversed(list(enumerate(node.get("children") or [])))]
    return rows


#: Adjacency rows of trees.
NODES = "site_name string, node_id int, parent_id int, pos int, title string, url string, priority string"


def read_trees(pages: DataFrame, ask: Callable[[str], str] | None) -> DataFrame:
    """NODES of the trees that a model reads out of the sites' pages, asked from within the tasks.

    pages: (site_name, url, html). Of several pages of a site the one with the smallest address that has content is
    read; a site without a page, a navigation region or a right reply has no nodes.
    """
    names = [c.split()[0] for c in NODES.split(", ")]

    def word(x: object) -> str | None:
        return x if x is None or isinstance(x, str) else str(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for site, html in zip(b.column("site_name").to_pylist(), b.column("html").to_pylist()) for r in to_nodes(analyze(nav_html(html), ask), site)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([word(x) for x in c] if k == pa.string() else c, k) for c, k in zip(columns, kinds)], names)

    first = pages.where(F.col("html").isNotNull()).groupBy("site_name").agg(F.min_by("html", "url").alias("html"))
    return spread(first).mapInArrow(run, NODES)


def walk(nodes: DataFrame) -> DataFrame:
    """Every node of every tree with ``key`` (preorder), ``above`` (ids from the root to itself) and ``titles`` (likewise, lower case)."""
    view = f"nav_{uuid.uuid4().hex}"
    nodes.select("site_name", "node_id", "parent_id", "pos", "title", "url", "priority").createOrReplaceTempView(view)
    place = "concat(lpad(cast(coalesce({t}pos, 0) as string), 8, '0'), lpad(cast({t}node_id as string), 12, '0'))"
    out = nodes.sparkSession.sql(f"""
        WITH RECURSIVE t AS (
          SELECT site_name, node_id, title, url, priority, {place.format(t='')} AS key, array(node_id) AS above, array(lower(coalesce(title, ''))) AS titles
          FROM {view} WHERE parent_id IS NULL
          UNION ALL
          SELECT c.site_name, c.node_id, c.title, c.url, c.priority, concat(t.key, '/', {place.format(t='c.')}), concat(t.above, array(c.node_id)), concat(t.titles, array(lower(coalesce(c.title, ''))))
          FROM {view} c JOIN t ON c.parent_id = t.node_id AND c.site_name = t.site_name
        ) SELECT * FROM t""")
    return out


def excluded(walked: DataFrame, words: list[str]) -> DataFrame:
    """Nodes left when every branch whose title contains one of the words is cut."""
    words = [w.strip().lower() for w in words if w.strip()]
    if not words:
        return walked
    return walked.where(~F.exists("titles", lambda t: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))))


def prompted(walked: DataFrame, prompt: str) -> DataFrame:
    """Nodes that match, with all below them and the line above them."""
    word = prompt.strip().lower()
    if not word:
        return walked
    under = walked.where(F.exists("titles", lambda t: F.contains(t, F.lit(word))))
    line = under.where(F.contains(F.element_at("titles", -1), F.lit(word))).select("site_name", F.explode("above").alias("node_id")).distinct()
    keep = under.select("site_name", "node_id").unionByName(line).distinct()
    return walked.join(keep, ["site_name", "node_id"], "left_semi")


def chosen(nodes: DataFrame, prompt: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Cut, then filter; a site where the prompt matches nothing falls back to its whole tree, cut branches included."""
    full = walk(nodes)
    cut = excluded(full, exclude or [])
    if not prompt or not prompt.strip():
        return cut
    kept = prompted(cut, prompt)
    return kept.unionByName(full.join(kept.select("site_name").distinct(), "site_name", "left_anti").select(*kept.columns))


def flatten(nodes: DataFrame, sites: DataFrame, prompt: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(site_name, priority, url, rank): core pages first, then secondary ones, each in preorder, first of equal addresses."""
    pages = chosen(nodes, prompt, exclude).where(F.coalesce("url", F.lit("")) != "").join(F.broadcast(sites.select("site_name", "base_url")), "site_name", "left")
    pages = pages.select(
        "site_name", "key", F.when(F.col("priority") == "core", "core").otherwise("secondary").alias("priority"), urls.absolute(F.col("url"), F.coalesce("base_url", F.lit(""))).alias("url")
    )
    first = pages.groupBy("site_name", "priority", "url").agg(F.min("key").alias("key"))
    rank = F.row_number().over(Window.partitionBy("site_name").orderBy("priority", "key"))
    return first.select("site_name", "priority", "url", rank.cast("long").alias("rank"))


def priority_stats(nodes: DataFrame, prompt: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(site_name, core, secondary): pages of the chosen tree, equal addresses counted each."""
    pages = chosen(nodes, prompt, exclude).where(F.coalesce("url", F.lit("")) != "")
    core = F.coalesce(F.col("priority") == "core", F.lit(False))
    return pages.groupBy("site_name").agg(F.count_if(core).alias("core"), F.count_if(~core).alias("secondary"))


def complete(flat: DataFrame, index: DataFrame, filtered: bool = False) -> DataFrame:
    """Navigation pages followed by the index pages that navigation does not reach; nothing is added to a filtered tree.

    index: (site_name, url, rank). The added pages have the priority index.
    """
    if filtered:
        return flat
    missing = index.join(flat.select("site_name", "url").distinct(), ["site_name", "url"], "left_anti")
    base = flat.groupBy("site_name").agg(F.max("rank").alias("base"))
    added = missing.join(base, "site_name", "left").select("site_name", F.lit("index").alias("priority"), "url", (F.coalesce("base", F.lit(0)) + F.col("rank")).alias("rank"))
    return flat.unionByName(added)


def discover(nodes: DataFrame, sites: DataFrame, index: DataFrame, prompt: str | None = None, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, stats): the whole discovery. Sites without a tree are served by their index alone and have no stats row.

    Missing index pages count as core. The nodes are kept, since reading them can ask a model.
    """
    nodes = checkpoint(nodes)
    filtered = bool((prompt and prompt.strip()) or exclude)
    pages = complete(flatten(nodes, sites, prompt, exclude), index, filtered)
    if filtered:
        alone = index.join(nodes.select("site_name").distinct(), "site_name", "left_anti")
        pages = pages.unionByName(alone.select("site_name", F.lit("index").alias("priority"), "url", "rank"))
    stats = priority_stats(nodes, prompt, exclude)
    if not filtered:
        more = pages.where("priority = 'index'").groupBy("site_name").agg(F.count(F.lit(1)).alias("more"))
        stats = stats.join(more, "site_name", "left").select("site_name", (F.col("core") + F.coalesce("more", F.lit(0))).alias("core"), "secondary")
    return pages, stats
