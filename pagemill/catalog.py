"""The registered queries of the core library and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_cases import CASES, LLM_REPLIES
from .functions import text, urls
from .model import FINGERPRINTS, NAV_CAP, NAV_LINKS, NOISE_PHRASES, Options
from .operators import dedup, detect, markdown, nav, quality
from .plans import engine, output
from .session import scratch, spread, table
from .sources import index, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Pieces of SQL that several oracles share.

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_WS = r"[\s\x0b\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _part(u: str, n: int) -> str:
    return f"regexp_extract({u}, '{_PARTS}', {n})"


def _host(u: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({_part(u, 2)}, '^.*@', ''), ':\d*\z', ''))"


def _path(u: str) -> str:
    return rf"regexp_replace({_part(u, 3)}, ';[^/]*\z', '')"


def _norm(u: str) -> str:
    p = rf"regexp_replace({_path(u)}, '/+\z', '')"
    return f"(CASE WHEN {_part(u, 1)} = '' THEN 'https' ELSE lower({_part(u, 1)}) END || '://' || {_host(u)} || CASE WHEN {p} = '' THEN '/' ELSE {p} END || CASE WHEN {_part(u, 4)} = '' THEN '' ELSE '?' || {_part(u, 4)} END)"


def _bare(u: str) -> str:
    return rf"regexp_replace({u}, '\.md\z', '')"


def _allowed(u: str) -> str:
    return f"(len(list_filter(coalesce(deny_patterns, []), lambda p: regexp_matches({u}, p))) = 0 AND (len(coalesce(allow_patterns, [])) = 0 OR len(list_filter(coalesce(allow_patterns, []), lambda p: regexp_matches({u}, p))) > 0))"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A{_WS}+|{_WS}+\z', '', 'g')"


def _count(c: str, phrase: str) -> str:
    q = phrase.replace("'", "''")
    return f"((length({c}) - length(replace({c}, '{q}', ''))) // {len(phrase)})"


def _site(u: str) -> str:
    return f"coalesce(nullif({_host(u)}, ''), 'site')"


def _out_path(root: str, u: str) -> str:
    p, cut = _path(u), rf"regexp_replace({_path(u)}, '/+\z', '')"
    named = rf"CASE WHEN {cut} LIKE '%.html' THEN regexp_replace({cut}, '\.html\z', '') WHEN {cut} LIKE '%.md' THEN regexp_replace({cut}, '\.md\z', '') WHEN {p} LIKE '%/' THEN {cut} || '/index' ELSE {cut} END"
    return f"'{root}/' || {_site(u)} || '/' || CASE WHEN {p} = '' OR {p} = '/' THEN 'index.md' ELSE regexp_replace({named}, '^/+', '') || '.md' END"


# Addresses.


@query(f"SELECT record_id, {_norm('url')} AS norm_url, {_site('url')} AS site, {_out_path('out', 'url')} AS path FROM page_records")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "page_records").select("record_id", urls.normalize(u).alias("norm_url"), urls.site(u).alias("site"), urls.output_path("out", urls.site(u), u).alias("path"))


@query(f"SELECT {_norm('url')} AS norm_url, min(record_id) AS record_id, count(*) AS records FROM page_records WHERE url IS NOT NULL GROUP BY 1")
def url_dedup(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "page_records").where("url IS NOT NULL")
    return r.groupBy(urls.normalize(F.col("url")).alias("norm_url")).agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("records"))


@query(f"SELECT record_id, {_allowed('url')} AS allowed FROM page_records JOIN sites USING (site_name)")
def url_allow_deny(spark: SparkSession, d: str) -> DataFrame:
    rules = F.broadcast(table(spark, d, "sites").select("site_name", "allow_patterns", "deny_patterns"))
    return table(spark, d, "page_records").join(rules, "site_name").select("record_id", urls.allowed(F.col("url"), F.col("allow_patterns"), F.col("deny_patterns")).alias("allowed"))


@query(
    f"""WITH e AS (SELECT record_id, {_norm('url')} || CASE WHEN record_id % 3 = 0 THEN '.md' ELSE '' END AS url FROM page_records WHERE url IS NOT NULL)
SELECT {_bare('url')} AS url, min(record_id) AS pos FROM e GROUP BY 1"""
)
def endpoint_dedup(spark: SparkSession, d: str) -> DataFrame:
    u = urls.normalize(F.col("url"))
    e = table(spark, d, "page_records").where("url IS NOT NULL").select(F.when(F.col("record_id") % 3 == 0, F.concat(u, F.lit(".md"))).otherwise(u).alias("url"), F.col("record_id").alias("pos"))
    return dedup.endpoints(e)


@query(
    f"""WITH e AS (SELECT record_id, source, {_norm('url')} || CASE WHEN source = 'markdown' THEN '.md' ELSE '' END AS url FROM page_records),
r AS (SELECT *, {_bare('url')} AS page, CASE WHEN source = 'markdown' THEN 2 WHEN url NOT LIKE '%.md' THEN 1 ELSE 0 END AS rk FROM e)
SELECT page, record_id FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY rk DESC, record_id) AS n FROM r) WHERE n = 1"""
)
def manifest_dedup(spark: SparkSession, d: str) -> DataFrame:
    u = urls.normalize(F.col("url"))
    r = table(spark, d, "page_records").select("record_id", "source", F.when(F.col("source") == "markdown", F.concat(u, F.lit(".md"))).otherwise(u).alias("url"))
    return dedup.manifest(r)


@query("SELECT record_id, CASE WHEN framework = 'gitbook' THEN CASE WHEN url LIKE '%.md' THEN url ELSE url || '.md' END END AS endpoint FROM page_records")
def markdown_endpoint(spark: SparkSession, d: str) -> DataFrame:
    r = detect.with_profile(table(spark, d, "page_records").select("record_id", "url", "framework"))
    return r.select("record_id", urls.markdown_endpoint(F.col("url"), F.col("markdown_suffixes")).alias("endpoint"))


@query("SELECT record_id, CASE WHEN regexp_matches(u, '^https?://') AND split_part(split_part(u, '?', 1), '#', 1) LIKE '%.md' THEN 'gitbook' ELSE 'generic' END AS framework FROM (SELECT record_id, url || CASE WHEN record_id % 2 = 0 THEN '.md' ELSE '' END AS u FROM page_records)")
def framework_from_url(spark: SparkSession, d: str) -> DataFrame:
    u = F.concat(F.col("url"), F.when(F.col("record_id") % 2 == 0, ".md").otherwise(""))
    return table(spark, d, "page_records").select("record_id", urls.framework(u).alias("framework"))


@query("SELECT record_id, url FROM page_records WHERE http_status = 200")
def fetched(spark: SparkSession, d: str) -> DataFrame:
    return store.fetched(table(spark, d, "page_records")).select("record_id", "url")


@query("SELECT raw_html_path, sha256(html) AS content_hash FROM raw_html")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_html").select("raw_html_path", urls.content_hash(F.col("html")).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_hash(table(spark, d, "documents"), "doc_id", F.col("text"))


@query(r"""SELECT raw_html_path, md5(regexp_replace(html, '(?i)[^\S\n]+(class|style|data-\w+|tabindex|aria-\w+)(="[^"\n]*")?', '', 'g')) AS stripped FROM raw_html""")
def nav_strip_attributes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_html").select("raw_html_path", F.md5(urls.strip_attributes(F.col("html"))).alias("stripped"))


# The store.


@query("SELECT record_id, substr(sha256(url), 1, 16) || '.html' AS html_file, substr(sha256(url), 1, 16) || '.md' AS md_file FROM page_records")
def store_names(spark: SparkSession, d: str) -> DataFrame:
    return store.names(table(spark, d, "page_records"))


@query(
    rf"""WITH j AS (SELECT record_id, body, html FROM page_records r LEFT JOIN raw_md m ON nullif(r.raw_md_path, '') = m.raw_md_path LEFT JOIN raw_html h ON nullif(r.raw_html_path, '') = h.raw_html_path),
p AS (SELECT record_id, body, html, coalesce(strlen(body) >= 200 AND NOT regexp_matches(lower(regexp_replace(body, '\A{_WS}+', '')), '^(<!doctype|<html)'), false) AS native FROM j)
SELECT record_id, CASE WHEN native THEN 'markdown' ELSE 'html' END AS source, sha256(CASE WHEN native THEN body ELSE html END) AS content_hash FROM p"""
)
def markdown_probe(spark: SparkSession, d: str) -> DataFrame:
    return store.probe(table(spark, d, "page_records"), table(spark, d, "raw_md"), table(spark, d, "raw_html")).select("record_id", "source", "content_hash")


def _looked_up(spark: SparkSession, d: str) -> DataFrame:
    return store.lookup(table(spark, d, "page_records"), table(spark, d, "raw_md"), table(spark, d, "raw_html"))


_LOOKUP = """SELECT r.*, CASE WHEN r.source = 'markdown' THEN m.body ELSE h.html END AS content FROM page_records r
LEFT JOIN raw_md m ON r.source = 'markdown' AND r.raw_md_path = m.raw_md_path LEFT JOIN raw_html h ON r.source IS DISTINCT FROM 'markdown' AND r.raw_html_path = h.raw_html_path"""


@query(f"SELECT record_id, CASE WHEN content IS NULL THEN 'failed' ELSE status END AS status, coalesce(length(content), 0) AS chars FROM ({_LOOKUP})")
def raw_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _looked_up(spark, d).select("record_id", "status", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("chars"))


@query(
    "SELECT record_id, url, http_status, coalesce(content_hash, '') AS content_hash, coalesce(raw_html_path, '') AS html_file, coalesce(raw_md_path, '') AS md_file, source, coalesce(framework, '') AS framework, status FROM page_records"
)
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written to a folder of JSON lines and read back from it."""
    folder = scratch(spark, "manifest")
    store.write_manifest(table(spark, d, "page_records"), folder)
    return store.read_manifest(spark, f"{folder}/manifest.json").withColumnRenamed("pos", "record_id")


_ISO = r"regexp_replace(strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f'), '\.000000\z', '') || '+00:00'"
_HEAD = f"'---' || chr(10) || 'source_url: ' || coalesce(url, '') || chr(10) || 'fetched_at: ' || coalesce({_ISO}, '2025-01-01T00:00:00+00:00') || chr(10) || 'content_hash: ' || coalesce(content_hash, '') || chr(10) || 'framework: ' || coalesce(nullif(framework, ''), 'unknown') || chr(10) || '---' || chr(10)"


def _fixed_now() -> Column:
    return F.timestamp_seconds(F.lit(1735689600))


@query(f"SELECT record_id, {_HEAD} AS head FROM page_records")
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    head = output.front_matter(F.col("url"), F.col("fetched_at"), F.col("content_hash"), F.col("framework"), _fixed_now())
    return table(spark, d, "page_records").select("record_id", head.alias("head"))


@query(f"SELECT {_out_path('out', 'url')} AS path, max(md5({_HEAD} || coalesce(content, ''))) AS digest FROM ({_LOOKUP}) GROUP BY 1")
def output_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = output.documents(_looked_up(spark, d), "out", _fixed_now())
    return docs.groupBy("path").agg(F.max(F.md5("document")).alias("digest"))


@query(f"SELECT {_site('url')} AS site, CASE WHEN content IS NULL THEN 'failed' WHEN status = 'manual_review' THEN 'manual_review' ELSE 'passed' END AS bucket, count(*) AS pages FROM ({_LOOKUP}) GROUP BY 1, 2")
def summary_report(spark: SparkSession, d: str) -> DataFrame:
    return output.summary(_looked_up(spark, d))


_SIZE = "CASE WHEN {b} < 1024 THEN {b} || '.0B' WHEN {b} // 1024 < 1024 THEN {b} // 1024 || '.0KB' WHEN {b} // 1024 // 1024 < 1024 THEN {b} // 1024 // 1024 || '.0MB' ELSE {b} // 1024 // 1024 // 1024 || '.0GB' END"


@query(f"SELECT files, bytes, {_SIZE.format(b='bytes')} AS size, records FROM (SELECT count(*) AS files, sum(strlen(html))::BIGINT AS bytes, (SELECT count(*) FROM page_records) AS records FROM raw_html)")
def store_status(spark: SparkSession, d: str) -> DataFrame:
    return store.status(table(spark, d, "raw_html").select(F.col("html").alias("content")), table(spark, d, "page_records"))


@query("SELECT record_id, url, http_status = 200 AS ok FROM page_records ORDER BY record_id LIMIT 30")
def store_list(spark: SparkSession, d: str) -> DataFrame:
    return store.listing(table(spark, d, "page_records"))


@query(f"SELECT raw_html_path, {_SIZE.format(b='n')} AS size FROM (SELECT raw_html_path, strlen(html) * CASE WHEN strlen(html) % 2 = 0 THEN 1 ELSE 1000000 END AS n FROM raw_html)")
def size_text(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length("html").cast("long")
    return table(spark, d, "raw_html").select("raw_html_path", text.size_text(n * F.when(n % 2 == 0, 1).otherwise(1000000)).alias("size"))


# Indexes.

_XML = "http://www.sitemaps.org/schemas/sitemap/0.9"


def _sitemaps(spark: SparkSession, d: str) -> DataFrame:
    esc = F.replace(F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit(f'<?xml version="1.0"?><urlset xmlns="{_XML}"><url><loc> '), esc, F.lit(" </loc></url><url><loc> </loc></url></urlset>"))
    return table(spark, d, "page_records").select("site_name", xml.alias("xml"))


_SITEMAP = f"SELECT site_name, u AS url FROM (SELECT site_name, {_norm(_strip('url'))} AS u FROM page_records WHERE url IS NOT NULL) LEFT JOIN sites USING (site_name) WHERE {_allowed('u')}"


@query(_SITEMAP)
def sitemap_scan(spark: SparkSession, d: str) -> DataFrame:
    return index.sitemap(_sitemaps(spark, d), table(spark, d, "sites")).select("site_name", "url")


def _llms_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_records").select("site_name", F.concat(F.lit("# Index\n\n- [Page]("), F.col("url"), F.lit("): text\n> see https://a.example/<id>\nhttps://docs.example/x/"), (F.col("record_id") % 7).cast("string"), F.lit(".md\n")).alias("text"))


_URLRE = r"""(https?://[^\s)\]<>"'',]+)"""
_LLMS = rf"""SELECT site_name, {_bare('u')} AS url, min(pos) AS pos FROM (
  SELECT site_name, u, min(pos) AS pos FROM (
    SELECT site_name, pos, {_norm("regexp_extract(line, '" + _URLRE + "', 1)")} AS u FROM (
      SELECT site_name, unnest(ls) AS line0, unnest(range(len(ls))) AS pos, {_strip('line0')} AS line FROM (
        SELECT site_name, regexp_split_to_array('# Index' || chr(10) || chr(10) || '- [Page](' || url || '): text' || chr(10) || '> see https://a.example/<id>' || chr(10) || 'https://docs.example/x/' || record_id % 7 || '.md' || chr(10), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{0085}}\x{{2028}}\x{{2029}}]') AS ls FROM page_records))
    WHERE line <> '' AND line NOT LIKE '#%' AND NOT regexp_matches(line, '[<>]') AND regexp_extract(line, '{_URLRE}', 1) <> '')
  GROUP BY 1, 2) LEFT JOIN sites USING (site_name) WHERE {_allowed('u')} GROUP BY 1, 2"""


@query(_LLMS)
def llms_scan(spark: SparkSession, d: str) -> DataFrame:
    return index.llms(_llms_files(spark, d), table(spark, d, "sites"))


@query(f"SELECT DISTINCT site_name, {_bare('url')} AS url FROM (SELECT site_name, url FROM ({_LLMS}) UNION ALL {_SITEMAP})")
def index_merge(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "sites")
    return index.merged(index.llms(_llms_files(spark, d), sites), index.sitemap(_sitemaps(spark, d), sites)).select("site_name", "url")


# Navigation.

_KEY = "lpad(coalesce({t}pos, 0)::VARCHAR, 8, '0') || lpad({t}node_id::VARCHAR, 12, '0')"
_WALK = f"""t AS (SELECT site_name, node_id, title, url, priority, {_KEY.format(t='')} AS key, [node_id] AS above, [lower(coalesce(title, ''))] AS titles FROM nav_nodes WHERE parent_id IS NULL
UNION ALL SELECT c.site_name, c.node_id, c.title, c.url, c.priority, t.key || '/' || {_KEY.format(t='c.')}, list_append(t.above, c.node_id), list_append(t.titles, lower(coalesce(c.title, ''))) FROM nav_nodes c JOIN t ON c.parent_id = t.node_id AND c.site_name = t.site_name)"""
_CUT = "cut AS (SELECT * FROM t WHERE len(list_filter(titles, lambda x: contains(x, 'sign in') OR contains(x, 'beacon'))) = 0)"
_EXCLUDE, _PROMPT = ["Sign in", " BEACON "], "sealed"
_CHOSEN = f"""WITH RECURSIVE {_WALK}, {_CUT},
hit AS (SELECT site_name, unnest(above) AS node_id FROM cut WHERE contains(titles[-1], '{_PROMPT}')),
kept AS (SELECT * FROM cut WHERE len(list_filter(titles, lambda x: contains(x, '{_PROMPT}'))) > 0 OR (site_name, node_id) IN (SELECT site_name, node_id FROM hit)),
chosen AS (SELECT * FROM kept UNION ALL SELECT * FROM t WHERE site_name NOT IN (SELECT site_name FROM kept))"""
_ABS = """CASE WHEN regexp_matches(n.url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN n.url WHEN n.url LIKE '//%' THEN regexp_extract(base_url, '^([^:]*):', 1) || ':' || n.url
WHEN n.url LIKE '/%' THEN regexp_extract(base_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || n.url WHEN n.url LIKE '#%' OR n.url LIKE '?%' THEN regexp_replace(base_url, '[?#].*$', '') || n.url
ELSE regexp_extract(base_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(base_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*/)', 1), ''), '/') || n.url END"""


def _flat(src: str) -> str:
    return f"""SELECT site_name, priority, url, row_number() OVER (PARTITION BY site_name ORDER BY priority, key) AS rank FROM (
SELECT site_name, CASE WHEN priority = 'core' THEN 'core' ELSE 'secondary' END AS priority, {_ABS} AS url, min(key) AS key FROM {src} n LEFT JOIN sites USING (site_name) WHERE coalesce(n.url, '') <> '' GROUP BY 1, 2, 3)"""


@query(f"WITH RECURSIVE {_WALK}, {_CUT} SELECT site_name, node_id, key FROM cut")
def nav_exclude(spark: SparkSession, d: str) -> DataFrame:
    return nav.excluded(nav.walk(table(spark, d, "nav_nodes")), _EXCLUDE).select("site_name", "node_id", "key")


@query(f"{_CHOSEN} SELECT site_name, node_id FROM chosen")
def nav_prompt(spark: SparkSession, d: str) -> DataFrame:
    return nav.chosen(table(spark, d, "nav_nodes"), _PROMPT, _EXCLUDE).select("site_name", "node_id")


@query(f"WITH RECURSIVE {_WALK} {_flat('t')}")
def nav_flatten(spark: SparkSession, d: str) -> DataFrame:
    return nav.flatten(table(spark, d, "nav_nodes"), table(spark, d, "sites"))


@query(f"{_CHOSEN} {_flat('chosen')}")
def nav_flatten_filtered(spark: SparkSession, d: str) -> DataFrame:
    return nav.flatten(table(spark, d, "nav_nodes"), table(spark, d, "sites"), _PROMPT, _EXCLUDE)


@query(f"{_CHOSEN} SELECT site_name, count(*) FILTER (coalesce(priority = 'core', false)) AS core, count(*) FILTER (NOT coalesce(priority = 'core', false)) AS secondary FROM chosen WHERE coalesce(url, '') <> '' GROUP BY 1")
def nav_stats(spark: SparkSession, d: str) -> DataFrame:
    return nav.priority_stats(table(spark, d, "nav_nodes"), _PROMPT, _EXCLUDE)


def _page_index(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "page_records").where("url IS NOT NULL")
    return r.groupBy("site_name", urls.normalize(F.col("url")).alias("url")).agg(F.min("record_id").alias("rank"))


@query(
    f"""WITH RECURSIVE {_WALK}, flat AS ({_flat('t')}), idx AS (SELECT site_name, {_norm('url')} AS url, min(record_id) AS rank FROM page_records WHERE url IS NOT NULL GROUP BY 1, 2),
base AS (SELECT site_name, max(rank) AS b FROM flat GROUP BY 1)
SELECT * FROM flat UNION ALL SELECT i.site_name, 'index', i.url, coalesce(b, 0) + i.rank FROM idx i LEFT JOIN base USING (site_name) WHERE NOT EXISTS (SELECT 1 FROM flat f WHERE f.site_name = i.site_name AND f.url = i.url)"""
)
def nav_discover(spark: SparkSession, d: str) -> DataFrame:
    return nav.discover(table(spark, d, "nav_nodes"), table(spark, d, "sites"), _page_index(spark, d))[0]


_NAV_NAMES = "td-sidebar|sidebar|navigation|menu|docs-sidebar|md-nav|wy-nav-side|theme-doc-sidebar-container"


@query(
    rf"""SELECT raw_html_path, coalesce(regexp_matches(html, '<[a-z][^>]*\sclass="([^"]* )?({_NAV_NAMES})( [^"]*)?"') OR regexp_matches(html, '<[a-z][^>]*\sid="(td-sidebar|sidebar|navigation|menu)"') OR regexp_matches(html, '(?i)<aside[\s>]|<nav[^>]*role="navigation"')
OR len(list_filter(regexp_extract_all(html, '(?is)<nav[\s>].*?(</nav>|$)'), lambda x: len(regexp_extract_all(x, '(?i)<a[\s>]')) >= {NAV_LINKS})) > 0, false) AS has_nav, true AS capped, 0 AS attributes_left FROM raw_html"""
)
def nav_region(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page has a navigation region, whether it keeps to its cap, and how many dropped attributes it still has."""
    found = nav.extract_nav(table(spark, d, "raw_html"), "raw_html_path")
    n = F.col("nav_html")
    left = F.size(F.regexp_extract_all(n, F.lit(r"(?i)\s(?:class|style|tabindex)=\""), F.lit(0)))
    return found.select("raw_html_path", n.isNotNull().alias("has_nav"), F.coalesce(F.length(n) <= NAV_CAP + 40, F.lit(True)).alias("capped"), F.coalesce(left, F.lit(0)).cast("long").alias("attributes_left"))


# Detection.


def _rule_sql(selector: str, value: str | None, score: int) -> str:
    if selector.startswith("meta"):
        test = rf"""regexp_matches(html, '(?i)<meta[^>]*name="generator"[^>]*content="[^"]*{value}|<meta[^>]*content="[^"]*{value}[^"]*"[^>]*name="generator"')"""
    elif "*=" in selector:
        test = """regexp_matches(html, '<div[^>]*class="[^"]*group/codeblock')"""
    elif selector.startswith("script#"):
        test = """regexp_matches(html, '<script[^>]*id="_R_"')"""
    elif selector.startswith("#"):
        test = f"""regexp_matches(html, '<[a-z][^>]*\\sid="{selector[1:]}"')"""
    elif selector.startswith("main["):
        test = r"regexp_matches(html, '<main[^>]*\sdata-pagefind-body')"
    elif "role" in selector:
        test = """(regexp_matches(html, '<div[^>]*class="([^"]* )?sphinxsidebar( [^"]*)?"[^>]*role="navigation"') OR regexp_matches(html, '<div[^>]*role="navigation"[^>]*class="([^"]* )?sphinxsidebar( [^"]*)?"'))"""
    else:
        test = f"""regexp_matches(html, '<[a-z][^>]*\\sclass="([^"]* )?{selector[1:]}( [^"]*)?"')"""
    return f"CASE WHEN {test} THEN {score} ELSE 0 END"


_SCORES = ", ".join(f"{' + '.join(_rule_sql(*r) for r in rules)} AS s{i}" for i, rules in enumerate(FINGERPRINTS.values()))
_TOP = f"greatest({', '.join(f's{i}' for i in range(len(FINGERPRINTS)))})"
_ARGMAX = " ".join(f"WHEN s{i} = {_TOP} THEN '{name}'" for i, name in enumerate(FINGERPRINTS))


@query(f"SELECT raw_html_path, CASE WHEN {_TOP} < 4 THEN 'generic' {_ARGMAX} END AS framework FROM (SELECT raw_html_path, {_SCORES} FROM raw_html)")
def detect_framework(spark: SparkSession, d: str) -> DataFrame:
    return detect.detect(table(spark, d, "raw_html"), "raw_html_path").select("raw_html_path", "framework")


# Quality.


def derived(spark: SparkSession, d: str) -> DataFrame:
    """Documents turned into Markdown with headings, links, fences and noise by their number."""
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    link = F.concat(F.lit("["), F.coalesce("source", F.lit("")), F.lit("](https://h/"), i.cast("string"), F.lit(")\n"))
    return table(spark, d, "documents").select(
        "doc_id",
        F.concat(
            F.lit("# "), F.split_part(t, F.lit("\n"), F.lit(1)), F.lit("\n"), F.when(i % 3 == 0, "#### x\n# y\n##### z\n").otherwise(""), F.when(i % 2 == 0, link).otherwise(""), F.when(i % 11 == 0, F.repeat(link, 20)).otherwise(""),
            F.when(i % 5 == 0, "```\ncode\n```\n").when(i % 7 == 0, "```\n").otherwise(""), F.when(i % 13 == 0, "```python\nif a\\_b:\nreturn\n```\n").otherwise(""), F.when(i % 4 == 0, F.repeat(F.lit("Copyright Edit this page "), (i % 6).cast("int"))).otherwise(""), t,
        ).alias("md"),
    )


_LINK_SQL = "'[' || coalesce(source, '') || '](https://h/' || doc_id || ')' || chr(10)"
_MD = rf"""md AS (SELECT doc_id, '# ' || split_part(t, chr(10), 1) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '#### x' || chr(10) || '# y' || chr(10) || '##### z' || chr(10) ELSE '' END
|| CASE WHEN doc_id % 2 = 0 THEN {_LINK_SQL} ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN repeat({_LINK_SQL}, 20) ELSE '' END
|| CASE WHEN doc_id % 5 = 0 THEN '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) WHEN doc_id % 7 = 0 THEN '```' || chr(10) ELSE '' END
|| CASE WHEN doc_id % 13 = 0 THEN '```python' || chr(10) || 'if a\_b:' || chr(10) || 'return' || chr(10) || '```' || chr(10) ELSE '' END
|| CASE WHEN doc_id % 4 = 0 THEN repeat('Copyright Edit this page ', (doc_id % 6)::INT) ELSE '' END || t AS md FROM (SELECT *, coalesce(text, '') AS t FROM documents))"""
_PLAIN = _strip(rf"regexp_replace(regexp_replace(md, '[#*`~>\[\]()!|-]', '', 'g'), '{_WS}+', ' ', 'g')")
_LEN = f"length({_PLAIN})"
_HITS = " + ".join(_count("md", p) for p in NOISE_PHRASES)
_TEXTS = r"regexp_extract_all(md, '\[([^\]]*)\]\(([^)]*)\)', 1)"
_DENS = f"list_sum(list_append(list_transform({_TEXTS}, lambda x: length(x)), 0)) / greatest(length(md), 1)"
_PER1K = f"CASE WHEN length(md) < 200 THEN 0.0 ELSE len({_TEXTS}) / (length(md) / 1000.0) END"
_LEVELS = rf"list_transform(regexp_extract_all(md, '(?m)^(#{{1,6}}){_WS}', 1), lambda x: length(x))"
_FOLD = """list_reduce(list_prepend({'on': false, 'py': false, 'open': 0, 'n': 0::BIGINT, 'l': ''}, list_transform(string_split(md, chr(10)), lambda x: {'on': false, 'py': false, 'open': 0, 'n': 0::BIGINT, 'l': x})), lambda a, x: CASE
WHEN regexp_matches(x.l, '^`{3,}\\s*\\S*\\s*$') AND a.on THEN {'on': false, 'py': false, 'open': 0, 'n': a.n, 'l': ''}
WHEN regexp_matches(x.l, '^`{3,}\\s*\\S*\\s*$') THEN {'on': true, 'py': lower(regexp_extract(x.l, '^`{3,}\\s*(\\S*)', 1)) IN ('python', 'py', ''), 'open': 0, 'n': a.n, 'l': ''}
WHEN a.on THEN {'on': true, 'py': a.py, 'open': (CASE WHEN regexp_matches(x.l, '\\S') AND NOT regexp_matches(x.l, '^\\s*#') THEN 0 ELSE a.open END) + (CASE WHEN a.py AND regexp_matches(x.l, ':\\s*$') AND NOT x.l LIKE '#%' THEN 1 ELSE 0 END),
 'n': a.n + (CASE WHEN contains(x.l, '\\_') THEN 1 ELSE 0 END) + (CASE WHEN a.py AND regexp_matches(x.l, '^\\S') AND NOT regexp_matches(x.l, '^\\s*#') THEN a.open ELSE 0 END), 'l': ''}
ELSE {'on': a.on, 'py': a.py, 'open': a.open, 'n': a.n, 'l': ''} END).n""".replace("\\\\", "\\")
_CHECKS = f"""WITH {_MD}, raw AS (SELECT doc_id, {_LEN} AS len_n, {_count('md', '```')} AS fences, {_LEVELS} AS lv, {_HITS} AS hits, {_DENS} AS dens, {_PER1K} AS per1k, {_FOLD} AS code_n FROM md),
j AS (SELECT *, len(list_filter(range(2, len(lv) + 1), lambda k: lv[k] - lv[k - 1] > 2)) AS jumps FROM raw),
c AS (SELECT *, len_n >= 500 AS p1, least(1.0, len_n / 500.0)::DOUBLE AS s1, fences % 2 = 0 AS p2, CASE WHEN fences % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS s2, code_n = 0 AS p3, greatest(0.0, 1 - code_n * 0.15::DOUBLE) AS s3,
 len(lv) < 2 OR jumps <= greatest(1.0, len(lv) * 0.1) AS p4, CASE WHEN len(lv) < 2 THEN 1.0::DOUBLE ELSE greatest(0.0, 1 - jumps / len(lv)) END AS s4,
 hits <= 5 AND dens < 0.15 AND per1k < 8.0 AS p5, least(1.0, greatest(0.0, 1 - hits / 10.0::DOUBLE) * greatest(0.0, 1 - dens * 3) * greatest(0.0, 1 - (per1k - 2) / 20)) AS s5 FROM j),
e AS (SELECT *, round((s1 + s2 + s3 + s4 + s5) / 5, 9) AS total, p1 AND p2 AND p3 AND p4 AND p5 AS all_passed FROM c),
f AS (SELECT *, all_passed OR total >= 0.6 AS passed FROM e)"""


def _check(spark: SparkSession, d: str, check: Column) -> DataFrame:
    return derived(spark, d).select("doc_id", check.alias("c")).select("doc_id", "c.passed", F.round("c.score", 9).alias("score"), "c.n")


@query(f"{_CHECKS} SELECT doc_id, p1 AS passed, round(s1, 9) AS score, len_n AS n FROM c")
def check_length(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d, quality.length_col(F.col("md")))


@query(f"{_CHECKS} SELECT doc_id, p2 AS passed, s2 AS score, fences AS n FROM c")
def check_code_integrity(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d, quality.code_integrity_col(F.col("md")))


@query(f"{_CHECKS} SELECT doc_id, p3 AS passed, round(s3, 9) AS score, code_n AS n FROM c")
def check_code_block_content(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d, quality.code_block_content_col(F.col("md")))


@query(f"{_CHECKS} SELECT doc_id, p4 AS passed, round(s4, 9) AS score, CASE WHEN len(lv) < 2 THEN 0 ELSE jumps END AS n FROM c")
def check_heading_jumps(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d, quality.heading_jumps_col(F.col("md")))


@query(f"{_CHECKS} SELECT doc_id, p5 AS passed, round(s5, 9) AS score, hits AS n FROM c")
def check_noise_lines(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d, quality.noise_lines_col(F.col("md")))


@query(f"{_CHECKS} SELECT doc_id, dens < 0.15 AND per1k < 8.0 AS passed, round(least(1.0, greatest(0.0, 1 - dens * 3) * greatest(0.0, 1 - (per1k - 2) / 20)), 9) AS score, round(dens, 9) AS density FROM c")
def check_link_density(spark: SparkSession, d: str) -> DataFrame:
    c = derived(spark, d).select("doc_id", quality.link_density_col(F.col("md")).alias("c"))
    return c.select("doc_id", "c.passed", F.round("c.score", 9).alias("score"), F.round("c.density", 9).alias("density"))


@query(f"WITH {_MD} SELECT doc_id, md5({_PLAIN}) AS plain FROM md")
def strip_markdown(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d).select("doc_id", F.md5(text.strip_markdown(F.col("md"))).alias("plain"))


_REPAIR = "CASE WHEN NOT p4 AND NOT p1 THEN 'try_trafilatura' WHEN NOT p4 THEN 'widen_selector' WHEN NOT p1 THEN 'try_trafilatura' WHEN NOT p5 THEN 'add_boilerplate' WHEN NOT p2 THEN 'skip_filter' WHEN NOT p3 THEN 'skip_filter' END"


@query(f"{_CHECKS} SELECT doc_id, passed, total, {_REPAIR} AS action, total BETWEEN 0.3 AND 0.8 AND NOT passed AS needs_llm, CASE WHEN passed THEN 'passed' ELSE 'manual_review' END AS status FROM f")
def quality_evaluate(spark: SparkSession, d: str) -> DataFrame:
    e = quality.evaluated(derived(spark, d))
    return e.select("doc_id", "passed", F.round("total", 9).alias("total"), F.col("retry_action.action").alias("action"), "needs_llm", "status")


_LOST = r"doc_id % 3 > 0 AND NOT regexp_matches(md, '(?m)^`{3,}[^\S\n]*\S*[^\S\n]*$')"


@query(f"{_CHECKS}, g AS (SELECT doc_id, all_passed, s1 + s2 + s3 + s4 + s5 AS points, {_LOST} AS lost FROM e JOIN md USING (doc_id)) SELECT doc_id, lost AS code_lost, round(points / CASE WHEN lost THEN 6 ELSE 5 END, 9) AS total, NOT lost AND (all_passed OR points / 5 >= 0.6) AS passed FROM g".replace(" FROM e JOIN md USING (doc_id)", " FROM (SELECT e.*, md.md FROM e JOIN md USING (doc_id))"))
def check_code_preserved(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation with a number of raw code blocks known: none left of them fails the page."""
    e = quality.evaluated(derived(spark, d), raw_code=F.col("doc_id") % 3)
    return e.select("doc_id", "code_lost", F.round("total", 9).alias("total"), "passed")


@query(f"{_CHECKS} SELECT {_REPAIR} AS action, passed, count(*) AS documents FROM f GROUP BY 1, 2")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.evaluated(derived(spark, d)).groupBy(F.col("retry_action.action").alias("action"), "passed").agg(F.count(F.lit(1)).alias("documents"))


_BODY = "CASE WHEN b LIKE '---%' AND len(string_split(b, '---')) >= 3 THEN array_to_string(string_split(b, '---')[3:], '---') ELSE b END"


@query(
    rf"""WITH r AS (SELECT raw_md_path AS path, body AS b FROM raw_md UNION ALL SELECT raw_html_path, html FROM raw_html), x AS (SELECT path, {_BODY} AS t FROM r),
n AS (SELECT path, length({_strip('t')}) AS chars, len(list_filter(string_split(t, chr(10)), lambda l: {_strip('l')} <> '')) AS ls, len(regexp_extract_all(t, '\[.*?\]\(.*?\)')) AS links FROM x)
SELECT path, chars < 50 OR ls < 5 OR (links / greatest(1.0, chars / 100.0) > 20 AND chars < 200) AS low FROM n"""
)
def low_value(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "raw_md").select(F.col("raw_md_path").alias("path"), F.col("body").alias("b")).unionByName(table(spark, d, "raw_html").select(F.col("raw_html_path").alias("path"), F.col("html").alias("b")))
    return both.select("path", text.low_value(F.col("b")).alias("low"))


@query(
    r"""SELECT raw_html_path AS path, (length(lower(html)) - length(replace(lower(html), '<pre', ''))) // 4 AS blocks FROM raw_html
UNION ALL SELECT raw_md_path, len(regexp_extract_all(body, '(?m)^\s*(`{3,}|~{3,})[^`~]*$')) // 2 FROM raw_md"""
)
def raw_code_blocks(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "raw_html").select(F.col("raw_html_path").alias("path"), text.html_code_blocks(F.col("html")).alias("blocks"))
    return a.unionByName(table(spark, d, "raw_md").select(F.col("raw_md_path").alias("path"), text.markdown_code_blocks(F.col("body")).alias("blocks")))


# Cleaning.


@query(r"SELECT raw_md_path, md5(regexp_replace(body, '\]\(([^)\s]*?)\.md(#[^)\s]*)?\)', '](\1\2)', 'g')) AS linked FROM raw_md")
def md_links(spark: SparkSession, d: str) -> DataFrame:
    bodies = table(spark, d, "raw_md").select(F.col("raw_md_path").alias("key"), F.col("body").alias("text"))
    return _with(bodies, "key string", markdown.md_links).select(F.col("key").alias("raw_md_path"), F.md5("text").alias("linked"))


def _with(texts: DataFrame, key: str, f: Callable[[str], str]) -> DataFrame:
    """(key, text) with a text function applied; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([None if x is None else f(x) for x in b.column("text").to_pylist()], pa.string())], ["key", "text"])

    return spread(texts).mapInArrow(run, f"{key}, text string")


@query(r"""SELECT doc_id, md5(regexp_replace(t, '[\x{1F300}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{2139}]', '', 'g')) AS plain FROM (SELECT doc_id, coalesce(text, '') || ' ' || chr(128640) || chr(9989) || chr(8505) || '!' AS t FROM documents)""")
def md_emoji(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" \U0001f680\u2705\u2139!"))
    out = _with(table(spark, d, "documents").select(F.col("doc_id").alias("key"), t.alias("text")), "key long", lambda x: "\n".join(markdown.OVERRIDES["emoji"](x.split("\n"))))
    return out.select(F.col("key").alias("doc_id"), F.md5("text").alias("plain"))


def _normalize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .model import profile

    p = profile("gitbook")
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("raw_md_path"), pa.array([markdown.normalize(x, p) for x in b.column("body").to_pylist()], pa.string())], ["raw_md_path", "md"])


@query(
    """SELECT raw_md_path, (length(body) - length(replace(body, '```', ''))) // 3 AS fences, true AS ends_with_one_line_end, false AS many_empty_lines, 0 AS file_links FROM raw_md"""
)
def normalize_markdown(spark: SparkSession, d: str) -> DataFrame:
    """What native Markdown keeps and what it no longer has once it is put in order."""
    md = normalized_markdown(spark, d)
    t = F.col("md")
    return md.select(
        "raw_md_path", text.count_of(t, "```").alias("fences"), (F.endswith(t, F.lit("\n")) & ~F.endswith(t, F.lit("\n\n"))).alias("ends_with_one_line_end"),
        F.rlike(t, F.lit(r"\A\n|\n\n\n\n(?![\s\S]*```)")).alias("many_empty_lines"), F.size(F.regexp_extract_all(t, F.lit(r"\]\([^)\s]*\.md(?:#[^)\s]*)?\)"), F.lit(0))).cast("long").alias("file_links"),
    )


def normalized_markdown(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "raw_md").select("raw_md_path", "body")).mapInArrow(_normalize, "raw_md_path string, md string")


_STEPS = "main_content,nav_remnants,boilerplate,scripts,tab_content,line_numbers,remove_code_lang_labels,flatten_block_in_cells,escape_cell_pipes_html,protect_code,flatten_nested_tables,html_to_md,restore_code,localize_assets,overrides,unescape_code_underscores"


@query(f"SELECT raw_html_path, CASE WHEN {_TOP} < 4 THEN 'generic' {_ARGMAX} END AS framework, '{_STEPS}' AS steps, true AS decided, 0 AS tags_left FROM (SELECT raw_html_path, {_SCORES} FROM raw_html)")
def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page through the chain: its framework, the steps it went through, whether it was decided by its score, and what is left of block tags outside code."""
    c = cleaned_pages(spark, d)
    prose = F.regexp_replace("content", r"(?s)```.*?```|~~~.*?~~~|`[^`]*`", "")
    left = F.size(F.regexp_extract_all(prose, F.lit(r"(?i)(?<!\\)</?(?:div|p|ul|ol|li|table|tr|td|th|h[1-6]|nav|aside|script|style|pre)(?:\s[^<>]*)?>"), F.lit(0)))
    decided = F.col("status").isin("passed", "manual_review") & ((F.col("score") < Options().threshold) <= (F.col("status") == "manual_review"))
    return c.select("raw_html_path", "framework", F.array_join("steps", ",").alias("steps"), decided.alias("decided"), left.cast("long").alias("tags_left"))


def cleaned_pages(spark: SparkSession, d: str) -> DataFrame:
    """(raw_html_path, framework, content, steps, status, score) of every stored page."""
    return _cleaned(table(spark, d, "raw_html"))


def _cleaned(raw_html: DataFrame) -> DataFrame:
    pages = raw_html.select(F.col("raw_html_path").alias("url"), F.col("html").alias("content"), F.lit("html").alias("source"), F.lit("").alias("framework"))
    done = engine.run(pages, Options(precheck=False, max_retries=0))
    return done.select(F.col("url").alias("raw_html_path"), "framework", "content", "steps", "status", F.col("report.total_score").alias("score"))


@query("SELECT raw_html_path, CASE WHEN contains(html, '<table width') THEN 0 ELSE 2 * ((length(html) - length(replace(html, '<pre', ''))) // 4) END AS fences FROM raw_html")
def clean_code_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Code survives the cleaning: two fences for every block of the raw page; where the page is laid out as a table its blocks stand in cells and become inline code."""
    return cleaned_pages(spark, d).select("raw_html_path", text.count_of(F.col("content"), "```").alias("fences"))


@query(
    rf"""WITH r AS (SELECT *, {_bare('url')} AS page, CASE WHEN source = 'markdown' THEN 2 WHEN url NOT LIKE '%.md' THEN 1 ELSE 0 END AS rk FROM page_records),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY rk DESC, record_id) AS k FROM r) WHERE k = 1 AND http_status = 200),
f AS (SELECT record_id, CASE WHEN source = 'markdown' THEN m.body ELSE h.html END AS b FROM best
 LEFT JOIN raw_md m ON source = 'markdown' AND best.raw_md_path = m.raw_md_path LEFT JOIN raw_html h ON source IS DISTINCT FROM 'markdown' AND best.raw_html_path = h.raw_html_path),
x AS (SELECT record_id, b, {_BODY} AS t FROM f),
n AS (SELECT record_id, b, length({_strip('t')}) AS chars, len(list_filter(string_split(t, chr(10)), lambda l: {_strip('l')} <> '')) AS ls, len(regexp_extract_all(t, '\[.*?\]\(.*?\)')) AS links FROM x)
SELECT record_id, CASE WHEN b IS NULL THEN 'failed' WHEN chars < 50 OR ls < 5 OR (links / greatest(1.0, chars / 100.0) > 20 AND chars < 200) THEN 'skipped_low_quality' ELSE 'processed' END AS outcome, b IS NULL AS has_error, 'ok' AS retries FROM n"""
)
def process_records(spark: SparkSession, d: str) -> DataFrame:
    """The whole lifecycle: best records, raw lookup, precheck, cleaning with retry, decision; which way every record went."""
    p = processed_records(spark, d)
    outcome = F.when(F.col("status").isin("passed", "manual_review"), "processed").otherwise(F.col("status"))
    most = Options().max_retries
    kept = F.when((F.coalesce("retry_count", F.lit(0)) <= most) & ((F.col("status") != "manual_review") | F.array_contains("steps", "markdown_normalize") | (F.col("retry_count") == most)), "ok").otherwise("wrong")
    return p.select("record_id", outcome.alias("outcome"), F.col("error").isNotNull().alias("has_error"), kept.alias("retries"))


def processed_records(spark: SparkSession, d: str) -> DataFrame:
    best = store.best_records(table(spark, d, "page_records"))
    found = store.lookup(best, table(spark, d, "raw_md"), table(spark, d, "raw_html"))
    return engine.run(found.select("record_id", "url", "source", "framework", "content"), Options()).select("record_id", "url", "framework", "status", "retry_count", "steps", "content", "error")


def _inline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = {name: f for name, f, _, _ in CASES}
    for b in batches:
        names, given = b.column("name").to_pylist(), b.column("given").to_pylist()
        yield pa.RecordBatch.from_arrays([b.column("name"), pa.array([runs[n](g) for n, g in zip(names, given)], pa.string())], ["name", "result"])


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in rows)


@query(f"SELECT * FROM (VALUES {_values([(n, want) for n, _, _, want in CASES])}) t(name, result)")
def step_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every cleaning step on a small input of its own."""
    from .session import ship

    ship(spark)
    return spark.createDataFrame([(n, g) for n, _, g, _ in CASES], "name string, given string").mapInArrow(_inline, "name string, result string")


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [quality.parse_verdict(x) for x in b.column("reply").to_pylist()]
        trees = [nav.parse_tree(x) for x in b.column("reply").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("name"), pa.array([str(v["passed"]).lower() if v else "none" for v in out], pa.string()), pa.array([v["score"] if v else -1.0 for v in out], pa.float64()), pa.array([t is not None for t in trees], pa.bool_())], ["name", "passed", "score", "is_tree"])


@query("SELECT name, passed, score, is_tree FROM (VALUES " + ", ".join(f"('{n}', '{'none' if p is None else str(p).lower()}', {-1.0 if s is None else s}::DOUBLE, {t})" for n, _, p, s, t in LLM_REPLIES) + ") t(name, passed, score, is_tree)")
def llm_json_repair(spark: SparkSession, d: str) -> DataFrame:
    from .session import ship

    ship(spark)
    return spark.createDataFrame([(n, r) for n, r, *_ in LLM_REPLIES], "name string, reply string").mapInArrow(_verdicts, "name string, passed string, score double, is_tree boolean")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
