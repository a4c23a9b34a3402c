"""Page indexes: sitemaps and llms.txt files, already fetched, as tables of addresses."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import strip
from ..operators.dedup import endpoints
from ..session import spread

#: Fixed value: an address in a line of text.
URL = r"(https?://[^\s)\]<>\"',]+)"


def _filtered(df: DataFrame, sites: DataFrame | None) -> DataFrame:
    if sites is None:
        return df
    rules = F.broadcast(sites.select("site_name", "allow_patterns", "deny_patterns"))
    return df.join(rules, "site_name", "left").where(urls.allowed(F.col("url"), F.col("allow_patterns"), F.col("deny_patterns"))).drop("allow_patterns", "deny_patterns")


def locations(xml: str | None) -> tuple[list[str], str | None]:
    """The texts of all loc elements, and what is wrong with a malformed file, which has none."""
    if xml is None:
        return [], None
    found: list[str] = []
    held: list[str] | None = None

    def start(name: str, _: dict) -> None:
        nonlocal held
        if name.rpartition(":")[2] == "loc":
            held = []

    def data(text: str) -> None:
        if held is not None:
            held.append(text)

    def end(name: str) -> None:
        nonlocal held
        if held is not None and name.rpartition(":")[2] == "loc":
            found.append("".join(held))
            held = None

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = start, data, end
    try:
        parser.Parse(xml.encode("utf-8", "surrogatepass"), True)
    except (expat.ExpatError, ValueError) as e:
        return [], str(e)
    return found, None


def _locations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [locations(x) for x in b.column("xml").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("site_name"), pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.string())], ["site_name", "locs", "error"])


def sitemap_files(files: DataFrame) -> DataFrame:
    """(site_name, locs, error): each sitemap's addresses as they stand; a malformed file has none and says why.

    files: (site_name, xml).
    """
    return spread(files.select("site_name", "xml")).mapInArrow(_locations, "site_name string, locs array<string>, error string")


def sitemap_errors(files: DataFrame) -> DataFrame:
    """(site_name, error) of every malformed sitemap."""
    return sitemap_files(files).where(F.col("error").isNotNull()).select("site_name", "error")


def sitemap(files: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(site_name, url, pos) of every loc; equal addresses stay, an index of sitemaps is not followed. A malformed file gives no rows; see sitemap_errors.

    files: (site_name, xml).
    """
    locs = sitemap_files(files).select("site_name", F.posexplode("locs").alias("pos", "raw"))
    found = locs.select("site_name", "pos", strip(F.col("raw")).alias("raw")).where("raw <> ''").select("site_name", urls.normalize(F.col("raw")).alias("url"), F.col("pos").cast("long").alias("pos"))
    return _filtered(found, sites)


def llms(files: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(site_name, url, pos): the first address of every line, comments and placeholders left out, first of equal ones, endpoints merged.

    files: (site_name, text).
    """
    lines = files.where(F.col("text").isNotNull()).select("site_name", F.posexplode(F.split("text", r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")).alias("pos", "line"))
    lines = lines.select("site_name", F.col("pos").cast("long").alias("pos"), strip(F.col("line")).alias("line"))
    raw = F.regexp_extract("line", URL, 1)
    kept = lines.where((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").rlike("[<>]") & (raw != ""))
    first = kept.select("site_name", "pos", urls.normalize(raw).alias("url")).groupBy("site_name", "url").agg(F.min("pos").alias("pos"))
    return endpoints(_filtered(first, sites), by=("site_name",)).select("site_name", "url", "pos")


def merged(llms_index: DataFrame, sitemap_index: DataFrame) -> DataFrame:
    """(site_name, url, pos): llms.txt first, then sitemaps, first of equal addresses, endpoints merged; pos orders both."""
    both = llms_index.select("site_name", "url", F.col("pos").alias("at")).unionByName(sitemap_index.select("site_name", "url", (F.col("pos") + F.lit(1 << 40)).alias("at")))
    return both.groupBy("site_name", urls.bare(F.col("url")).alias("url")).agg(F.min("at").alias("pos"))


def as_llms_line(title: Column, url: Column) -> Column:
    return F.concat(F.lit("- ["), title, F.lit("]("), url, F.lit(")"))
