"""The raw store and its manifest: what was fetched, where it lies, what it holds.

A store is a folder with the files of its pages, named by the digest of their addresses, and a
manifest: JSON lines written by the tasks, or one JSON document with all pages. Either is read
back. Folders are looked up through Hadoop, so they can be addresses of an object store; page files are
written by the tasks and need a folder that all executors share.
"""

from __future__ import annotations

import hashlib
import shutil
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import size_text
from ..model import MANIFEST, MANIFEST_PAGE, MIN_MARKDOWN_BYTES
from ..operators.dedup import manifest as ranked

_NAME = "manifest.json"
_PAGE_COLUMNS = MANIFEST_PAGE.removeprefix("struct<").removesuffix(">").replace(":", " ")


def is_native_markdown(body: Column) -> Column:
    """A fetched body is native Markdown if it is long enough and no HTML document."""
    return (F.octet_length(body) >= MIN_MARKDOWN_BYTES) & ~F.lower(F.regexp_replace(body, r"(?U)^\s+", "")).rlike(r"^(<!doctype|<html)")


def probe(records: DataFrame, md: DataFrame, html: DataFrame) -> DataFrame:
    """(record_id, source, content, content_hash): native Markdown where it is valid, else the page; the hash follows the content.

    md: (raw_md_path, body); html: (raw_html_path, html). A record without either has null content.
    """
    r = records.select("record_id", F.nullif("raw_html_path", F.lit("")).alias("raw_html_path"), F.nullif("raw_md_path", F.lit("")).alias("raw_md_path"))
    j = r.join(md.select("raw_md_path", F.col("body").alias("md_body")), "raw_md_path", "left").join(html.select("raw_html_path", F.col("html").alias("page")), "raw_html_path", "left")
    native = F.coalesce(is_native_markdown(F.col("md_body")), F.lit(False))
    content = F.when(native, F.col("md_body")).otherwise(F.col("page"))
    return j.select("record_id", F.when(native, "markdown").otherwise("html").alias("source"), content.alias("content"), F.sha2(content, 256).alias("content_hash"))


def lookup(records: DataFrame, md: DataFrame, html: DataFrame) -> DataFrame:
    """Every record with ``file``, ``content`` by its source; a missing file gives null content and the state failed.

    Records of each source meet the files of that source only, so every file is moved once, by its own name.
    """
    is_md = F.coalesce(F.col("source") == "markdown", F.lit(False))
    as_md = records.where(is_md).withColumn("file", F.col("raw_md_path")).join(md.select(F.col("raw_md_path").alias("file"), F.col("body").alias("content")), "file", "left")
    as_html = records.where(~is_md).withColumn("file", F.col("raw_html_path")).join(html.select(F.col("raw_html_path").alias("file"), F.col("html").alias("content")), "file", "left")
    return as_md.unionByName(as_html).withColumn("status", F.when(F.col("content").isNull(), "failed").otherwise(F.col("status")))


def names(records: DataFrame) -> DataFrame:
    """(record_id, html_file, md_file): file names by the digest of the address."""
    return records.select("record_id", urls.store_name(F.col("url"), ".html").alias("html_file"), urls.store_name(F.col("url"), ".md").alias("md_file"))


def file_name(url: str, suffix: str) -> str:
    """The same for one address."""
    return hashlib.sha256(url.encode("utf-8", "surrogatepass")).hexdigest()[:16] + suffix


def write_pages(fetched: DataFrame, folder: str) -> DataFrame:
    """The pages as files of a store, written by the tasks; the rows without the contents, with raw_html_path and raw_md_path.

    Lazy: the files are written when the result is computed, over the ones that are there. A record without an
    address or content writes nothing and gets empty names.
    """
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"page files need a folder that all executors share, not {folder}")
    top = folder.removeprefix("file://")
    kept = [f for f in fetched.schema.fields if f.name not in ("html", "md")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", raw_html_path string, raw_md_path string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = Path(top)
        place.mkdir(parents=True, exist_ok=True)
        for part in parts:
            out = part.drop(columns=["html", "md"])
            for column, suffix, path in (("html", ".html", "raw_html_path"), ("md", ".md", "raw_md_path")):
                written = []
                for url, body in zip(part["url"], part[column]):
                    name = file_name(url, suffix) if isinstance(url, str) and isinstance(body, str) else ""
                    if name:
                        (place / name).write_bytes(body.encode("utf-8", "replace"))
                    written.append(name)
                out[path] = written
            yield out

    return fetched.mapInPandas(run, schema)


def manifest_page() -> list[Column]:
    null = F.lit("")
    return [
        F.col("url"), F.col("http_status").cast("int").alias("http_status"), F.coalesce("content_hash", null).alias("content_hash"), F.coalesce("raw_html_path", null).alias("html_file"),
        F.coalesce("raw_md_path", null).alias("md_file"), F.col("source"), F.coalesce("framework", null).alias("framework"), F.col("status"),
    ]


def manifest_rows(records: DataFrame) -> DataFrame:
    """The table form of a manifest; it has no time of fetching, canonical address or report."""
    return records.select(*manifest_page())


def manifest_json(records: DataFrame) -> DataFrame:
    """(url, page): each page of the manifest as a JSON text."""
    return records.select("url", F.to_json(F.struct(*manifest_page())).alias("page"))


def write_manifest(records: DataFrame, folder: str, at: Column | None = None, order: str = "record_id") -> None:
    """The manifest of one store as JSON lines, a part file for each task; overwrites. ``order`` is kept as the page's place, where there is one."""
    place = F.col(order) if order in records.columns else F.lit(None)
    rows = records.select(*manifest_page(), place.cast("long").alias("pos"), (at if at is not None else F.current_timestamp()).alias("generated_at"))
    rows.write.mode("overwrite").json(f"{folder}/{_NAME}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a manifest and their place (pos), in either form; an absent one has no pages.

    A document whose name Spark passes over as hidden is read by the driver: one document of one site.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return spark.createDataFrame([], f"{_PAGE_COLUMNS}, pos long")
    if files.getFileStatus(place).isDirectory():
        return spark.read.schema(f"{_PAGE_COLUMNS}, pos long").json(path)
    if place.getName()[0] in "_.":
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(files.open(place), "UTF-8")
        document = spark.createDataFrame([(text,)], "doc string").select(F.from_json("doc", MANIFEST).alias("m")).select("m.pages")
    else:
        document = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return document.select(F.posexplode("pages").alias("pos", "p")).select("p.*", F.col("pos").cast("long").alias("pos"))


def scan_html(spark: SparkSession, folder: str) -> DataFrame:
    """(url, http_status, content) of every HTML file in a folder, in name order by ``url``; undecodable bytes are replaced."""
    return scan_files(spark, folder, "*.html").select(F.concat(F.lit("store:"), F.regexp_replace("file", r"\.html$", "")).alias("url"), F.lit(200).alias("http_status"), "content")


def scan_files(spark: SparkSession, folder: str, names: str = "*.{html,md}") -> DataFrame:
    """(file, content) of every file of a store."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def stored_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records to process again: the best of each page of the manifest, fetched ones only, with the content of their file by source."""
    pages = read_manifest(spark, f"{folder}/{_NAME}").withColumn("record_id", F.coalesce("pos", F.xxhash64("url")))
    best = best_records(pages).withColumnsRenamed({"html_file": "raw_html_path", "md_file": "raw_md_path"})
    files = scan_files(spark, folder)
    return lookup(best, files.select(F.col("file").alias("raw_md_path"), F.col("content").alias("body")), files.select(F.col("file").alias("raw_html_path"), F.col("content").alias("html")))


def fetched(records: DataFrame) -> DataFrame:
    """Records whose page was answered; a null status was not."""
    return records.where("http_status = 200")


def best_records(records: DataFrame) -> DataFrame:
    """Records to process: the best of each page, then those that were fetched."""
    return fetched(records.join(ranked(records).select("record_id"), "record_id", "left_semi"))


def status(files: DataFrame, records: DataFrame) -> DataFrame:
    """(files, bytes, size, records) of a store. files: (name, content)."""
    f = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"))
    return f.crossJoin(records.agg(F.count(F.lit(1)).alias("records"))).select("files", "bytes", size_text(F.col("bytes")).alias("size"), "records")


def listing(records: DataFrame, limit: int = 30) -> DataFrame:
    """The first ``limit`` pages of a manifest with an ok mark, by place in the manifest."""
    return records.orderBy("record_id").limit(limit).select("record_id", "url", (F.col("http_status") == 200).alias("ok"))


def clean(folder: str, force: bool = False) -> int:
    """Remove the pages and the manifest of a local store; Markdown files stay. Nothing happens without ``force``."""
    if not force:
        return 0
    removed = 0
    for f in [*Path(folder).glob("*.html"), Path(folder) / _NAME]:
        if f.is_dir():
            shutil.rmtree(f)
        elif f.exists():
            f.unlink()
        else:
            continue
        removed += 1
    return removed
