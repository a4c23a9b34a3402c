"""Command line: feed (discover, fetch, store, process), spin (process what is stored), store (list, status, clean), version."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .model import AppConfig, Options, SiteConfig
from .operators import nav
from .plans import engine, output
from .session import checkpoint, local_session, ship
from .sources import chat, config, http, index, store

#: Fixed value: addresses of an index that are kept where no pattern is given.
ALLOW = ["/docs/"]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagemill", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--config", default="pagemill.yaml")
    sub = p.add_subparsers(dest="command", required=True)
    feed = sub.add_parser("feed", help="discover, fetch, store and process a site")
    feed.add_argument("url")
    feed.add_argument("--site", help="name of the site: of its rules in the configuration and its folder in the store; the host if none is given")
    feed.add_argument("--discover-only", action="store_true")
    feed.add_argument("--skip-pipeline", action="store_true", help="fetch and store only")
    feed.add_argument("--limit", type=int, default=25, help="pages shown by --discover-only")
    feed.add_argument("--allow", action="append", help="pattern of addresses to keep; the site's, or /docs/, if none is given")
    feed.add_argument("--deny", action="append", help="pattern of addresses to leave out; the site's if none is given")
    feed.add_argument("--prompt", help="words of the navigation entries to keep")
    feed.add_argument("--exclude", action="append", default=[], help="words of the navigation entries to leave out")
    spin = sub.add_parser("spin", help="process a store, or a folder of pages, again")
    spin.add_argument("folder")
    spin.add_argument("--out", default="out")
    kept = sub.add_parser("store", help="what a store holds")
    kept.add_argument("action", choices=("list", "status", "clean"))
    kept.add_argument("folder")
    kept.add_argument("--force", action="store_true")
    return p


def _rules(args, settings: AppConfig) -> tuple[str, SiteConfig]:
    """The site's name and its rules; what the command line says comes first."""
    name = args.site or urlsplit(args.url).hostname or "site"
    rules = settings.sites.get(name) or SiteConfig(args.url, crawl_delay=0.0)
    rules.allow_patterns = args.allow or rules.allow_patterns or ALLOW
    rules.deny_patterns = args.deny if args.deny is not None else rules.deny_patterns
    return name, rules


def discovered(spark: SparkSession, url: str, site: str, rules: SiteConfig, transport: http.Transport, ask: Callable[[str], str] | None = None, prompt: str | None = None, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, stats) of one site: its navigation read by a model, completed from its index; the index alone where there is no model or tree."""

    def get(u: str) -> str | None:
        try:
            r = transport("GET", u, {"User-Agent": rules.user_agent} if rules.user_agent else {}, http.GET_SECONDS)
        except Exception:
            return None
        return r.body.decode("utf-8", "replace") if r.status == 200 else None

    sites = spark.createDataFrame([(site, url, rules.allow_patterns, rules.deny_patterns)], "site_name string, base_url string, allow_patterns array<string>, deny_patterns array<string>")
    lt, sm = http.locate_llms(url, transport), http.locate_sitemap(url, transport)
    a = index.llms(spark.createDataFrame([(site, get(lt) if lt else None)], "site_name string, text string"), sites)
    b = index.sitemap(spark.createDataFrame([(site, get(sm) if sm else None)], "site_name string, xml string"), sites)
    listed = index.merged(a, b).select("site_name", "url", F.col("pos").alias("rank"))
    home = spark.createDataFrame([(site, url, get(url) if ask else None)], "site_name string, url string, html string")
    return nav.discover(nav.read_trees(home, ask), sites, listed, prompt, exclude)


def _feed(spark: SparkSession, args, settings: AppConfig, transport: http.Transport) -> int:
    options = settings.options
    site, rules = _rules(args, settings)
    ask = chat.chat(options.llm, max_tokens=4096) if options.llm else None
    pages, stats = discovered(spark, args.url, site, rules, transport, ask, args.prompt, args.exclude)
    pages = pages.orderBy("rank")
    if args.discover_only:
        for r in pages.limit(args.limit).toLocalIterator():
            print(r.url)
        for r in stats.toLocalIterator():
            print(f"core\t{r.core}\tsecondary\t{r.secondary}")
        return 0
    folder = str(Path(options.store_dir, site).resolve())
    wanted = pages.select("site_name", "url", "rank")
    got = http.fetch(wanted, transport, rules.crawl_delay, rules.user_agent or "pagemill", rules.max_concurrency)
    records = checkpoint(store.write_pages(got, folder).join(wanted.groupBy("url").agg(F.min("rank").alias("record_id")), "url", "left"))
    store.write_manifest(records, folder)
    if args.skip_pipeline:
        print(f"stored\t{records.count()}")
        return 0
    return _process(store.stored_records(spark, folder).withColumn("fetched_at", F.lit(None).cast("timestamp")), options)


def _process(records: DataFrame, options: Options) -> int:
    results = engine.run(records, options, chat.chat(options.llm, max_tokens=512) if options.llm else None).persist()
    docs = output.documents(results, options.output_dir, F.current_timestamp())
    output.write_files(docs, str(Path.cwd())).count()
    for r in output.summary(results).orderBy("site", "bucket").toLocalIterator():
        print(f"{r.site}\t{r.bucket}\t{r.pages}")
    for r in output.first_files(docs).toLocalIterator():
        print(r.path)
    results.unpersist()
    return 0


def _spin(spark: SparkSession, args, options: Options) -> int:
    """A store with a manifest goes by it: the best record of each page, fetched ones, native Markdown; otherwise every HTML file is a page."""
    options.output_dir = args.out
    at = F.lit(None).cast("timestamp")
    if store.read_manifest(spark, f"{args.folder}/manifest.json").limit(1).count():
        return _process(store.stored_records(spark, args.folder).withColumn("fetched_at", at), options)
    files = store.scan_html(spark, args.folder).select("url", "http_status", "content", F.lit("html").alias("source"), F.lit("").alias("framework"), at.alias("fetched_at"), F.sha2("content", 256).alias("content_hash"))
    return _process(files, options)


def _list(spark: SparkSession, folder: str) -> None:
    """The first pages of the manifest with their ok marks; without a manifest the first files with their sizes."""
    pages = store.read_manifest(spark, f"{folder}/manifest.json").withColumn("record_id", F.col("pos"))
    files = store.scan_html(spark, folder)
    print(f"files\t{files.count()}\trecords\t{pages.count()}")
    rows = store.listing(pages).collect()  # 30 at most
    for r in rows:
        print(f"{'ok' if r.ok else '--'}\t{r.url}")
    if not rows:
        for r in files.select("url", F.octet_length("content").alias("n")).orderBy("url").limit(30).toLocalIterator():
            print(f"{r.url}\t{r.n}")


def main(argv: Sequence[str] | None = None, transport: http.Transport = http.urllib_transport) -> int:
    args = _parser().parse_args(argv)
    if "folder" in args and "://" not in args.folder:
        args.folder = str(Path(args.folder).resolve())
    settings = config.load(args.config)
    if args.command == "store" and args.action == "clean":
        print(store.clean(args.folder, args.force))
        return 0
    spark = local_session("pagemill")
    ship(spark)
    if args.command == "feed":
        return _feed(spark, args, settings, transport)
    if args.command == "spin":
        return _spin(spark, args, settings.options)
    if args.action == "status":
        files = store.scan_html(spark, args.folder).select(F.col("url").alias("name"), "content")
        print(store.status(files, store.read_manifest(spark, f"{args.folder}/manifest.json")).first().asDict())
    else:
        _list(spark, args.folder)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
