"""Fetching behind an interface: transports are injected, so jobs run offline over stored responses too."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalize  # noqa: F401  (re-exported for callers that plan fetches)
from ..model import MIN_MARKDOWN_BYTES, profile
from ..operators.detect import framework_of

GET_SECONDS, HEAD_SECONDS = 30, 15


@dataclass
class Response:
    status: int
    body: bytes = b""


#: A transport: (method, url, headers, seconds) to a response; it may raise on a transport error.
Transport = Callable[[str, str, dict[str, str], float], Response]

FETCHED = "url string, fetched_at timestamp, content_hash string, http_status int, framework string, status string, source string, html string, md string, error string"


def urllib_transport(method: str, url: str, headers: dict[str, str], seconds: float) -> Response:
    """The standard library's client; follows redirects."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers=headers, method=method), timeout=seconds) as r:
            return Response(r.status, r.read() if method == "GET" else b"")
    except HTTPError as e:
        return Response(e.code)


def markdown_url(url: str, framework: str) -> str | None:
    suffixes = profile(framework).markdown_suffixes
    return None if not suffixes else url if url.endswith(suffixes[0]) else url + suffixes[0]


def valid_markdown(body: bytes) -> bool:
    return len(body) >= MIN_MARKDOWN_BYTES and not body.decode("utf-8", "replace").lstrip().lower().startswith(("<!doctype", "<html"))


def fetch_one(url: str, transport: Transport, user_agent: str = "pagemill") -> tuple:
    """One row of FETCHED. A transport error gives status 0, a status other than 200 fails; native Markdown is tried after a page."""
    import hashlib

    headers = {"User-Agent": user_agent, "Accept-Language": "en"}
    now = datetime.now(timezone.utc)
    try:
        r = transport("GET", url, headers, GET_SECONDS)
    except Exception as e:
        return (url, now, "", 0, "", "failed", "html", None, None, str(e)[:500])
    if r.status != 200:
        return (url, now, "", r.status, "", "failed", "html", None, None, f"HTTP {r.status}")
    framework = framework_of(r.body)
    digest, source, md = hashlib.sha256(r.body).hexdigest(), "html", None
    endpoint = markdown_url(url, framework)
    if endpoint:
        try:
            m = transport("GET", endpoint, headers, GET_SECONDS)
            if m.status == 200 and valid_markdown(m.body):
                digest, source, md = hashlib.sha256(m.body).hexdigest(), "markdown", m.body.decode("utf-8", "replace")
        except Exception:  # noqa: S110  (the page itself is kept)
            pass
    return (url, now, digest, 200, framework, "fetched", source, r.body.decode("utf-8", "replace"), md, None)


def fetch(pages: DataFrame, transport: Transport = urllib_transport, delay: float = 0.0, user_agent: str = "pagemill", concurrency: int = 4) -> DataFrame:
    """FETCHED for a table of (site_name, url).

    A site's pages are spread over ``concurrency`` lanes, each of them one task's; a lane waits
    ``concurrency`` times ``delay`` between its pages, so that the site as a whole sees one request a delay. Rules of
    a site in columns crawl_delay, max_concurrency and user_agent of the table come before the arguments; a null url is left out.
    """
    lanes = max(1, concurrency)
    wanted = {"wait": ("crawl_delay", "double", delay), "lanes": ("max_concurrency", "int", lanes), "agent": ("user_agent", "string", user_agent)}
    rules = [F.coalesce(F.col(c).cast(t) if c in pages.columns else F.lit(None).cast(t), F.lit(default)).alias(name) for name, (c, t, default) in wanted.items()]
    todo = pages.where(F.col("url").isNotNull()).select("site_name", "url", *rules).withColumn("lanes", F.greatest("lanes", F.lit(1)))
    todo = todo.withColumn("lane", F.pmod(F.xxhash64("url"), F.col("lanes")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FETCHED.split(", ")]
        last: dict[tuple, float] = {}
        for part in parts:
            rows = []
            for site, u, wait, n, agent, lane in part[["site_name", "url", "wait", "lanes", "agent", "lane"]].itertuples(index=False):
                due = last.get((site, lane), 0.0) + wait * n
                if wait and (site, lane) in last:
                    time.sleep(max(0.0, due - time.monotonic()))
                last[site, lane] = time.monotonic()
                rows.append(fetch_one(u, transport, agent))
            yield pd.DataFrame(rows, columns=columns)

    return todo.repartition("site_name", "lane").mapInPandas(run, FETCHED)


def _first_ok(candidates: list[str], transport: Transport) -> str | None:
    for u in dict.fromkeys(candidates):
        try:
            if transport("HEAD", u, {}, HEAD_SECONDS).status == 200:
                return u
        except Exception:  # noqa: S112  (the next candidate is tried)
            continue
    return None


def locate_sitemap(base: str, transport: Transport) -> str | None:
    return _first_ok([urljoin(base, "/sitemap.xml"), urljoin(base, "/sitemap_index.xml")], transport)


def locate_llms(base: str, transport: Transport) -> str | None:
    return _first_ok([base.rstrip("/") + "/llms.txt", urljoin(base, "/llms.txt")], transport)
