"""Sinks and reports: front matter, output paths, files, counts."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def iso(ts: Column) -> Column:
    """ISO form in UTC; microseconds only where there are any."""
    text = F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("+00:00"))


def front_matter(url: Column, fetched_at: Column, content_hash: Column, framework: Column, now: Column | None = None) -> Column:
    """The head of an output file. A null time takes ``now``, which callers fix once a run."""
    when = F.coalesce(iso(fetched_at), iso(now) if now is not None else F.lit(""))
    name = F.when(F.coalesce(framework, F.lit("")) == "", "unknown").otherwise(framework)
    return F.concat(
        F.lit("---\nsource_url: "), F.coalesce(url, F.lit("")), F.lit("\nfetched_at: "), when, F.lit("\ncontent_hash: "), F.coalesce(content_hash, F.lit("")), F.lit("\nframework: "), name, F.lit("\n---\n")
    )


def documents(results: DataFrame, root: str = "out", now: Column | None = None) -> DataFrame:
    """(path, document): where every result goes and its text. Paths ignore queries, so pages can share one."""
    head = front_matter(F.col("url"), F.col("fetched_at"), F.col("content_hash"), F.col("framework"), now)
    return results.select(urls.output_path(root, urls.site(F.col("url")), F.col("url")).alias("path"), F.concat(head, F.coalesce("content", F.lit(""))).alias("document"))


def write_files(docs: DataFrame, base: str = ".") -> DataFrame:
    """Write every document as a file below ``base`` from within the tasks; returns (path, bytes) lazily.

    Documents of one path are ordered by their text, so that the one that stays does not depend on
    the partitioning. Paths cannot leave the base folder.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = Path(base).resolve()
        for part in parts:
            sizes = []
            for path, text in zip(part["path"], part["document"]):
                target = (top / path).resolve()
                if not target.is_relative_to(top):
                    target = top / "outside" / target.name
                target.parent.mkdir(parents=True, exist_ok=True)
                data = text.encode("utf-8", "replace")
                target.write_bytes(data)
                sizes.append(len(data))
            yield pd.DataFrame({"path": part["path"], "bytes": sizes})

    last = docs.groupBy("path").agg(F.max("document").alias("document"))
    return last.mapInPandas(run, "path string, bytes long")


def summary(results: DataFrame) -> DataFrame:
    """(site, bucket, pages): failed are pages without content, then manual_review; everything else has passed, skipped pages too."""
    bucket = F.when(F.col("content").isNull(), "failed").when(F.col("status") == "manual_review", "manual_review").otherwise("passed")
    return results.groupBy(urls.site(F.col("url")).alias("site"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("pages"))


def first_files(docs: DataFrame, limit: int = 8) -> DataFrame:
    """The first files of a run by path."""
    return docs.select("path").distinct().orderBy("path").limit(limit)
