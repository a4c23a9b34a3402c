"""First-wins and best-wins deduplication; order is data, so the winner never depends on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def endpoints(df: DataFrame, url: str = "url", order: str = "pos", by: tuple[str, ...] = ()) -> DataFrame:
    """A page and its Markdown endpoint are one: the bare address once, at its first place."""
    return df.where(F.col(url).isNotNull()).groupBy(*by, urls.bare(F.col(url)).alias(url)).agg(F.min(order).alias(order))


def record_rank(url: Column, source: Column) -> Column:
    """Native Markdown before pages, pages before the rest."""
    return F.when(source == "markdown", 2).when(~F.endswith(url, F.lit(".md")), 1).otherwise(0)


def manifest(records: DataFrame, order: str = "record_id") -> DataFrame:
    """Of the records of one page the best ranked, ties to the first; null addresses are one page, a null order is last.

    The first of each rank is a minimum of its own, so that a page is one row of a hash
    aggregation, where the minimum of a struct would be sorted; any number can be an order.
    """
    rank = F.coalesce(record_rank(F.col("url"), F.col("source")), F.lit(0))
    at = F.col(order)
    first = [F.min(F.when(rank == r, at)).alias(f"rank_{r}") for r in (2, 1, 0)]
    kept = records.select(urls.bare(F.col("url")).alias("page"), "url", "source", order).groupBy("page").agg(*first)
    return kept.select("page", F.coalesce("rank_2", "rank_1", "rank_0").alias(order))


def by_hash(df: DataFrame, key: str, content: Column) -> DataFrame:
    """(content_hash, key, copies): equal contents once, the smallest key standing for them. Null content has no hash."""
    return df.where(content.isNotNull()).groupBy(F.sha2(content, 256).alias("content_hash")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
