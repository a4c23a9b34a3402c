"""Framework detection: weighted rules, one pass over the elements of a page."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FINGERPRINTS, PROFILES, SCORE_THRESHOLD
from ..session import spread
from .dom import Element, _compiled, _matches, parse


_RULES = tuple((name, k, _compiled(selector), value, score) for name, rules in FINGERPRINTS.items() for k, (selector, value, score) in enumerate(rules))


def scores(tree: Element) -> dict[str, int]:
    """Score of every framework in one walk; a rule counts once however many elements match.

    Every rule asks for an attribute, so elements without any are passed over.
    """
    out = dict.fromkeys(FINGERPRINTS, 0)
    left = list(_RULES)
    for e in tree.walk():
        if not e.attrs:
            continue
        hit = [r for r in left if any(_matches(e, g) for g in r[2]) and (r[3] is None or r[3] in e.attrs.get("content", "").lower())]
        for r in hit:
            out[r[0]] += r[4]
            left.remove(r)
    return out


def best(found: dict[str, int]) -> str:
    """The best-scored framework, ties to the one listed first; generic below the threshold."""
    name = max(found, key=lambda k: found[k], default="generic")
    return name if found and found[name] >= SCORE_THRESHOLD else "generic"


def framework_of(page: str | bytes | None) -> str:
    """Framework of a page, bytes decoded with replacement; generic where nothing can be read."""
    if isinstance(page, bytes):
        page = page.decode("utf-8", "replace")
    return best(scores(parse(page)))


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = list(FINGERPRINTS)
    for b in batches:
        rows = [scores(parse(h)) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([[r[n] for n in names] for r in rows], pa.list_(pa.int32()))], ["key", "scores"])


def framework_from_scores(c: Column) -> Column:
    """Argmax with ties to the first, from an array in listing order."""
    names = F.array(*[F.lit(n) for n in FINGERPRINTS])
    top = F.array_max(c)
    return F.when(top >= SCORE_THRESHOLD, F.element_at(names, F.array_position(c, top).cast("int"))).otherwise(F.lit("generic"))


def detect(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, framework, scores): rules in Python, the decision natively."""
    found = spread(pages.select(F.col(key).alias("key"), F.col(html).alias("html"))).mapInArrow(_detect, f"key {dict(pages.dtypes)[key]}, scores array<int>")
    return found.select(F.col("key").alias(key), framework_from_scores(F.col("scores")).alias("framework"), "scores")


def with_profile(records: DataFrame, framework: str = "framework") -> DataFrame:
    """Look up the profile of every record (seven rows, sent to every task); unknown ones get the generic profile."""
    spark = records.sparkSession
    dim = spark.createDataFrame([(p.name, p.main_selector, list(p.remove_selectors), list(p.boilerplate_phrases), list(p.markdown_suffixes)) for p in PROFILES.values()], "profile string, main_selector string, remove_selectors array<string>, boilerplate_phrases array<string>, markdown_suffixes array<string>")
    known = F.col(framework).isin(*PROFILES)
    return records.withColumn("profile", F.when(known, F.col(framework)).otherwise(F.lit("generic"))).join(F.broadcast(dim), "profile")
