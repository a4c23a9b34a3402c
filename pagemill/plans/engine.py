"""The engine: precheck, framework, cleaning with bounded retry or Markdown normalisation, scoring, decision.

Everything that Catalyst can do stays a Column expression and runs before or after the one
Python stage, so rows that the precheck rejects and columns that nobody reads never reach it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..model import ACTION, FALLBACK_PHRASES, REPORT, WIDE_SELECTOR, Options, Profile, profile
from ..operators import markdown, quality
from ..operators.clean import run_chain
from ..operators.detect import best, framework_of, scores
from ..operators.dom import Element, parse
from ..session import spread

SKIPPED = "skipped_low_quality"
_INPUT = ("content_in", "source", "framework_in", "low_in")
RESULT = "framework string, content string, steps array<string>, retry_count int, report {report}, error string".format(report=REPORT.simpleString())


def adjusted(p: Profile, skip: set[str], action: dict | None) -> Profile:
    """The next attempt's profile; ``skip`` grows in place. Phrases keep their order, unlike a set's."""
    act = (action or {}).get("action")
    if act == "try_trafilatura":
        return p.with_(main_selector="")
    if act == "add_boilerplate":
        return p.with_(boilerplate_phrases=tuple(dict.fromkeys(p.boilerplate_phrases + FALLBACK_PHRASES)))
    if act == "skip_filter":
        skip.add(action["filter_name"])
        return p
    return p.with_(main_selector=WIDE_SELECTOR)


def process_html(page: str, p: Profile, o: Options, ask: Callable[[str], str] | None = None, extractor: Callable[[str], str | None] | None = None, tree: Element | None = None) -> tuple[str, list[str], dict, int]:
    """Content, steps, report and retries: every attempt starts from the raw page; the first that passes wins, else the last."""
    skip: set[str] = set()
    raw_code = page.lower().count("<pre")
    judge = quality.judge(ask) if ask else None
    for attempt in range(o.max_retries + 1):
        content, steps = run_chain(page, p, skip, extractor, tree)
        tree = None
        report = quality.evaluate(content, o.min_length, o.threshold, o.gray_low, o.gray_high, judge, raw_code)
        if report["passed"] or attempt == o.max_retries:
            return content, steps, report, attempt
        p = adjusted(p, skip, report["retry_action"])
    raise AssertionError("max_retries is at least 0")


def process_markdown(body: str, p: Profile, o: Options, ask: Callable[[str], str] | None = None) -> tuple[str, list[str], dict, int]:
    content = markdown.normalize(body, p)
    fences = sum(1 for x in body.split("\n") if (s := x.lstrip()).startswith(("```", "~~~")) and not set(s.lstrip("`~")) & set("`~"))
    report = quality.evaluate(content, o.min_length, o.threshold, o.gray_low, o.gray_high, quality.judge(ask) if ask else None, fences // 2)
    return content, ["markdown_normalize", "quality_gate"], report, 0


def _stage(o: Options, ask, extractor):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: dict[str, list] = {k: [] for k in ("framework", "content", "steps", "retry_count", "report", "error")}
            for body, source, name, low in zip(*(b.column(c).to_pylist() for c in _INPUT)):
                row: tuple = (name, None, [], 0, None, "no content")
                if low:
                    row = (name or "", "", [SKIPPED], 0, None, None)
                elif body is not None:
                    try:
                        if source == "markdown":
                            name = name or framework_of(body)
                            content, steps, report, retries = process_markdown(body, profile(name), o, ask)
                        else:
                            tree = None if name else parse(body)  # one parse serves detection and the first attempt
                            name = name or best(scores(tree))
                            content, steps, report, retries = process_html(body, profile(name), o, ask, extractor, tree)
                        row = (name, content, steps, retries, report, None)
                    except Exception as e:  # one page never ends the run
                        row = (name, None, [], 0, None, f"{type(e).__name__}: {e}"[:500])
                for k, v in zip(columns, row):
                    columns[k].append(v)
            yield _batch(b, columns)

    return run


_CHECK = pa.struct([("passed", pa.bool_()), ("score", pa.float64()), ("detail", pa.string())])
_REPORT = pa.struct(
    [
        ("passed", pa.bool_()), ("total_score", pa.float64()), ("checks", pa.map_(pa.string(), _CHECK)), ("failed_filter", pa.string()),
        ("retry_action", pa.struct([(f.name, pa.string()) for f in ACTION.fields])), ("needs_llm", pa.bool_()), ("llm_passed", pa.bool_()), ("llm_reason", pa.string()), ("message", pa.string()),
    ]
)


def _batch(b: pa.RecordBatch, columns: dict[str, list]) -> pa.RecordBatch:
    reports = [r and r | {"checks": list(r["checks"].items())} for r in columns["report"]]
    made = [
        pa.array(columns["framework"], pa.string()), pa.array(columns["content"], pa.string()), pa.array(columns["steps"], pa.list_(pa.string())),
        pa.array(columns["retry_count"], pa.int32()), pa.array(reports, _REPORT), pa.array(columns["error"], pa.string()),
    ]
    kept = [(n, b.column(n)) for n in b.schema.names if n not in _INPUT]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + made, [n for n, _ in kept] + list(columns))


def run(records: DataFrame, options: Options | None = None, ask: Callable[[str], str] | None = None, extractor: Callable[[str], str | None] | None = None) -> DataFrame:
    """Process a table of records with their raw ``content``.

    Needs url, source, framework, content; other columns pass through, except status and
    quality_report, which are replaced. Adds framework, content, steps, retry_count, report, error and status. A null
    content is a failed row; a page rejected by the precheck has empty content and no report.
    """
    o = options or Options()
    keep = [c for c in records.columns if c not in ("content", "framework", "source", "status", "quality_report", "steps", "retry_count", "report", "error")]
    given = F.coalesce("framework", F.lit(""))
    # a Markdown file has no page to detect by, but its address may tell
    known = F.when(given != "", given).when(F.col("source") == "markdown", urls.framework(F.col("url")))
    # rejected rows go on without their content, so they cost the stage nothing and are read once
    low = F.col("content").isNotNull() & text.low_value(F.col("content")) if o.precheck else F.lit(False)
    rows = records.withColumn("low_in", low)
    body = F.when(~F.col("low_in"), F.col("content"))
    todo = rows.select(*keep, "source", known.alias("framework_in"), body.alias("content_in"), "low_in")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*keep).schema.fields)
    done = spread(todo).mapInArrow(_stage(o, ask, extractor), f"{fields}, {RESULT}" if fields else RESULT)
    state = F.when(F.array_contains("steps", SKIPPED), SKIPPED).when(F.col("report").isNull(), "failed").when(F.col("report.passed"), "passed").otherwise("manual_review")
    return done.withColumn("status", state)
