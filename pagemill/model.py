"""Entities, schemas and the fixed values that define detection, cleaning and scoring."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

CHECK = T.StructType([T.StructField("passed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("detail", T.StringType())])
ACTION = T.StructType([T.StructField("filter_name", T.StringType()), T.StructField("action", T.StringType()), T.StructField("description", T.StringType())])
REPORT = T.StructType(
    [
        T.StructField("passed", T.BooleanType()),
        T.StructField("total_score", T.DoubleType()),
        T.StructField("checks", T.MapType(T.StringType(), CHECK)),
        T.StructField("failed_filter", T.StringType()),
        T.StructField("retry_action", ACTION),
        T.StructField("needs_llm", T.BooleanType()),
        T.StructField("llm_passed", T.BooleanType()),
        T.StructField("llm_reason", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)
PAGE_RECORD = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("canonical_url", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("raw_html_path", T.StringType()),
        T.StructField("raw_md_path", T.StringType()),
        T.StructField("framework", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("quality_report", REPORT),
        T.StructField("source", T.StringType()),
    ]
)
MANIFEST_PAGE = "struct<url:string,http_status:int,content_hash:string,html_file:string,md_file:string,source:string,framework:string,status:string>"
MANIFEST = f"generated_at string, total bigint, pages array<{MANIFEST_PAGE}>"

#: States of a page.
STATUSES = ("pending", "fetched", "cleaned", "passed", "failed", "manual_review", "skipped_low_quality")

#: Fingerprints by framework, in the order that settles ties: (selector, content, score).
FINGERPRINTS: dict[str, tuple[tuple[str, str | None, int], ...]] = {
    "gitbook": (('meta[name="generator"]', "gitbook", 3), ("div[class*='group/codeblock']", None, 2), ("script#_R_", None, 1)),
    "kubernetes": (("main[data-pagefind-body]", None, 3), (".td-content", None, 2)),
    "mkdocs-material": (('meta[name="generator"]', "mkdocs", 3), (".md-content", None, 2), (".md-nav", None, 1)),
    "mkdocs": (('meta[name="generator"]', "mkdocs", 3), (".wy-nav-content", None, 2)),
    "docusaurus": (('meta[name="generator"]', "docusaurus", 3), ("#__docusaurus", None, 3), (".theme-doc-markdown", None, 2)),
    "sphinx": ((".rst-content", None, 2), ('div[role="navigation"].sphinxsidebar', None, 2), (".documentwrapper", None, 1)),
}
SCORE_THRESHOLD = 4


@dataclass(frozen=True)
class Profile:
    """How pages of one framework are cleaned."""

    name: str
    main_selector: str = ""
    remove_selectors: tuple[str, ...] = ()
    boilerplate_phrases: tuple[str, ...] = ()
    markdown_suffixes: tuple[str, ...] = ()
    markdown_strip_headings: tuple[str, ...] = ()

    def with_(self, **changes) -> Profile:
        return replace(self, **changes)


#: Profiles.
PROFILES: dict[str, Profile] = {
    p.name: p
    for p in (
        Profile("mkdocs-material", ".md-content", (".md-nav", ".md-header", ".md-footer"), ("Edit this page", "Was this page helpful?", "Last update:", "Copyright")),
        Profile("mkdocs", ".wy-nav-content", (".wy-nav-side", ".wy-breadcrumbs"), ("Edit on GitHub", "Copyright")),
        Profile("docusaurus", ".theme-doc-markdown, article", (".theme-doc-sidebar-container", ".theme-doc-footer"), ("Edit this page", "Was this helpful?", "Last updated")),
        Profile("sphinx", ".documentwrapper .section, .body", (".sphinxsidebar", ".related", ".footer"), ("Edit on GitHub", "Copyright")),
        Profile(
            "kubernetes",
            "main[data-pagefind-body], .td-content",
            ("nav", ".navbar", "footer", ".footer", ".portal-button"),
            ("Was this page helpful?", "Thanks for the feedback", "Last modified", "Open an issue in the GitHub Repository"),
        ),
        Profile(
            "gitbook",
            "main, article",
            ("nav", "header", "footer", "aside", ".breadcrumb", "[aria-label='breadcrumb']", "div.sr-only"),
            ("For the complete documentation index", "Last updated", "Previous", "Next", "Edit this page", "Was this helpful?"),
            (".md",),
            ("Agent Instructions",),
        ),
        Profile(
            "generic",
            "main, article, .content, #content, .documentation",
            ("nav", ".nav", ".sidebar", "#fern-sidebar", "header", "footer", ".breadcrumb", "[aria-label='breadcrumb']"),
            ("Was this useful?", "Was this helpful?", "Was this page helpful?", "Open issue", "Edit this page", "Last modified", "Feedback"),
        ),
    )
}


def profile(name: str | None) -> Profile:
    """The profile of a framework; the generic one where it is unknown."""
    return PROFILES.get(name or "", PROFILES["generic"])


#: Noise phrases and limits of the quality checks.
NOISE_PHRASES = (
    "Edit this page", "Was this page helpful?", "Was this helpful?", "Last update:", "Last updated", "Copyright", "All rights reserved", "Suggest an edit",
    "Suggest edits", "Report an issue", "Report issues", "On this page", "反馈", "编辑此页", "此页面有帮助吗？",
)
LINK_DENSITY, LINKS_PER_1K = 0.15, 8.0
MIN_LENGTH, THRESHOLD, GRAY_LOW, GRAY_HIGH = 500, 0.6, 0.3, 0.8

#: Retry strategies.
WIDE_SELECTOR = "main, article, .content, #content, .documentation, body"
FALLBACK_PHRASES = ("Feedback", "Was this", "Edit this", "Last modified", "Thanks for")

#: Navigation containers by priority, cap of their HTML and links of the fallback.
NAV_SELECTORS = (
    ".td-sidebar", "#td-sidebar", ".sidebar", "#sidebar", ".navigation", "#navigation", "nav.sidebar", "nav.docs-sidebar",
    ".docs-sidebar", ".menu", "#menu", "aside", 'nav[role="navigation"]', ".md-nav", ".wy-nav-side", ".theme-doc-sidebar-container",
)
NAV_CAP, NAV_LINKS = 50_000, 5
LLM_CAP = 8_000
MIN_MARKDOWN_BYTES = 200


@dataclass
class LLMConfig:
    """Endpoint of a language model; the key comes from the environment first."""

    base_url: str = ""
    api_key: str = ""
    model: str = ""
    temperature: float = 0.1
    max_tokens: int = 4096
    timeout: float = 120.0

    def key(self, variable: str = "PAGEMILL_LLM_API_KEY") -> str:
        return os.environ.get(variable) or self.api_key or ""


@dataclass
class SiteConfig:
    base_url: str
    allow_patterns: list[str] = field(default_factory=list)
    deny_patterns: list[str] = field(default_factory=list)
    crawl_delay: float = 1.0
    max_concurrency: int = 4
    user_agent: str = ""
    respect_robots: bool = True
    force_render: bool = False


@dataclass
class Options:
    """Engine options; the limits of the gray zone reach the evaluation."""

    store_dir: str = "store"
    output_dir: str = "out"
    max_retries: int = 2
    min_length: int = MIN_LENGTH
    threshold: float = THRESHOLD
    gray_low: float = GRAY_LOW
    gray_high: float = GRAY_HIGH
    precheck: bool = True
    llm: LLMConfig | None = None


@dataclass
class AppConfig:
    options: Options = field(default_factory=Options)
    sites: dict[str, SiteConfig] = field(default_factory=dict)
