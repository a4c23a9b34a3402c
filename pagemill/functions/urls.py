"""URL functions as Column expressions; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import PROFILES

#: Fixed value: scheme, authority, path and query of any reference.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    authority = F.regexp_replace(F.regexp_extract(url, PARTS, 2), r"^.*@", "")
    return F.lower(F.regexp_replace(authority, r":\d*\z", ""))


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, PARTS, 3), r";[^/]*\z", "")


def normalize(url: Column) -> Column:
    """Scheme (https by default) and host in lower case, no fragment, user, port or closing slashes; the query stays."""
    p = F.regexp_replace(path(url), r"/+\z", "")
    s, q = scheme(url), F.regexp_extract(url, PARTS, 4)
    return F.concat(
        F.when(s == "", F.lit("https")).otherwise(s), F.lit("://"), host(url), F.when(p == "", F.lit("/")).otherwise(p), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))
    )


def absolute(url: Column, base: Column) -> Column:
    """Resolve a reference against a base: absolute, host-relative, path-relative; dot segments are left."""
    b_scheme, b_host = F.regexp_extract(base, PARTS, 1), F.regexp_extract(base, PARTS, 2)
    root = F.concat(b_scheme, F.lit("://"), b_host)
    folder = F.regexp_replace(F.regexp_extract(base, PARTS, 3), r"[^/]*\z", "")
    return (
        F.when(url.isNull() | (url == ""), base)
        .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(b_scheme, F.lit(":"), url))
        .when(url.startswith("/"), F.concat(root, url))
        .when(url.startswith("#") | url.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), url))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), url))
    )


def site(url: Column) -> Column:
    """Top folder of a page's output: its host, or site."""
    h = host(url)
    return F.when(h == "", F.lit("site")).otherwise(h)


def allowed(url: Column, allow: Column, deny: Column) -> Column:
    """Denied patterns win; without allow patterns everything else is allowed. Null lists count as empty."""
    none = F.array().cast("array<string>")
    a, d = F.coalesce(allow, none), F.coalesce(deny, none)
    return ~F.exists(d, lambda p: F.regexp_like(url, p)) & ((F.size(a) == 0) | F.exists(a, lambda p: F.regexp_like(url, p)))


def bare(url: Column) -> Column:
    """A page's address without the suffix of its Markdown endpoint."""
    return F.regexp_replace(url, r"\.md\z", "")


def markdown_endpoint(url: Column, suffixes: Column) -> Column:
    """The address of native Markdown by the first suffix of the profile; null where it has none."""
    first = F.try_element_at(suffixes, F.lit(1))
    return F.when(first.isNull(), F.lit(None).cast("string")).when(F.endswith(url, first), url).otherwise(F.concat(url, first))


def framework(url: Column) -> Column:
    """Framework of native Markdown by the ending of its address."""
    p = F.substring_index(F.substring_index(url, "?", 1), "#", 1)
    out = F.when(~url.rlike(r"^https?://"), F.lit("generic"))
    for x in PROFILES.values():
        for suffix in x.markdown_suffixes:
            out = out.when(p.endswith(suffix), F.lit(x.name))
    return F.coalesce(out.otherwise(F.lit("generic")), F.lit("generic"))


def store_name(url: Column, suffix: str) -> Column:
    """File name of a stored page: sixteen digits of the digest of its address."""
    return F.concat(F.substring(F.sha2(url, 256), 1, 16), F.lit(suffix))


def output_path(root: str, site_name: Column, url: Column) -> Column:
    """Where a page's Markdown goes; the suffix of an endpoint is cut, a folder becomes its index. Queries do not count."""
    p = path(url)
    cut = F.regexp_replace(p, r"/+\z", "")
    named = F.when(cut.endswith(".html"), F.regexp_replace(cut, r"\.html\z", "")).when(cut.endswith(".md"), F.regexp_replace(cut, r"\.md\z", "")).when(p.endswith("/"), F.concat(cut, F.lit("/index"))).otherwise(cut)
    file = F.when((p == "") | (p == "/"), F.lit("index.md")).otherwise(F.concat(F.regexp_replace(named, r"^/+", ""), F.lit(".md")))
    return F.concat(F.lit(root + "/"), site_name, F.lit("/"), file)


#: Fixed value: attributes that say nothing about navigation.
NAV_ATTRIBUTES = r"(?i)[^\S\n]+(class|style|data-\w+|tabindex|aria-\w+)(=\"[^\"\n]*\")?"


def strip_attributes(html: Column) -> Column:
    return F.regexp_replace(html, NAV_ATTRIBUTES, "")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)
