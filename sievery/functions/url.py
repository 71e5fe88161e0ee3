"""Column builders for URLs."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def host(x: Column) -> Column:
    """Lower-case host without ``www.``; empty for what is no http(s) URL."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(x, F.lit("")), "(?i)^https?://([^/?#:]+)", 1)), "^www[.]", "")


def path(x: Column) -> Column:
    return F.regexp_extract(F.coalesce(x, F.lit("")), "(?i)^https?://[^/?#]+([^?#]*)", 1)


def query(x: Column) -> Column:
    return F.regexp_extract(F.coalesce(x, F.lit("")), "^[^?#]*[?]([^#]*)", 1)


def normalize_url(x: Column) -> Column:
    """http(s) only, else empty; host lower-cased, fragment and trailing slashes dropped."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), "#.*$", ""), "/+$", "")
    start = F.lower(F.regexp_extract(kept, "(?i)^(https?://[^/?]+)", 1))
    return F.when(start == "", "").otherwise(F.concat(start, F.regexp_replace(kept, "(?i)^https?://[^/?]+", "")))


def fingerprint_url(x: Column) -> Column:
    """What two addresses of one page share: no scheme, ``www.``, application suffix, query or trailing slash, lower case."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), "(?i)^https?://", "")
    x = F.regexp_replace(x, "^www[.]", "")
    x = F.regexp_replace(x, "(?i)/+(?:apply/autofillWithResume)?(?:/apply)?/?$", "")
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(x, "[?#].*$", ""), "/+$", "")))


#: Providers and what their addresses contain, in the order in which they are tried.
PROVIDERS = (
    ("greenhouse", "greenhouse.io"), ("lever", "lever.co"), ("ashby", "ashbyhq.com"), ("bamboohr", "bamboohr.com"), ("recruitee", "recruitee.com"),
    ("smartrecruiters", "smartrecruiters.com"), ("workable", "workable.com"), ("paylocity", "paylocity.com"), ("rippling", "rippling.com"),
    ("careerpuck", "careerpuck.com"), ("trakstar", "trakstar.com"), ("taleo", "taleo.net"),
)


def provider(x: Column, providers: tuple[tuple[str, str], ...] = PROVIDERS, otherwise: str = "custom") -> Column:
    """The first provider whose mark the address contains."""
    low = F.lower(F.coalesce(x, F.lit("")))
    found = F.lit(None).cast("string")
    for name, mark in providers:
        found = F.coalesce(found, F.when(F.contains(low, F.lit(mark)), name))
    return F.coalesce(found, F.lit(otherwise))


#: Hosts of boards, whose names say nothing of the employer.
BOARDS = "(?i)(?:greenhouse|workable|paylocity|ultipro|smartrecruiters|ashbyhq|bamboohr|recruitee|teamtailor)[.]"


def board_page(x: Column) -> Column:
    """The address of a posting for people, where a board's other form of it is known; else the address as it is."""
    return F.regexp_replace(F.trim(x), "(?i)^https?://apply[.]workable[.]com/([^/]+)/jobs/view/([A-Z0-9]+)/?(?:[?#].*)?$", "https://apply.workable.com/$1/j/$2/")


def organization(x: Column) -> Column:
    """A struct of ``name`` and ``confidence`` that an address tells of an employer: a board's subdomain or first path, else the domain; null if none."""
    slug = lambda s: F.initcap(F.trim(F.regexp_replace(s, "[-_]+", " ")))
    told = lambda s, level: F.when(s != "", F.struct(slug(s).alias("name"), F.lit(level).alias("confidence")))
    own = F.regexp_extract(host(x), "^([a-z0-9-]+)[.]teamtailor[.]com$", 1)
    first = F.regexp_extract(F.coalesce(x, F.lit("")), "(?i)^https?://(?:boards[.]greenhouse[.]io|apply[.]workable[.]com)/([^/?#]+)", 1)
    domain = F.when(host(x).rlike(BOARDS), "").otherwise(F.regexp_extract(host(x), "([^.]+)[.][^.]+$", 1))
    return F.coalesce(told(own, "high"), told(first, "medium"), told(domain, "high"))


def page_type(x: Column) -> Column:
    """Kind of a page by its address: the first rule that matches."""
    p = F.lower(path(x))
    return (
        F.when(host(x) == "", "invalid")
        .when(p.rlike("^/?$"), "home")
        .when(p.rlike("/(?:feed|rss|sitemap)"), "feed")
        .when(p.rlike("/(?:search|tag|category)/"), "listing")
        .when(p.rlike("[.]html?$"), "document")
        .when(p.rlike("/[0-9]+/?$"), "item")
        .otherwise("other")
    )


def is_tracking(x: Column) -> Column:
    return query(x).rlike("(?:^|&)(?:utm_[a-z]+|ref|gclid|fbclid)=")


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` seen from ``base`` by RFC 3986; a vectorised UDF."""

    @F.pandas_udf("string")
    def join(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(b, h):
            try:
                return urljoin(b, h)
            except (ValueError, TypeError):
                return None

        for b, h in parts:
            yield pd.Series([one(x, y) for x, y in zip(b, h, strict=True)], dtype="object")

    return join(base, href)
