"""Job boards as tables: what a provider sent, as JSON, XML, Markdown or HTML, becomes the common columns.

Fetching is not part of this library: payloads are columns of a table, however they got there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.functions import text
from sievery.functions.url import provider as provider_of
from sievery.functions.values import first_value

FIELDS = ("external_id", "title", "location", "apply_url", "source_url", "description", "job_type", "posted_at", "department")
#: Where the payload of a provider has its list of jobs, and each field of a job, the first path with a value.
PROVIDERS: dict[str, tuple[tuple[str, ...], dict[str, tuple[str, ...]]]] = {
    "greenhouse": (("$.jobs",), {"external_id": ("$.id",), "title": ("$.title",), "location": ("$.location.name", "$.offices[0].name"), "apply_url": ("$.absolute_url",), "source_url": ("$.absolute_url",), "description": ("$.content",), "posted_at": ("$.first_published", "$.updated_at"), "department": ("$.departments[0].name",)}),
    "lever": (("$",), {"external_id": ("$.id",), "title": ("$.text",), "location": ("$.categories.location",), "apply_url": ("$.applyUrl", "$.hostedUrl"), "source_url": ("$.hostedUrl",), "description": ("$.descriptionPlain", "$.description"), "job_type": ("$.categories.commitment",), "posted_at": ("$.createdAt",), "department": ("$.categories.team", "$.categories.department")}),
    "ashby": (("$.jobs", "$.data.jobBoard.jobPostings"), {"external_id": ("$.id",), "title": ("$.title",), "location": ("$.location", "$.locationName"), "apply_url": ("$.applyUrl", "$.jobUrl"), "source_url": ("$.jobUrl",), "description": ("$.descriptionPlain", "$.descriptionHtml"), "job_type": ("$.employmentType",), "posted_at": ("$.publishedAt",), "department": ("$.department", "$.team")}),
    "bamboohr": (("$.result",), {"external_id": ("$.id",), "title": ("$.jobOpeningName",), "location": ("$.location.city", "$.atsLocation.city"), "job_type": ("$.employmentStatusLabel",), "department": ("$.departmentLabel",)}),
    "recruitee": (("$.offers",), {"external_id": ("$.id",), "title": ("$.title",), "location": ("$.location", "$.city"), "apply_url": ("$.careers_apply_url", "$.careers_url"), "source_url": ("$.careers_url",), "description": ("$.description",), "job_type": ("$.employment_type_code",), "posted_at": ("$.published_at", "$.created_at"), "department": ("$.department",)}),
    "smartrecruiters": (("$.content",), {"external_id": ("$.id",), "title": ("$.name",), "location": ("$.location.fullLocation", "$.location.city"), "source_url": ("$.ref",), "job_type": ("$.typeOfEmployment.label",), "posted_at": ("$.releasedDate",), "department": ("$.department.label",)}),
    "paylocity": (("$.Jobs", "$.jobs"), {"external_id": ("$.JobId",), "title": ("$.JobTitle",), "location": ("$.LocationName", "$.JobLocation.Name"), "description": ("$.Description",), "posted_at": ("$.PublishedDate",), "department": ("$.HiringDepartment",)}),
    "careerpuck": (("$.jobs",), {"external_id": ("$.id",), "title": ("$.title",), "location": ("$.location",), "apply_url": ("$.applyUrl",), "source_url": ("$.publicUrl",), "description": ("$.content",), "posted_at": ("$.postedAt",), "department": ("$.departments[0].name",)}),
    "trakstar": (("$.results", "$.jobs"), {"external_id": ("$.id",), "title": ("$.title",), "location": ("$.location.city", "$.location"), "apply_url": ("$.hosted_url",), "source_url": ("$.hosted_url",), "description": ("$.description",), "posted_at": ("$.created_date",), "department": ("$.team",)}),
}


def json_items(payload: Column, *paths: str) -> Column:
    """Elements of the first of the paths that is a list, each as JSON."""
    lists = [F.from_json(F.get_json_object(payload, p) if p != "$" else payload, "array<string>") for p in paths]
    return F.coalesce(*lists, F.array().cast("array<string>"))


def from_json_provider(df: DataFrame, name: str, payload: str = "payload") -> DataFrame:
    """A row for each job in the payloads of one provider; what isn't JSON has none."""
    roots, fields = PROVIDERS[name]
    items = df.withColumn("_job", F.explode(json_items(F.col(payload), *roots)))
    value = lambda f: first_value(*[F.get_json_object("_job", p) for p in fields[f]]) if f in fields else F.lit(None).cast("string")
    kept = [c for c in df.columns if c != payload and c not in FIELDS]
    return items.select(*kept, F.lit(name).alias("provider"), *[value(f).alias(f) for f in FIELDS], F.col("_job").alias("raw_payload"))


def embedded_assignment(html: Column, variable: str) -> Column:
    """The JSON that a script assigns to a variable of the window."""
    return F.regexp_extract(html, rf"(?s)window\.{variable}\s*=\s*(\{{.*?\}}|\[.*?\])\s*;?\s*</script>", 1)


def markdown_rows(df: DataFrame, markdown: str = "payload", columns: int = 7) -> DataFrame:
    """Cells of the pipe tables in a Markdown text, without header and rule: a row for each line of enough cells."""
    lines = df.select("*", F.posexplode(F.split(markdown, "\n")).alias("line", "_text"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("_text"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")))
    rows = lines.withColumn("cells", cells).withColumn("link", F.regexp_extract("_text", r"\]\((https?://[^)\s]+)\)", 1))
    rule = F.forall("cells", lambda c: c.rlike("^:?-*:?$"))
    header = F.lower(F.get("cells", F.lit(0))).isin("title", "job", "position")
    return rows.where(F.col("_text").contains("|") & (F.size("cells") >= columns) & ~rule & ~header).drop("_text", markdown)


def rss_items(df: DataFrame, xml: str = "payload") -> DataFrame:
    """Title, link, date and description of the items of RSS feeds; CDATA is unwrapped."""
    items = df.withColumn("_item", F.explode(F.regexp_extract_all(xml, F.lit("(?s)<item[^>]*>(.*?)</item>"), F.lit(1))))

    def tag(name: str) -> Column:
        raw = F.regexp_extract("_item", f"(?s)<{name}[^>]*>(.*?)</{name}>", 1)
        return F.trim(text.decode_entities(F.regexp_replace(raw, r"^\s*<!\[CDATA\[|\]\]>\s*$", "")))

    return items.select(*[c for c in df.columns if c != xml], tag("title").alias("title"), tag("link").alias("source_url"), tag("pubDate").alias("posted_at"), tag("description").alias("description"))


def json_ld(df: DataFrame, html: str = "html", kind: str = "JobPosting") -> DataFrame:
    """Objects of a kind in the JSON-LD scripts of pages: single objects, lists and graphs."""
    scripts = F.explode(F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1)))
    found = df.withColumn("_script", scripts)
    one = F.array(F.col("_script"))
    listed = F.from_json("_script", "array<string>")
    graph = F.from_json(F.get_json_object("_script", "$.@graph"), "array<string>")
    objects = found.withColumn("object", F.explode(F.coalesce(F.when(F.ltrim("_script").startswith("["), listed), graph, one)))
    of_kind = objects.where(F.get_json_object("object", "$.@type") == kind)
    at = lambda p: F.get_json_object("object", p)
    return of_kind.select(
        *[c for c in df.columns if c != html],
        at("$.identifier.value").alias("external_id"),
        at("$.title").alias("title"),
        at("$.hiringOrganization.name").alias("organization"),
        at("$.jobLocation.address.addressLocality").alias("location"),
        at("$.datePosted").alias("posted_at"),
        at("$.validThrough").alias("expires_at"),
        at("$.url").alias("source_url"),
        text.strip_html(at("$.description")).alias("description"),
    )


def embedded_objects(df: DataFrame, html: str = "html", wanted: tuple[str, ...] = ("title", "url")) -> DataFrame:
    """Objects with all the wanted fields, anywhere in JSON inside scripts. Balanced brackets aren't regular: a vectorised UDF."""

    @F.pandas_udf("array<string>")
    def find(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import json
        import re

        decoder = json.JSONDecoder()

        def objects(page):
            out = []
            for script in re.findall(r"(?is)<script[^>]*>(.*?)</script>", page or ""):
                at = 0
                while (m := re.compile(r"[\[{]").search(script, at)) is not None:
                    try:
                        value, at = decoder.raw_decode(script, m.start())
                    except ValueError:
                        at = m.end()
                        continue
                    stack = [value]
                    while stack:
                        v = stack.pop()
                        if isinstance(v, dict):
                            if all(v.get(k) for k in wanted):
                                out.append(json.dumps(v, ensure_ascii=False))
                            stack.extend(reversed(v.values()))
                        elif isinstance(v, list):
                            stack.extend(reversed(v))
            return out

        for s in series:
            yield s.map(objects)

    return df.withColumn("object", F.explode(find(html))).drop(html)


def anchors(df: DataFrame, html: str = "html") -> DataFrame:
    """Links of pages with their text, one row for each different anchor of a page, whatever its quotes and case."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)(<a\b[^>]*?\bhref\s*=\s*(?:{text.VALUE[1:-1]})[^>]*>.*?</a>)"), F.lit(1))
    rows = df.select(*[c for c in df.columns if c != html], F.posexplode(F.array_distinct(found)).alias("position", "_a"))
    return rows.withColumns({"href": text.attribute(F.col("_a"), "a", "href"), "label": text.normalize_whitespace(text.decode_entities(text.strip_tags(F.col("_a"))))}).drop("_a")


def dispatched(df: DataFrame, url: str = "url", payload: str = "payload") -> DataFrame:
    """Rows of payloads from many providers, told apart by their address and each mapped in its way, in one pass.

    A payload of another provider, or one without jobs, keeps its row: the fields are null and ``raw_payload`` has it whole.
    """
    name = provider_of(F.col(url))
    lists, paths = F.array().cast("array<string>"), {f: F.lit(None).cast("string") for f in FIELDS}
    for provider, (roots, fields) in PROVIDERS.items():
        lists = F.when(F.col("_provider") == provider, json_items(F.col(payload), *roots)).otherwise(lists)
        for f in fields:
            paths[f] = F.when(F.col("_provider") == provider, first_value(*[F.get_json_object("_job", p) for p in fields[f]])).otherwise(paths[f])
    items = df.withColumn("_provider", name).withColumn("_job", F.explode_outer(lists))
    kept = [c for c in df.columns if c != payload and c not in FIELDS]
    return items.select(*kept, F.col("_provider").alias("provider"), *[paths[f].alias(f) for f in FIELDS], F.coalesce("_job", payload).alias("raw_payload"))
