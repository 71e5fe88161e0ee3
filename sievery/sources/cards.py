"""Postings on pages that list them as cards: an HTML tree walk, one page to many rows, and columns that judge what it found."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.functions import fields, pay, url
from sievery.functions.text import normalize_whitespace
from sievery.functions.values import first_value

BLOCKS = frozenset({"li", "tr", "article", "section", "div"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "strong", "b"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
SILENT = frozenset({"script", "style", "template", "noscript"})
#: Elements that stand within a line; what others hold is on lines of its own.
INLINE = frozenset({"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "em", "font", "i", "kbd", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"})

# What a card of a posting speaks of, and calls to click that are no title.
CARD_WORDS = r"(?i)apply|job|career|opening|position|department|team|location|remote"
CALLS = r"(?i)\b(?:apply now|learn more|view role|read more|see details|job details)\b"
PLACES = r"(?i)\b(?:remote within [a-z]{2}|united states|usa|u\.s\.)\b"
URL_WORDS = r"(?i)\b(remote|usa|us|ca|ny|dc|az|tx|fl)\b"
POSTING = r"(?i)/(?:jobs?|careers?|positions?|openings?|opportunit(?:y|ies)|postings?|vacanc(?:y|ies)|roles?|apply|o|j)/[^/?#]+|[?&](?:gh_jid|jobid|job_id|lever-source)="
TITLE_MOST = 90

LINKS = "href string, label string, heading string, card string, position int"


class _Walk(HTMLParser):
    """Anchors of a page, each with the text of the block around it. A block that is left without an end tag ends with its parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = [{"tag": "", "text": [], "heading": "", "links": []}]
        self.found: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self._say("\n" if tag in ("br", "hr") else " ")
            return
        if tag in ("li", "tr"):
            # One item ends where the next begins.
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i]["tag"] in ("ul", "ol", "table", "tbody"):
                    break
                if self.open[i]["tag"] == tag:
                    while len(self.open) > i:
                        self._close()
                    break
        node = {"tag": tag, "text": [], "heading": "", "links": []}
        if tag == "a":
            href = next((v for k, v in attrs if k == "href" and v), None)
            if href and href.strip():
                node["href"] = href.strip()
        self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i]["tag"] == tag:
                while len(self.open) > i:
                    self._close()
                return

    def handle_data(self, data: str) -> None:
        if not any(n["tag"] in SILENT for n in self.open):
            self._say(data)

    def _say(self, data: str) -> None:
        self.open[-1]["text"].append(data)

    def _close(self) -> None:
        node, parent = self.open.pop(), self.open[-1]
        raw = "".join(node["text"])
        said = "\n".join(line for line in (" ".join(part.split()) for part in raw.splitlines()) if line)
        if "href" in node:
            link = {"href": node["href"], "label": " ".join(said.split()), "heading": "", "card": None, "position": len(self.found)}
            self.found.append(link)
            parent["links"].append(link)
        if node["tag"] in HEADINGS and not node["heading"]:
            node["heading"] = " ".join(said.split())
        if node["tag"] in BLOCKS:
            # The innermost block that says more than the link itself is its card.
            for link in node["links"]:
                if link["card"] is None and (" ".join(said.split()) != link["label"] or node["tag"] in ("li", "tr", "article")):
                    link["card"], link["heading"] = said, node["heading"]
        parent["links"].extend(link for link in node["links"] if link["card"] is None)
        parent["heading"] = parent["heading"] or node["heading"]
        parent["text"].append(raw if node["tag"] in INLINE else f"\n{said}\n")

    def done(self) -> list[dict]:
        self.close()
        while len(self.open) > 1:
            self._close()
        return self.found


def links_of(html: str | None) -> list[tuple[str, str, str, str | None, int]]:
    """href, label, heading and lines of the card (null without one), and place of each anchor of a page, in the order in which anchors end."""
    walk = _Walk()
    walk.feed(re.sub(r"<[^<>]*$", "", html or ""))  # a tag that the end of the page cuts off says nothing
    return [(x["href"], x["label"], x["heading"], x["card"], x["position"]) for x in walk.done()]


@F.udtf(returnType=LINKS, useArrow=True)
class page_links:  # noqa: N801
    """``links_of`` as a table function: one page to a row for each anchor."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from links_of(html)


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows of pages with each of their anchors: href, label, heading, card and position. Null and empty pages have none."""
    found = pages.lateralJoin(page_links(F.col(html).outer()))
    return found.drop(html)


def clean(title: Column) -> Column:
    """A label without calls to click, country names and marks at its ends."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), CALLS, " "), PLACES, " ")
    return normalize_whitespace(F.regexp_replace(normalize_whitespace(x), r"^[/|\-:\s]+|[/|\-:\s]+$", ""))


def title_of_url(address: Column) -> Column:
    """The last part of a path as words."""
    words = F.regexp_replace(F.regexp_replace(F.regexp_extract(address, r"^[^?#]*?/([^/?#]+)/?(?:[?#].*)?$", 1), "[-_]+", " "), URL_WORDS, " ")
    return clean(F.initcap(normalize_whitespace(words)))


def location_of(card: Column) -> Column:
    """The kind of workplace that a card names, else the place behind a label, else a town with its state."""
    named = F.regexp_extract(card, r"\b(?i:location|based in|office|city) *:? *([A-Z][A-Za-z.'-]*(?: [A-Z][A-Za-z.'-]*)*(?:,\s*[A-Z]{2}\b)?)", 1)
    town = F.regexp_extract(card, r"\b([A-Z][A-Za-z.'-]*(?: [A-Z][A-Za-z.'-]*)*,\s*[A-Z]{2})\b", 1)
    return F.coalesce(first_value(F.regexp_extract(card, r"(?i)\b(remote|hybrid|on-site|onsite)\b", 1), named, town), F.lit(""))


def department_of(card: Column) -> Column:
    return normalize_whitespace(F.regexp_extract(card, r"(?i)\b(?:department|team|function) *: *([A-Za-z0-9 /&-]{3,80})", 1))


def postings(pages: DataFrame, page_url: str = "url", html: str = "html") -> DataFrame:
    """Postings that pages link to, with what their cards say: title, apply_url, location, department, pay text and its source.

    Links whose address is that of no posting are left out. The title is the first of label, heading, address and card
    that can be one, else the first that says anything; a page's equal title and address count once. Fields that ``pages``
    has beside its address and text are kept.
    """
    kept = [c for c in pages.columns if c not in (page_url, html)]
    rows = links(pages.select(*kept, F.col(page_url).alias("page_url"), html), html)
    rows = rows.withColumn("apply_url", url.absolute_url(F.col("page_url"), F.col("href")))
    rows = rows.where(F.col("apply_url").rlike("(?i)^https?://") & F.col("apply_url").rlike(POSTING))
    card = F.coalesce("card", "label")
    rows = rows.withColumns({"said": card, "spoken": F.coalesce(F.col("card").rlike(CARD_WORDS), F.lit(False))})
    options = [clean(F.col("label")), clean(F.when(F.col("spoken"), F.col("heading"))), title_of_url(F.col("apply_url")), clean(F.col("said"))]
    able = lambda x: (x != "") & (F.length(x) <= TITLE_MOST) & ~fields.no_title(x, F.lit(""), F.lit(""))
    steps = rows.withColumns({f"_t{i}": o for i, o in enumerate(options)})
    named = [F.col(f"_t{i}") for i in range(len(options))]
    title = F.coalesce(*[F.when(able(x), x) for x in named], first_value(*named), F.lit(""))
    out = steps.withColumn("title", title).where("title <> ''").withColumn("found", pay.extracted([], F.col("said")))
    first = out.groupBy(*kept, "page_url", F.lower("title").alias("_title"), F.lower("apply_url").alias("_url")).agg(
        F.min_by(F.struct("title", "apply_url", location_of(F.col("said")).alias("location"), department_of(F.col("said")).alias("department"), F.col("found.text").alias("pay"), F.col("found.source").alias("pay_source"), F.col("said").alias("description")), "position").alias("first")
    )
    return first.select(*kept, "page_url", "first.*")
