"""Column builders that score a canonical record: content, parser confidence, readiness to be shown, and weight for editors.

A record is given as a mapping of field names to columns; a field that a table lacks is the empty text.
"""

from __future__ import annotations

from collections import UserDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.functions import fields
from sievery.functions.text import normalize_whitespace
from sievery.functions.values import clamp, confidence, let, reasons

# What marks text as taken from feeds, markup or navigation.
JUNK = (
    r"(?i)\bprevious\b",
    r"(?i)\bnext post\b",
    r"(?i)\bviewBox\b",
    r"(?i)\b0\/svg\b",
    r"(?i)<span\b",
    r"(?i)\bPOINT\s*\(",
    r"(?i)\blocality\b",
    r"(?i)\bTitle Business(?: Platform Location Date)?\b",
    r"(?i)\bcareer_page\b",
    r"(?i)\bBusiness\/Productivity Software\b",
    r"(?i)\bCleantech\b",
    r"(?i)\bOil\s*&\s*Gas\b",
    r"(?i)\bsee current openings\b",
    r"(?i)\bheaders?\b\s*(?:\x22\s*)+",
    r"(?i)\b(?:taxonomy|headquarters|employee size|funding)\b",
    r"(?i)\b(?:annual\s+)?revenue\s*(?::|:?\s*[\$€£]|:?\s*\d{2,})",
    r"\b\d{7,10}\b",
    r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    r"(?i)\bBusiness and Industrial\b",
    r"(?i)\bElectrical Distribution\b",
    r"(?i)\bIndustrial Automation\b",
    r"(?i)\bPower Generation\b",
    r"(?i)\bRenewable Energy & Environment\b",
    r"(?i)\bCleantech & Environment\b",
    r"(?i)<\?xml\b",
    r"(?i)<rss\b",
    r"(?i)<feed\b",
    r"(?i)<svg\b",
)
OPENING = r"^(?:[)\]},.;:|]|and |or |the will |the is )"
VERBS = r"(?i)[a-z]{3,} +(?:is|are|will|can|should|must|plans|coordinates|executes|supports|manages|builds|seeks|works|develops|leads|drives|partners|optimizes)\b"
MACHINE_URLS = (r"(?i)[.](?:json|xml|rss|atom|md)(?:[?#].*)?$", r"(?i)[?&](?:output|format)=(?:json|xml|rss|atom)\b", r"(?i)/(?:api|feeds?|rss|atom)(?:/|$)")
BOARD_SEARCH = r"(?i)jobs[.]workable[.]com/search"
BOARD_APPLY = r"(?i)^https?://apply[.]workable[.]com/[^/]+/j/[A-Z0-9]+/?(?:[?#].*)?$"
MISSION = ((8, r"\bclimate\b"), (5, r"\b(?:environmental|sustainab)"), (12, r"\b(?:democracy|voting|civic|public interest)"), (7, r"\b(?:policy|advocacy|campaign)"))


class Fields(UserDict):
    """Columns of a record by name; unknown names are the empty text."""

    def __missing__(self, name: str) -> Column:
        return F.lit("")


def of(df: DataFrame) -> Fields:
    """The texts of a table, nulls as empty and white space normalised."""
    return Fields({c: normalize_whitespace(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns})


def web_url(x: Column) -> Column:
    return x.rlike("(?i)^https?://") & ~x.rlike(MACHINE_URLS[0]) & ~x.rlike(MACHINE_URLS[2])


def apply_url(x: Column) -> Column:
    """An address where a person can apply: no feed, interface or search page."""
    board = ~x.rlike("(?i)apply[.]workable[.]com") | x.rlike(BOARD_APPLY)
    return web_url(x) & ~x.rlike(MACHINE_URLS[1]) & ~x.rlike(BOARD_SEARCH) & board


def junk(x: Column) -> Column:
    return fields.any_of(x, JUNK)


#: Fields that the scores below read.
SCORED = ("title", "title_confidence", "organization", "location", "workplace_type", "description", "description_snippet", "raw_description", "salary", "pay_parse_warning", "parse_warning", "apply_url", "source_url", "original_url", "specialization", "specialization_confidence", "source")


def _made_once(job: Fields, body: Callable[[Fields], Column]) -> Column:
    """``body`` of the fields, each of which is normalised once, however often the body names it."""
    return let(F.struct(*[job[x].alias(x) for x in SCORED]), lambda r: body(Fields({x: r[x] for x in SCORED})))


def _usable(description: Column, title: Column, organization: Column, is_junk: Column) -> Column:
    said = F.lower(description)
    return description.rlike("[A-Za-z]{3,}") & ~is_junk & (said != F.lower(title)) & (said != F.lower(organization)) & ~description.rlike(r"^[>\"'< |/\\-]+$")


def usable_description(description: Column, title: Column, organization: Column) -> Column:
    """Text of words that is neither junk nor only the title or the company."""
    return _usable(description, title, organization, junk(description))


def _content(job: Fields, junk_text: Column, junk_raw: Column) -> Column:
    text, snippet = job["description"], job["description_snippet"]
    mentions = F.when(job["organization"] == "", 0).otherwise((F.length(text) - F.length(F.replace(F.lower(text), F.lower(job["organization"]), F.lit("")))) / F.greatest(F.length(job["organization"]), F.lit(1)))
    cases = (
        (45, text == ""),
        (10, (text != "") & (F.length(text) < 140)),
        (30, F.lower(text).rlike(OPENING) | F.lower(snippet).rlike(OPENING)),
        (30, junk_text | junk(snippet)),
        (12, junk_raw),
        (10, mentions >= 3),
        (10, ~text.rlike(VERBS)),
        (6, (job["salary"] == "") & (job["pay_parse_warning"] != "")),
        (8, job["parse_warning"] != ""),
    )
    return clamp(F.lit(100) - sum((F.when(c, n).otherwise(0) for n, c in cases), F.lit(0)))


def content_quality(job: Fields) -> Column:
    """100 less what is wrong with the description."""
    return _made_once(job, lambda job: _content(job, junk(job["description"]), junk(job["raw_description"])))


def _facts(job: Fields) -> Column:
    """A struct of what several scores ask of a record, so that each is found out once."""
    apply_to = F.coalesce(F.nullif(job["apply_url"], F.lit("")), job["original_url"])
    source = F.coalesce(F.nullif(job["source_url"], F.lit("")), job["original_url"])
    return F.struct(junk(job["description"]).alias("junk_text"), junk(job["raw_description"]).alias("junk_raw"), fields.valid_location(job["location"]).alias("placed"), apply_url(apply_to).alias("applies"), web_url(source).alias("from_web"), apply_to.alias("apply_to"), source.alias("source"))


def _parsed(job: Fields, facts: Column, usable: Column) -> Column:
    title = F.when(job["title_confidence"] == "high", 25).when(job["title_confidence"] == "medium", 16).when(job["title_confidence"] == "low", 4).otherwise(0)
    # Where no source is known, the address to apply at stands for it.
    from_web = F.when(facts["source"] != "", facts["from_web"]).otherwise(web_url(job["apply_url"]))
    cases = (
        (20, usable),
        (10, ~facts["junk_text"] & ~facts["junk_raw"]),
        (15, facts["applies"]),
        (8, from_web),
        (6, facts["placed"]),
        (4, job["workplace_type"] != ""),
        (4, job["specialization"] != ""),
        (4, job["specialization_confidence"] == "high"),
        (8, (job["salary"] != "") & (job["pay_parse_warning"] == "")),
        (-6, (job["salary"] != "") & (job["pay_parse_warning"] != "")),
        (-20, junk(job["title"]) | junk(job["location"])),
        (-20, (job["title"] == "") | (job["organization"] == "")),
    )
    return clamp(title + sum((F.when(c, n).otherwise(0) for n, c in cases), F.lit(0)) + F.floor(_content(job, facts["junk_text"], facts["junk_raw"]) * 0.12 + 0.5))


def _judged(job: Fields, body: Callable[[Fields, Column, Column, Column], Column]) -> Column:
    """``body`` of the fields, the facts, whether the description is usable, and the confidence of the parser."""

    def scored(job: Fields, facts: Column) -> Column:
        usable = _usable(job["description"], job["title"], job["organization"], facts["junk_text"])
        return let(usable, lambda usable: let(_parsed(job, facts, usable), lambda score: body(job, facts, usable, score)))

    return _made_once(job, lambda job: let(_facts(job), lambda facts: scored(job, facts)))


def parser_confidence(job: Fields) -> Column:
    """How far the parsed fields can be trusted, 0 to 100."""
    return _judged(job, lambda job, facts, usable, score: score)


def readiness(job: Fields, threshold: int = 70) -> Column:
    """A struct of ``ready``, ``reasons`` against it, ``score`` and ``confidence``."""

    def against(job: Fields, facts: Column, usable: Column, score: Column) -> Column:
        board = F.lower(F.concat_ws(" ", job["source"], facts["apply_to"], facts["source"])).contains("workable")
        return reasons(
            ("missing_title", job["title"] == ""),
            ("missing_organization", job["organization"] == ""),
            ("low_title_confidence", job["title_confidence"] == "low"),
            ("description_not_usable", ~usable),
            ("junk_content_detected", facts["junk_text"] | facts["junk_raw"]),
            ("invalid_location", ~facts["placed"]),
            ("invalid_source_url", ~facts["from_web"]),
            ("workable_no_human_apply_page", ~facts["applies"] & board),
            ("invalid_apply_url", ~facts["applies"] & ~board),
            ("pay_uncertain", job["pay_parse_warning"] != ""),
            ("parser_confidence_below_public_threshold", score < threshold),
        )

    def told(*known) -> Column:
        score = known[-1]
        return let(against(*known), lambda found: F.struct((F.size(found) == 0).alias("ready"), found.alias("reasons"), score.alias("score"), confidence(score).alias("confidence")))

    return _judged(job, told)


def mission_score(text: Column, categories: tuple[str, ...] = (), organizations: str | None = None) -> Column:
    """How near a record is to the mission, up to 100: known categories and organisations, and topics."""
    low = F.lower(text)
    score = sum((F.when(low.rlike(p), n).otherwise(0) for n, p in MISSION), F.lit(0))
    if categories:
        score = score + F.when(F.exists(F.array(*map(F.lit, categories)), lambda c: F.contains(low, c)), 15).otherwise(0)
    if organizations is not None:
        score = score + F.when(low.rlike(organizations), 25).otherwise(0)
    return F.least(score, F.lit(100)).cast("long")


def editorial_score(text: Column, relevance: Column, mission: Column) -> Column:
    """Half the mission and the relevance, and a little for seniority, pay and flexible work."""
    low = F.lower(text)
    small = ((3, r"\b(?:director|vice president|vp|head of|chief)\b"), (2, r"\b(?:salary|compensation|pay|usd|gbp|eur)\b"), (1, r"\b(?:remote|hybrid)\b"))
    score = mission * 0.5 + sum((F.when(low.rlike(p), n).otherwise(0) for n, p in small), F.lit(0)) + F.coalesce(relevance, F.lit(0)) * 0.5
    return F.floor(score * 10 + 0.5) / 10
