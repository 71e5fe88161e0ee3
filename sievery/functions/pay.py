"""Column builders that find pay in prose: windows around markers, the best statement, a ladder over fields, and what speaks against it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievery.functions.text import normalize_whitespace, strip_html
from sievery.functions.values import let

# Markers, contexts, and what only looks like pay.
MARKERS = ("$", "salary", "salary range", "compensation", "compensation range", "pay range", "annual salary", "base salary", "hourly", "per hour", "usd", "cad", "gbp", "eur")
CONTEXT = r"(?i)\b(?:salary|compensation|pay|comp range|annual|annually|yearly|hourly|per hour|per year|per month|base)\b"
NOT_PAY = (
    ("looks_like_year", r"^[$]? *(?:19|20)[0-9]{2} *$"),
    ("looks_like_percentage", r"\b[0-9]{1,3} *%"),
    ("looks_like_coordinate", r"(?i)\bPOINT *\(|\b(?:lat(?:itude)?|lng) *:? *[-.0-9]+\b"),
    ("looks_like_ats_field", r"(?i)\b(?:job id|requisition id|req id|posting id|tracking id|reference id) *:? *#?[0-9]{3,}\b"),
    ("looks_like_id", r"(?i)\bid *:? *#?[0-9]{5,}\b"),
    ("looks_like_timestamp", r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"),
)
OTHER_PAYING = r"(?i)\b(?:people|customers?|residents?|households?) +pay\b|\bpay +for +(?:utility|utilities|bills?|electricity|energy|rent)\b|\butility +bills?\b|\bposted +(?:on|in) +[0-9]{4}\b"
WITHHELD = r"(?i)\b(?:(?:salary|compensation|pay) (?:not listed|unavailable)|competitive (?:salary|compensation)|not disclosed|undisclosed)\b"
PROSE_CONTEXTS = ("position description", "position details", "description", "salary", "pay", "compensation", "hiring range")
HIGHEST = 500_000

#: Parts of a statement of pay.
SIGN = r"(?:USD|CAD|EUR|GBP|US\$|CA\$|C\$|[$€£])"
NUMBER = r"[0-9][0-9,]*(?:[.][0-9]+)?(?: ?[kKmM]\b)?"
UNIT = r"(?: ?(?:/ ?(?:hour|hr|day|week|month|mo|year|yr)\b|(?:per|a|an) (?:hour|day|week|month|year)\b|hourly|daily|weekly|monthly|yearly|annually|annual))?"
JOINT = r" ?(?:-|–|—|to) ?"
MARKED = rf"{SIGN} ?{NUMBER}{UNIT}"
ANY = rf"(?:{SIGN} ?)?{NUMBER}{UNIT}"
LABEL = r"(?:(?:expected |full |annual |base )*(?:salary|compensation|pay|hiring) range|(?:annual |base |listed )?(?:salary|compensation)|pay|wage|rate|stipend|this role pays)"
#: Statements, the surest first.
STATEMENTS = (
    rf"(?i)\b{LABEL}[^.0-9]{{0,120}}?(?<![0-9]){MARKED}(?:{JOINT}{ANY})?",
    rf"(?i)\b(?:starting at|starts at|from|up to) {MARKED}",
    rf"(?i){MARKED}{JOINT}{ANY}",
    rf"(?i){MARKED}",
    rf"(?i)\b{LABEL}[^.0-9]{{0,80}}?(?<![0-9])(?:[0-9]{{2,3}},[0-9]{{3}}|[0-9]{{5,6}}|[0-9]{{2,3}} ?k\b)(?:{JOINT}{NUMBER})?{UNIT}",
    WITHHELD,
)
ELSEWHERE = rf"(?i)the annual salary for candidates based in .{{1,200}}?(?::|is) ?[$€£]? ?({NUMBER})(?:{JOINT}[$€£]? ?({NUMBER}))?"


def windows(text: Column, before: int = 160, after: int = 240, markers: Iterable[str] = MARKERS) -> Column:
    """The surroundings of each marker in the text, each once: ``before`` characters ahead of its start to ``after`` behind it."""

    def around(clean: Column, marker: Column) -> Column:
        # Lengths of the pieces between markers give their places.
        size = F.length(marker)
        pieces = F.transform(F.split(F.lower(clean), F.concat(F.lit("\\Q"), marker, F.lit("\\E"))), lambda p: F.length(p))
        ends = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array(F.lit(0)), lambda at, n: F.array_append(at, F.element_at(at, -1) + n + size))
        starts = F.transform(F.slice(ends, F.lit(2), F.size(pieces) - 1), lambda p: p - size)
        return F.transform(starts, lambda p: F.substring(clean, F.greatest(p - before, F.lit(0)) + 1, p + after - F.greatest(p - before, F.lit(0))))

    named = F.array(*map(F.lit, markers))

    def all_of(clean: Column) -> Column:
        there = let(F.lower(clean), lambda low: F.filter(named, lambda m: F.contains(low, m)))
        return F.array_distinct(F.flatten(F.transform(there, lambda m: around(clean, m))))

    return let(normalize_whitespace(F.coalesce(text, F.lit(""))), all_of)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, or between a full stop and a capital letter or dollar sign."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n{2,}|(?<=[.])\s+(?=[A-Z$])")
    return F.filter(F.transform(parts, normalize_whitespace), lambda p: p != "")


def in_context(text: Column) -> Column:
    """Whether the text speaks of pay, and of nobody else's."""
    wrong = text.rlike(OTHER_PAYING)
    for _, pattern in NOT_PAY[1:5]:
        wrong = wrong | text.rlike(pattern)
    return text.rlike(CONTEXT) & ~wrong


def _stated(text: Column) -> Column:
    options = [F.nullif(F.trim(F.regexp_extract(text, p, 0)), F.lit("")) for p in STATEMENTS]
    return F.coalesce(*options)


def best_statement(text: Column) -> Column:
    """The surest statement of pay: the last paragraphs first, then any that speak of pay, then windows, then the whole; empty if none."""

    def first(parts: Column) -> Column:
        return F.get(F.filter(F.transform(parts, _stated), lambda s: s.isNotNull()), F.lit(0))

    # Windows are made only of texts whose paragraphs state nothing.
    def found(clean: Column) -> Column:
        return F.coalesce(first(F.reverse(F.filter(paragraphs(clean), in_context))), first(F.filter(windows(clean), in_context)), _stated(normalize_whitespace(clean)), F.lit(""))

    return let(strip_html(F.coalesce(text, F.lit(""))), found)


def by_location(text: Column) -> Column:
    """A struct of ``low`` and ``high`` over all places for which the text gives a salary, and ``places``, their number; null if there is none."""
    number = lambda s: F.regexp_replace(F.regexp_extract(s, "[0-9][0-9,.]*", 0), ",", "").try_cast("double")

    def all_of(clean: Column) -> Column:
        lows, highs = (F.transform(F.regexp_extract_all(clean, F.lit(ELSEWHERE), F.lit(i)), number) for i in (1, 2))
        return F.zip_with(lows, highs, lambda a, b: F.struct(a.alias("low"), F.coalesce(b, a).alias("high")))

    def ends(ranges: Column) -> Column:
        low, high = F.array_min(F.transform(ranges, lambda r: r["low"])), F.array_max(F.transform(ranges, lambda r: r["high"]))
        return F.when(F.size(ranges) > 0, F.struct(low.alias("low"), high.alias("high"), F.size(ranges).alias("places")))

    return let(let(normalize_whitespace(F.coalesce(text, F.lit(""))), all_of), ends)


def extracted(fields: list[tuple[str, Column]], body: Column) -> Column:
    """A struct of ``text``, ``source`` and ``confidence``: the first field with pay, else salaries by place, else the best statement of the body."""
    told = lambda text, source, sure: F.struct(text.alias("text"), F.lit(source).alias("source"), sure.alias("confidence"))
    amount = lambda x: F.concat(F.lit("$"), F.format_number(x, 0))

    def stated(text: Column) -> Column:
        sure = text.rlike(rf"{SIGN}.*[0-9].*(?:-|–|—|to).*[0-9]") | (text.rlike(SIGN) & text.rlike("(?i)hour|day|week|month|year|annual"))
        return F.when(text != "", told(text, "description_body", F.when(sure, "high").when(in_context(text), "medium").otherwise("low")))

    explicit = [F.when(normalize_whitespace(F.coalesce(c, F.lit(""))) != "", told(normalize_whitespace(c), name, F.lit("high"))) for name, c in fields]
    placed = let(by_location(body), lambda p: F.when(p.isNotNull(), told(F.concat(amount(p["low"]), F.lit(" - "), amount(p["high"])), "multi_location_salary", F.lit("high"))))
    return F.coalesce(*explicit, placed, let(best_statement(body), stated), told(F.lit(""), "none", F.lit("none")))


def rejection(text: Column, low: Column, high: Column, prose: Column) -> Column:
    """Why a statement of pay is not believed: what it looks like, no context without plausible amounts, or amounts that are too high; empty if it is."""
    reason = F.when(F.coalesce(text, F.lit("")) == "", "")
    for name, pattern in NOT_PAY:
        reason = reason.when(text.rlike(pattern), name)
    plausible = F.coalesce((low > 0) & (low <= HIGHEST), F.lit(False)) | F.coalesce((high > 0) & (high <= HIGHEST), F.lit(False))
    around = F.lower(F.concat_ws(" ", prose, text))
    known = F.lit(False)
    for c in PROSE_CONTEXTS:
        known = known | F.contains(around, F.lit(c))
    too_high = F.coalesce(F.greatest(low, high) > HIGHEST, F.lit(False))
    return reason.when(~known & ~plausible, "missing_pay_context").when(too_high, "exceeds_max_threshold_500k").otherwise("")


def state(salary: Column, raw: Column, warning: Column) -> Column:
    """clean, absent_allowed, or uncertain_blocked where pay was seen but not understood."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.when(filled(warning) | (filled(raw) & ~filled(salary)), "uncertain_blocked").when(filled(salary), "clean").otherwise("absent_allowed")
