"""Column builders for pay given as text. Amounts are whole numbers, as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievery.functions.text import normalize_whitespace
from sievery.functions.values import let

# Places, amounts, currencies and periods.
CANADA = "(?i)\\b(?:canada|ontario|quebec|toronto|vancouver|montreal|ottawa|calgary|edmonton|british columbia|alberta|manitoba|saskatchewan|nova scotia)\\b"
BRITAIN = "(?i)\\b(?:uk|united kingdom|england|london|scotland|wales|northern ireland|manchester|birmingham|glasgow|edinburgh)\\b"
EURO_AREA = "(?i)\\b(?:eu|european union|europe|austria|belgium|finland|france|germany|greece|ireland|italy|netherlands|portugal|spain|berlin|paris|madrid|dublin|lisbon|brussels|vienna|rome)\\b"
AMOUNT = "(?:USD|CAD|EUR|GBP|US\\$|CA\\$|[$€£]|C\\$)?\\s*([0-9][0-9,]*\\.?[0-9]*)\\s*([kKmM]?)"
MARKED = "(?i)(?:USD|CAD|EUR|GBP|US\\$|CA\\$|C\\$|[$€£])\\s*[0-9][0-9,]"
NAMED = (("CAD", "(?i)\\bCAD\\b|CA\\$"), ("USD", "(?i)\\bUSD\\b|US\\$"), ("EUR", "(?i)\\bEUR\\b|€"), ("GBP", "(?i)\\bGBP\\b|£"))
PLACED = (("CAD", CANADA), ("GBP", BRITAIN), ("EUR", EURO_AREA))
WITHHELD = "(?i)\\b(?:salary not listed|compensation not listed|pay not listed|salary unavailable|compensation unavailable|not disclosed|undisclosed)\\b"
VAGUE = "(?i)\\b(?:competitive|commensurate|depending on experience|doe)\\b"
AT_MOST = "(?i)\\b(?:up to|maximum|max\\.?)\\b"
AT_LEAST = "(?i)\\b(?:starting at|starts at|from|minimum|min\\.?)\\b|\\+$"
SPLIT = "\\b[0-9]{1,3}\\s+[0-9]{3}\\b"
PERIODS = (
    ("hour", "per hour|/\\s*hour|/\\s*hr|\\bhourly\\b"),
    ("day", "per day|/\\s*day|\\bdaily\\b"),
    ("week", "per week|/\\s*week|\\bweekly\\b"),
    ("month", "per month|/\\s*month|/\\s*mo\\b|\\bmonthly\\b|\\bmo\\b"),
    ("year", "per year|/\\s*year|/\\s*yr|\\bannual\\b|\\byearly\\b|\\ba year\\b|annually|per annum"),
)


def currency(pay: Column, location: Column | None = None) -> Column:
    """Code of the currency that the text names, else the one of the place, else Unknown; a dollar is Canadian in Canada only."""
    place = F.coalesce(location, F.lit("")) if location is not None else F.lit("")
    code = F.when(F.coalesce(normalize_whitespace(pay), F.lit("")) == "", "Unknown")
    for name, pattern in NAMED:
        code = code.when(pay.rlike(pattern), name)
    code = code.when(pay.rlike("\\$"), F.when(place.rlike(CANADA), "CAD").otherwise("USD"))
    for name, pattern in PLACED:
        code = code.when(place.rlike(pattern), name)
    return code.otherwise("Unknown")


def period(pay: Column) -> Column:
    low, found = F.lower(F.coalesce(pay, F.lit(""))), F.lit(None).cast("string")
    for name, pattern in PERIODS:
        found = F.coalesce(found, F.when(low.rlike(pattern), name))
    return F.coalesce(found, F.lit("Unknown"))


def _prepared(pay: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(pay, "[–—]", "-"), "(?i)\\bto\\b", "-")
    return normalize_whitespace(F.regexp_replace(F.regexp_replace(x, "(?<=[0-9])\\+(?=[^0-9]|$)", ""), "\\(\\*\\)|\\*", ""))


def amounts(pay: Column) -> Column:
    """All amounts, rounded, thousands and millions expanded."""
    x = _prepared(pay)
    numbers, suffixes = F.regexp_extract_all(x, F.lit(AMOUNT), F.lit(1)), F.regexp_extract_all(x, F.lit(AMOUNT), F.lit(2))

    def value(n: Column, s: Column) -> Column:
        scale = F.when(F.lower(s) == "k", 1000.0).when(F.lower(s) == "m", 1000000.0).otherwise(1.0)
        return F.floor(F.regexp_replace(n, ",", "").try_cast("double") * scale + 0.5).cast("double")

    return F.filter(F.zip_with(numbers, suffixes, value), lambda a: a.isNotNull())


def parse_range(pay: Column, location: Column | None = None) -> Column:
    """Pay as a struct: low, high, currency, period, visible.

    Two amounts or more are a range of the first two; one amount is both ends, unless the text says "up to" or "from".
    An hourly rate of 5,000 or more is taken for a yearly one. Text that withholds pay, or is malformed, is not visible
    and has no amounts; text that only praises it is visible, without amounts.
    """
    none = F.lit(None).cast("double")

    def shaped(text: Column, found: Column) -> Column:
        named = period(text)
        withheld = text.rlike(WITHHELD) | (malformed(text) != "")
        vague = text.rlike(VAGUE) & ~text.rlike(MARKED)
        usable = (text != "") & ~withheld & ~vague & (F.size(found) > 0)
        many, first, second = F.size(found) > 1, F.get(found, F.lit(0)), F.get(found, F.lit(1))
        at_most, at_least = text.rlike(AT_MOST), text.rlike(AT_LEAST)
        large = F.exists(found, lambda a: a >= 1000) | _prepared(text).rlike("[kKmM]")
        guessed = let(named, lambda n: F.when(n == "Unknown", F.when(large, "year").otherwise("Unknown")).when((n == "hour") & F.exists(found, lambda a: a >= 5000), "year").otherwise(n))

        def ends(usable: Column) -> Column:
            return F.struct(
                F.when(usable, F.when(many, F.least(first, second)).when(at_most, none).otherwise(first)).alias("low"),
                F.when(usable, F.when(many, F.greatest(first, second)).when(at_most, first).when(at_least, none).otherwise(first)).alias("high"),
                currency(text, location).alias("currency"),
                F.when(usable, guessed).otherwise(named).alias("period"),
                (usable | ((text != "") & ~withheld & vague)).alias("visible"),
            )

        return let(usable, ends)

    return let(normalize_whitespace(F.coalesce(pay, F.lit(""))), lambda text: let(amounts(text), lambda found: shaped(text, found)))


def display(low: Column, high: Column, code: Column, unit: Column) -> Column:
    """``$80,000–$100,000 / year``; empty where neither end is known."""
    sign = F.when(code == "USD", "$").when(code == "CAD", "CA$").when(code == "EUR", "€").when(code == "GBP", "£").otherwise("")
    suffix = F.when(unit == "Unknown", "").when(unit == "hour", "/hr").otherwise(F.concat(F.lit(" / "), unit))
    amount = lambda x: F.concat(sign, F.format_number(x, 0))
    body = (
        F.when(low.isNull() & high.isNull(), None)
        .when(low.isNull(), F.concat(F.lit("Up to "), amount(high)))
        .when(high.isNull(), F.concat(F.lit("From "), amount(low)))
        .when(low == high, amount(low))
        .otherwise(F.concat(amount(low), F.lit("–"), amount(high)))
    )
    return F.coalesce(F.concat(body, suffix), F.lit(""))


def pattern_of(pay: Column) -> Column:
    """The shape of a pay text: runs of digits, commas and points as #."""
    return F.regexp_replace(pay, "[0-9,.]+", "#")


def malformed(pay: Column) -> Column:
    """Why a pay text cannot be meant, or the empty text: amounts that a space has split, or a range with zeros for an end."""
    text = normalize_whitespace(F.coalesce(pay, F.lit("")))
    named = text.rlike("[€$£]|usd|cad|eur|gbp") | text.rlike("(?i)(?:range|salary|compensation|pay).*(?:-|–|—|to)")
    halves = text.rlike("(?i)salary\\s+0{2,}\\s*-\\s*\\$[0-9]") | text.rlike("\\$[0-9]{1,3}\\s+[0-9]{3}\\s*-\\s*\\$[0-9]{1,3}\\s+[0-9]{3}")
    return F.when(text.rlike(SPLIT) & ~named, "malformed_split_salary_fragment").when(halves, "malformed_salary_range").otherwise("")


def suspicious_downgrade(old_low: Column, old_high: Column, new_high: Column, new_period: Column) -> Column:
    """A yearly amount or a range that would be replaced by a tiny monthly one."""
    yearly = (F.coalesce(old_high, old_low) >= 10000) | (old_low != old_high)
    return F.coalesce(yearly & (new_period == "month") & (new_high < 1000), F.lit(False))
