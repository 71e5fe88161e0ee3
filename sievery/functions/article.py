"""Column builders for articles: excerpts, quotes, contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievery.functions.text import decode_entities, normalize_whitespace
from sievery.functions.values import let

# What an excerpt must not open with or hold.
OPENINGS = r"(?i)^(?:share|subscribe|thanks for reading|found this useful|sign up|read more)\b"
PROMOTION = r"(?i)substack|utm_|action=share|type your email|collective power starts|weekly strategy"


def plain(html: Column) -> Column:
    return normalize_whitespace(decode_entities(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " ")))


def truncate_at_word(x: Column, most: int = 170) -> Column:
    """At most ``most`` characters and an ellipsis, cut at a space if one lies beyond three fifths."""
    clipped = F.regexp_extract(F.substring(x, 1, most + 1), "(?s)^(.*) [^ ]*$", 1)
    cut = F.when(F.length(clipped) > int(most * 0.6), clipped).otherwise(F.substring(x, 1, most))
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.trim(cut), F.lit("…")))


def poor_excerpt(x: Column, title: Column) -> Column:
    """Too short, hardly more than the title, or an appeal to subscribe."""
    low, name = F.lower(x), F.lower(F.coalesce(title, F.lit("")))
    repeats = (name != "") & F.contains(low, name) & (F.length(x) < F.greatest(F.lit(90), F.length(name) + 25))
    return (F.length(x) < 45) | (low == name) | repeats | x.rlike(OPENINGS) | x.rlike(PROMOTION) | (F.size(F.split(x, " ")) < 7)


def paragraphs(html: Column) -> Column:
    found = F.transform(F.regexp_extract_all(html, F.lit("(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), plain)
    return F.filter(found, lambda p: p != "")


def excerpt(description: Column, html: Column, title: Column) -> Column:
    """The first paragraph that says something, else the first, else the body, else the description, cut at a word."""

    def best(found: Column) -> Column:
        good = F.filter(found, lambda p: ~poor_excerpt(p, title))
        options = [F.get(good, F.lit(0)), F.get(found, F.lit(0)), F.nullif(plain(html), F.lit("")), F.nullif(plain(description), F.lit("")), F.lit("")]
        return F.coalesce(*options)

    return let(let(F.coalesce(paragraphs(html), F.array().cast("array<string>")), best), lambda x: truncate_at_word(x))


def first_sentence(x: Column) -> Column:
    """The first 40 to 260 characters that end a sentence, else all."""
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(x, r"(.{40,260}?[.!?])(?:\s|$)", 1), F.lit("")), x))


def last_sentence(x: Column) -> Column:
    """The last run of other characters with the ends of a sentence behind it, else all. Read from the end, so that no character is passed twice."""
    found = F.reverse(F.regexp_extract(F.reverse(x), r"^[^.!?]*+([.!?]++[^.!?]++)", 1))
    return F.trim(F.coalesce(F.nullif(F.trim(found), F.lit("")), x))


def pull_quote(html: Column, otherwise: Column) -> Column:
    """The first block quote, else the first 90 to 240 characters of the first paragraph that end a sentence, else its start."""
    quote = F.nullif(plain(F.regexp_extract(html, "(?is)<blockquote>(.*?)</blockquote>", 1)), F.lit(""))

    def of(text: Column) -> Column:
        return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(.{90,240}?[.!?])(?:\s|$)", 1)), F.lit("")), F.trim(F.substring(text, 1, 220)))

    first = F.coalesce(F.nullif(plain(F.regexp_extract(html, "(?is)<p>(.*?)</p>", 1)), F.lit("")), plain(otherwise))
    return F.coalesce(quote, let(first, of))


def contents(html: Column) -> Column:
    """Headings of levels two and three as an array of level and text."""
    found = F.regexp_extract_all(html, F.lit("(?is)(<h[23][^>]*>.*?</h[23]>)"), F.lit(1))
    return F.transform(found, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), plain(h).alias("text")))
