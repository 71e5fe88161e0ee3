"""Column builders for free text and HTML. All are lazy, null-safe (null in, null out unless said otherwise) and JVM-side."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "[\\s\\u00A0\\uFEFF]+"


def normalize_whitespace(x: Column) -> Column:
    """No-break spaces are spaces, runs become one, ends are trimmed."""
    return F.trim(F.regexp_replace(x, SPACES, " "))


def slugify(x: Column) -> Column:
    """Lower case, everything but ASCII letters and digits to single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slugify_unicode(x: Column) -> Column:
    """As ``slugify`` after decomposing accented letters. A vectorised UDF, for Spark has no normalisation function."""

    @F.pandas_udf("string")
    def fold(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    return slugify(fold(strip_tags(x)))


def identity_token(x: Column) -> Column:
    """The one token form for identity comparisons: lower case, words of letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def compact_token(x: Column) -> Column:
    """Only the lower-case ASCII letters and digits that the text has; capitals go, as where archives were keyed so."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[^a-z0-9]", "")


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"))


def decode_entities(x: Column) -> Column:
    """Named entities; ampersands last, so that nothing is decoded twice."""
    for name, value in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(value))
    return x


def decode_numeric_entities(x: Column) -> Column:
    """Decimal and hexadecimal character references; those that name no character are left."""

    @F.pandas_udf("string")
    def decode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re

        def char(m):
            point = int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])
            return chr(point) if 0 < point < 0x110000 and not 0xD800 <= point < 0xE000 else m[0]

        for s in series:
            yield s.str.replace(r"&#(x[0-9a-fA-F]{1,6}|X[0-9a-fA-F]{1,6}|[0-9]{1,7});", lambda m: char(m), regex=True, flags=re.ASCII)

    return decode(x)


def escape_html(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]*>", "")


def strip_html(x: Column) -> Column:
    """Visible text: scripts, styles and comments go, block ends become sentence breaks, other tags spaces, entities characters."""
    x = F.regexp_replace(x, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    x = F.regexp_replace(x, "(?i)<br[ ]*/?>|</(?:p|div|li|h[1-6]|tr|ul|ol)>", ". ")
    x = decode_entities(F.regexp_replace(x, "<[^>]*>", " "))
    return F.regexp_replace(normalize_whitespace(x), "(?:[ ]*[.]){2,}", ".")


def structured_text(html: Column) -> Column:
    """HTML as lines: headings, list items with bullets, paragraphs; navigation, headers and footers dropped."""
    x = F.regexp_replace(html, "(?is)<(?:script|style|nav|header|footer)[^>]*>.*?</(?:script|style|nav|header|footer)>|<!--.*?-->", " ")
    x = F.regexp_replace(x, "(?i)<li[^>]*>", "\n- ")
    x = F.regexp_replace(x, "(?i)<h[1-6][^>]*>|</?(?:p|div|ul|ol|tr|br|h[1-6]|article|section)[^>]*>", "\n")
    x = decode_entities(F.regexp_replace(x, "<[^>]*>", " "))
    x = F.regexp_replace(x, "[ \\t\\u00A0]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, " ?\n ?", "\n"), "\n{3,}", "\n\n"))


def truncate(x: Column, length: int) -> Column:
    """At most ``length`` characters, the last an ellipsis where something is cut."""
    return F.when(F.length(x) <= length, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, length - 1)), F.lit("…")))


def words(x: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(x, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " "), " "), "")


def word_tags(x: Column, stop: tuple[str, ...], most: int = 4) -> Column:
    """The first few distinct words of more than three letters that aren't stop words."""
    w = F.filter(F.split(F.lower(x), "[^a-z]+"), lambda t: (F.length(t) > 3) & ~t.isin(*stop))
    return F.slice(F.array_distinct(w), 1, most)


def reading_minutes(x: Column, pace: int = 220) -> Column:
    return F.greatest(F.lit(2), F.ceil(F.size(words(x)) / F.lit(pace))).cast("int")


def sentences(x: Column) -> Column:
    """Sentences between full stops, exclamation and question marks and line ends, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(x, "[.!?\\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def distinct_sentences(x: Column, shortest: int = 20) -> Column:
    """Sentences of at least ``shortest`` characters, the first of those that agree as identity tokens."""
    long_ = F.filter(sentences(x), lambda s: F.length(s) >= shortest)
    tokens = F.transform(long_, identity_token)
    return F.filter(long_, lambda s, i: F.array_position(tokens, identity_token(s)) == i + 1)


def repeated_fragments(x: Column, shortest: int = 24) -> Column:
    """How many long sentences repeat an earlier one."""
    s = F.transform(F.filter(sentences(x), lambda t: F.length(t) >= shortest), lambda t: F.lower(t))
    return F.size(s) - F.size(F.array_distinct(s))


def collapse_repeats(x: Column) -> Column:
    """A phrase of up to a few words that directly repeats is said once."""
    return F.regexp_replace(x, "(?i)\\b(\\w+(?: \\w+){0,3})(?: \\1\\b)+", "$1")


def count_matches(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def hits(x: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur in the lower-cased text, as substrings."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))


def language_guess(x: Column, marks: dict[str, tuple[str, ...]], least: int = 3) -> Column:
    """The language with the most marker words, at least ``least``; ties go to the first; else ``en``."""
    low = F.concat(F.lit(" "), F.lower(F.regexp_replace(x, "[\\s.,;:!?]+", " ")), F.lit(" "))
    scores = [sum((F.regexp_count(low, F.lit(f" {w}(?= )")) for w in terms), F.lit(0)).alias(lang) for lang, terms in marks.items()]
    counted = F.array(*[F.struct(s.alias("n"), F.lit(-i).alias("turn"), F.lit(lang).alias("lang")) for i, (s, lang) in enumerate(zip(scores, marks, strict=True))])
    best = F.array_max(counted)
    return F.when(best["n"] >= least, best["lang"]).otherwise("en")


def snippet(x: Column, most: int = 220, shortest: int = 25) -> Column:
    """The first sentence long enough to say something, cut to length; else the start of the text."""
    strong = F.filter(sentences(normalize_whitespace(x)), lambda s: F.length(s) >= shortest)
    return truncate(F.coalesce(F.get(strong, F.lit(0)), normalize_whitespace(x)), most)


def stable_hash(x: Column) -> Column:
    return F.substring(F.sha1(x.cast("binary")), 1, 12)


def first_tag(html: Column, tag: str) -> Column:
    """Text of the first element of a kind, or the empty text."""
    return normalize_whitespace(decode_entities(strip_tags(F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))))


#: A value in double, single or no quotes.
VALUE = "(\"[^\"]+\"|'[^']+'|[^\\s\"'>]+)"


def attribute(html: Column, tag: str, name: str) -> Column:
    """An attribute of the first element of a kind that has it, or the empty text; in any quotes and case."""
    return F.regexp_replace(F.regexp_extract(html, f"(?i)<{tag}\\b[^>]*?\\b{name}\\s*=\\s*{VALUE}", 1), "^[\"']|[\"']$", "")


def links(html: Column) -> Column:
    """Targets of anchors, in order, the first of equal ones; in double, single or no quotes, in any case."""
    quoted = F.regexp_extract_all(html, F.lit(f"(?i)<a\\b[^>]*?\\bhref\\s*=\\s*{VALUE}"), F.lit(1))
    return F.array_distinct(F.transform(quoted, lambda t: F.regexp_replace(t, "^[\"']|[\"']$", "")))


def title_case_keep(x: Column) -> Column:
    """Words with a capital first letter; the case of the rest is kept, unlike ``initcap``."""
    return F.array_join(F.transform(F.split(x, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def fix_parentheses(x: Column) -> Column:
    """Drop parentheses that have no partner. Balance is not regular, hence the vectorised UDF."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        open_, drop = [], set()
        for i, c in enumerate(text):
            if c == "(":
                open_.append(i)
            elif c == ")":
                if open_:
                    open_.pop()
                else:
                    drop.add(i)
        drop.update(open_)
        return "".join(c for i, c in enumerate(text) if i not in drop)

    @F.pandas_udf("string")
    def fix(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield s.map(one)

    return fix(x)
