"""Text and pay functions over whole tables. Long texts are returned as hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.functions import money, text
from sievery.plans.registry import Registry, Tables

plan = Registry()
QUERIES, SQL = plan.queries, plan.sql

#: Marker words of languages: fixed values.
MARKS = {
    "es": ("el", "los", "una", "por", "para", "que"),
    "fr": ("le", "les", "une", "pour", "avec", "dans"),
    "de": ("der", "die", "und", "ein", "mit", "nicht"),
}
STOP = ("about", "after", "from", "have", "that", "their", "there", "they", "this", "what", "which", "with", "your")
_SPACE = r"[ \t\n\x0B\f\r]+"
_SENTENCES = "list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: trim(x, ' ')), lambda x: length(x) >= {})"


def _md5(x: Column) -> Column:
    return F.md5(x.cast("binary"))


@plan.query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r\x{00A0}\x{FEFF}]+', ' ', 'g'), ' ')) AS clean FROM documents")
def normalize_whitespace(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", _md5(text.normalize_whitespace(F.col("text"))).alias("clean"))


@plan.query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugify(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.slugify(F.col("p_name")).alias("slug"))


@plan.query("SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' ')) AS token FROM documents")
def identity_token(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", _md5(text.identity_token(F.col("text"))).alias("token"))


_STOPPED = ", ".join(f"'{w}'" for w in STOP)


@plan.query(f"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 3 AND x NOT IN ({_STOPPED})) AS l FROM conversations),
u AS (SELECT conv_id, turn, unnest(l) AS word, generate_subscripts(l, 1) AS n FROM w),
f AS (SELECT conv_id, turn, word, min(n) AS n FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) AS place FROM f)
SELECT conv_id, turn, string_agg(word, ',' ORDER BY n) AS tags FROM r WHERE place <= 4 GROUP BY conv_id, turn
""")
def word_tags(t: Tables) -> DataFrame:
    tags = text.word_tags(F.col("text"), STOP)
    return t.conversations.select("conv_id", "turn", F.array_join(tags, ",").alias("tags")).where("tags <> ''")


@plan.query(f"SELECT doc_id, CAST(greatest(2, ceil(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')) / 220.0)) AS INTEGER) AS minutes FROM documents")
def reading_time(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.reading_minutes(F.col("text")).alias("minutes"))


@plan.query("SELECT doc_id, CASE WHEN length(text) <= 160 THEN text ELSE rtrim(substr(text, 1, 159), ' ') || '…' END AS short FROM documents")
def truncate_ellipsis(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.truncate(F.col("text"), 160).alias("short"))


@plan.query("SELECT doc_id, substr(sha1(text), 1, 12) AS hash FROM documents")
def stable_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.stable_hash(F.col("text")).alias("hash"))


@plan.query(f"""
WITH s AS (SELECT doc_id, unnest({_SENTENCES.format(20)}) AS sentence FROM documents)
SELECT doc_id, count(*) AS n_sentences, count(DISTINCT trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g'), ' ')) AS n_kept FROM s GROUP BY doc_id
""")
def sentence_dedupe(t: Tables) -> DataFrame:
    long_ = F.filter(text.sentences(F.col("text")), lambda s: F.length(s) >= 20)
    each = t.documents.select("doc_id", F.explode(long_).alias("sentence"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.countDistinct(text.identity_token(F.col("sentence"))).alias("n_kept"))


@plan.query(f"WITH s AS (SELECT doc_id, list_transform({_SENTENCES.format(24)}, lambda x: lower(x)) AS s FROM documents) SELECT doc_id, CAST(len(s) - len(list_distinct(s)) AS INTEGER) AS repeated FROM s")
def repeated_fragments(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.repeated_fragments(F.col("text")).alias("repeated"))


_MARKED = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(m) for m in marks)}))) AS n_{lang}" for lang, marks in MARKS.items())


@plan.query(rf"""
WITH w AS (SELECT doc_id, string_split(lower(regexp_replace(text, '[ \t\n\x0B\f\r.,;:!?]+', ' ', 'g')), ' ') AS w FROM documents),
n AS (SELECT doc_id, {_MARKED} FROM w)
SELECT doc_id, CASE WHEN greatest(n_es, n_fr, n_de) < 3 THEN 'en' WHEN n_es >= n_fr AND n_es >= n_de THEN 'es' WHEN n_fr >= n_de THEN 'fr' ELSE 'de' END AS guess FROM n
""")
def language_guess(t: Tables) -> DataFrame:
    return t.documents.where(F.col("text").isNotNull()).select("doc_id", text.language_guess(F.col("text"), MARKS).alias("guess"))


@plan.query("SELECT page_id, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages")
def escaped_length(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length(text.escape_html(F.col("html"))).cast("long").alias("escaped"))


def _pay(t: Tables) -> DataFrame:
    """Pay texts of four shapes, made of prices and sizes."""
    price, size, kind = F.col("p_retailprice"), F.col("p_size"), F.col("p_size") % 4
    whole = lambda x: F.floor(x).cast("string")
    said = (
        F.when(kind == 0, F.concat(F.lit("$"), whole(price * 10), F.lit(" - $"), whole(price * 20)))
        .when(kind == 1, F.concat(F.lit("Up to $"), whole(price / 10), F.lit("k")))
        .when(kind == 2, F.concat(F.lit("£"), size.cast("string"), F.lit("/hour")))
        .otherwise("Competitive")
    )
    return t.part.select("p_partkey", said.alias("pay"))


@plan.query("""
WITH p AS (SELECT p_partkey, p_size % 4 AS kind,
    CASE p_size % 4 WHEN 0 THEN floor(p_retailprice * 10) WHEN 2 THEN CAST(p_size AS DOUBLE) END AS low,
    CASE p_size % 4 WHEN 0 THEN floor(p_retailprice * 20) WHEN 1 THEN floor(p_retailprice / 10) * 1000 WHEN 2 THEN CAST(p_size AS DOUBLE) END AS high FROM part)
SELECT p_partkey, low, high, CASE kind WHEN 2 THEN 'GBP' WHEN 3 THEN 'Unknown' ELSE 'USD' END AS currency,
    CASE kind WHEN 2 THEN 'hour' WHEN 3 THEN 'Unknown' ELSE 'year' END AS period, true AS visible,
    CASE kind WHEN 0 THEN '$' || format('{:,}', CAST(low AS BIGINT)) || '–$' || format('{:,}', CAST(high AS BIGINT)) || ' / year'
        WHEN 1 THEN 'Up to $' || format('{:,}', CAST(high AS BIGINT)) || ' / year' WHEN 2 THEN '£' || CAST(CAST(low AS BIGINT) AS VARCHAR) || '/hr' ELSE '' END AS display
FROM p
""")
def parse_salary_range(t: Tables) -> DataFrame:
    parsed = _pay(t).withColumn("r", money.parse_range(F.col("pay"))).select("p_partkey", "r.*")
    return parsed.withColumn("display", money.display(F.col("low"), F.col("high"), F.col("currency"), F.col("period")))
