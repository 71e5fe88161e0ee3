"""Scores and decisions on records, each with its reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievery.functions import taxonomy, text
from sievery.functions.values import confidence, reasons
from sievery.plans.registry import Registry, Tables

plan = Registry()
QUERIES, SQL = plan.queries, plan.sql

#: Terms that make a text relevant, and terms that make it less so: fixed values.
WANTED = ("data", "policy", "public", "research", "water", "school")
UNWANTED = ("click here", "buy now", "casino")
#: Ordered rules of fields of work: fixed values.
FIELDS = (("data", "data|number|statistic"), ("people", "people|team|friend"), ("places", "city|house|river|school"))


def _hits(terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{t}') AS INTEGER)" for t in terms) + ")"


_SCORED = f"""
s AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic, {_hits(WANTED)} AS good, {_hits(UNWANTED)} AS bad FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT *, CAST(good * 3 - bad * 4 + CASE WHEN n_chars >= 500 THEN 5 ELSE 0 END + CASE WHEN quality = 1 THEN 4 ELSE 0 END - CASE WHEN toxic = 1 THEN 9 ELSE 0 END AS BIGINT) AS score FROM s)
"""


def _scored(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left")
    good, bad = text.hits(F.col("text"), WANTED), text.hits(F.col("text"), UNWANTED)
    s = d.select("doc_id", "source", "lang", "n_chars", "quality", "toxic", good.alias("good"), bad.alias("bad"))
    flag = lambda c, n: F.when(c, n).otherwise(0)
    score = F.col("good") * 3 - F.col("bad") * 4 + flag(F.col("n_chars") >= 500, 5) + flag(F.col("quality") == 1, 4) - flag(F.col("toxic") == 1, 9)
    return s.withColumn("score", score.cast("long"))


@plan.query(f"""
WITH {_SCORED}
SELECT doc_id, score, concat_ws(',', CASE WHEN good > 0 THEN 'term_hits' END, CASE WHEN bad > 0 THEN 'spam_terms' END, CASE WHEN n_chars >= 500 THEN 'long' END, CASE WHEN quality = 1 THEN 'reviewed' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS reasons FROM r
""")
def relevance_score(t: Tables) -> DataFrame:
    why = reasons(("term_hits", F.col("good") > 0), ("spam_terms", F.col("bad") > 0), ("long", F.col("n_chars") >= 500), ("reviewed", F.col("quality") == 1), ("toxic", F.col("toxic") == 1))
    return _scored(t).select("doc_id", "score", F.array_join(why, ",").alias("reasons"))


@plan.query(f"""
WITH {_SCORED}
SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected_noise' WHEN bad > 0 THEN 'rejected_noise' WHEN n_chars < 100 THEN 'needs_cleanup' WHEN quality = 0 THEN 'needs_cleanup' WHEN score >= 8 THEN 'review_ready' ELSE 'needs_cleanup' END AS bucket,
    CASE WHEN toxic = 1 THEN 'toxic' WHEN bad > 0 THEN 'spam_terms' WHEN n_chars < 100 THEN 'too_short' WHEN quality = 0 THEN 'low_quality' WHEN score >= 8 THEN 'relevant' ELSE 'low_score' END AS reason
FROM r
""")
def triage_bucket(t: Tables) -> DataFrame:
    """Bucket and reason from the first rule that holds."""
    pair = lambda bucket, reason: F.struct(F.lit(bucket).alias("bucket"), F.lit(reason).alias("reason"))
    decided = (
        F.when(F.col("toxic") == 1, pair("rejected_noise", "toxic"))
        .when(F.col("bad") > 0, pair("rejected_noise", "spam_terms"))
        .when(F.col("n_chars") < 100, pair("needs_cleanup", "too_short"))
        .when(F.col("quality") == 0, pair("needs_cleanup", "low_quality"))
        .when(F.col("score") >= 8, pair("review_ready", "relevant"))
        .otherwise(pair("needs_cleanup", "low_score"))
    )
    return _scored(t).withColumn("t", decided).select("doc_id", "t.*")


_FACTORS = """
c AS (SELECT md5(text) AS h, count(*) AS copies FROM documents GROUP BY 1),
b AS (SELECT source, count(*) AS volume FROM documents GROUP BY source),
f AS (SELECT d.doc_id, least(100, d.n_chars // 20) AS description, CASE WHEN d.lang = 'en' THEN 100 ELSE 60 END AS language, CASE WHEN l.quality = 1 THEN 100 WHEN l.quality = 0 THEN 20 ELSE 60 END AS review,
    CASE WHEN l.toxic = 1 THEN 0 ELSE 100 END AS safety, CASE WHEN c.copies > 1 THEN 0 ELSE 100 END AS uniqueness, CASE WHEN b.volume >= 100 THEN 80 ELSE 50 END AS trust, CASE WHEN d.n_chars BETWEEN 200 AND 20000 THEN 100 ELSE 40 END AS length
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN c ON md5(d.text) = c.h LEFT JOIN b ON d.source = b.source),
q AS (SELECT *, CAST(floor((description * 25 + language * 15 + review * 20 + (safety + uniqueness + trust + length) * 10 + 50) / 100.0) AS BIGINT) AS score FROM f)
"""


def _factors(t: Tables) -> DataFrame:
    """Seven factors of 0 to 100 and their weighted sum; weights in hundredths: 25, 15, 20 and four times 10."""
    d = t.documents.select("doc_id", "source", "lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("h"))
    copies = d.where(F.col("h").isNotNull()).groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    volume = d.groupBy("source").agg(F.count(F.lit(1)).alias("volume"))
    j = d.join(t.labels, "doc_id", "left").join(copies, "h", "left").join(volume, "source", "left")
    either = lambda c, a, b: F.when(c, a).otherwise(b)
    f = j.select(
        "doc_id",
        F.least(F.lit(100), F.floor(F.col("n_chars") / 20)).alias("description"),
        either(F.col("lang") == "en", 100, 60).alias("language"),
        F.when(F.col("quality") == 1, 100).when(F.col("quality") == 0, 20).otherwise(60).alias("review"),
        either(F.col("toxic") == 1, 0, 100).alias("safety"),
        either(F.col("copies") > 1, 0, 100).alias("uniqueness"),
        either(F.col("volume") >= 100, 80, 50).alias("trust"),
        either(F.col("n_chars").between(200, 20000), 100, 40).alias("length"),
    )
    total = F.col("description") * 25 + F.col("language") * 15 + F.col("review") * 20 + (F.col("safety") + F.col("uniqueness") + F.col("trust") + F.col("length")) * 10
    return f.withColumn("score", F.floor((total + 50) / 100).cast("long"))


@plan.query(f"WITH {_FACTORS} SELECT doc_id, score, CASE WHEN score >= 85 THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS confidence FROM q")
def quality_7factor(t: Tables) -> DataFrame:
    return _factors(t).select("doc_id", "score", confidence(F.col("score")).alias("confidence"))


@plan.query(f"""
WITH {_FACTORS}
SELECT doc_id, score >= 85 AND uniqueness = 100 AND safety = 100 AND review = 100 AS publish,
    concat_ws(',', CASE WHEN NOT score >= 85 THEN 'score' END, CASE WHEN uniqueness = 0 THEN 'duplicate' END, CASE WHEN safety = 0 THEN 'toxic' END, CASE WHEN review < 100 THEN 'not_reviewed' END) AS blocked_by
FROM q
""")
def auto_publish_gates(t: Tables) -> DataFrame:
    blocked = reasons(("score", F.col("score") < 85), ("duplicate", F.col("uniqueness") == 0), ("toxic", F.col("safety") == 0), ("not_reviewed", F.col("review") < 100))
    gated = _factors(t).withColumn("blocked", blocked)
    return gated.select("doc_id", (F.size("blocked") == 0).alias("publish"), F.array_join("blocked", ",").alias("blocked_by"))


_RULES = " ".join(f"WHEN regexp_matches(lower({{0}}), '{p}') THEN '{name}'" for name, p in FIELDS)


@plan.query(f"""
WITH c AS (SELECT conv_id, turn, CASE {_RULES.format('role')} END AS of_role, CASE {_RULES.format('text')} END AS of_text FROM conversations)
SELECT conv_id, turn, coalesce(of_role, of_text, 'other') AS label, CASE WHEN of_role IS NOT NULL THEN 'high' WHEN of_text IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM c
""")
def field_of_work(t: Tables) -> DataFrame:
    """Label and confidence: an ordered list of rules over an ordered list of texts."""
    found = taxonomy.classify([(F.col("role"), "high"), (F.col("text"), "medium")], FIELDS, "other")
    return t.conversations.withColumn("f", found).select("conv_id", "turn", "f.*")
