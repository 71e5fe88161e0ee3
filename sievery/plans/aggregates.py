"""Counts, rates, scorecards, histograms and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievery.functions.values import rate
from sievery.operators import aggregate as agg
from sievery.operators import audit
from sievery.plans.registry import Registry, Tables

plan = Registry()
QUERIES, SQL = plan.queries, plan.sql


@plan.query("""
WITH d AS (
    SELECT d.source, d.doc_id, d.text, d.n_chars, l.doc_id AS labelled, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), s AS (
    SELECT source, count(*) AS n_docs, count(labelled) AS n_labelled,
        CASE WHEN count(*) = 0 THEN 100 ELSE floor(count(labelled) * 100.0 / count(*) + 0.5) END AS label_rate,
        CASE WHEN count(*) = 0 THEN 100 ELSE floor(count(*) FILTER (n_chars > 500) * 100.0 / count(*) + 0.5) END AS long_rate,
        CASE WHEN count(labelled) = 0 THEN 100 ELSE floor(count(*) FILTER (quality = 1) * 100.0 / count(labelled) + 0.5) END AS good_rate,
        count(*) FILTER (toxic = 1) AS n_toxic, count(text) - count(DISTINCT text) AS n_duplicates
    FROM d GROUP BY source
), scored AS (
    SELECT *, greatest(0, least(100, floor(5 + 100 * 0.20 + long_rate * 0.15 + good_rate * 0.20 + label_rate * 0.10 - 0 * 3 - least(n_duplicates, 4) * 5 - 0 * 10 - least(n_toxic, 5) * 2 + 0.5))) AS score
    FROM s
)
SELECT source, n_docs, n_labelled, CAST(label_rate AS BIGINT) AS label_rate, CAST(long_rate AS BIGINT) AS long_rate, CAST(good_rate AS BIGINT) AS good_rate,
    n_toxic, n_duplicates, CAST(score AS BIGINT) AS score,
    CASE WHEN score >= 80 AND n_docs >= 3 THEN 'highest_quality' WHEN score >= 60 THEN 'medium_quality' WHEN score >= 30 THEN 'high_maintenance' ELSE 'candidate_for_removal' END AS tier,
    CASE WHEN score >= 80 AND n_docs >= 3 THEN 'KEEP' WHEN score >= 60 THEN CASE WHEN n_docs > 0 THEN 'HARDEN' ELSE 'KEEP' END
         WHEN score >= 30 THEN CASE WHEN n_docs >= 5 THEN 'MANUAL_REVIEW_ONLY' ELSE 'HARDEN' END
         ELSE CASE WHEN n_docs > 0 THEN 'HARDEN' ELSE 'REMOVE' END END AS recommendation
FROM scored
""")
def source_scorecard(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels.withColumn("labelled", F.lit(1)), "doc_id", "left")
    n, labelled = F.count(F.lit(1)), F.count("labelled")
    s = d.groupBy("source").agg(
        n.alias("n_docs"),
        labelled.alias("n_labelled"),
        rate(labelled, n).alias("label_rate"),
        rate(F.count_if(F.col("n_chars") > 500), n).alias("long_rate"),
        rate(F.count_if(F.col("quality") == 1), labelled).alias("good_rate"),
        F.count_if(F.col("toxic") == 1).alias("n_toxic"),
        agg.duplicates("text").alias("n_duplicates"),
    )
    score = agg.source_score(
        {"parsed": F.lit(100), "described": F.col("long_rate"), "paid": F.col("good_rate"), "linked": F.col("label_rate")},
        {"stale": F.lit(0), "duplicates": F.least("n_duplicates", F.lit(4)), "archived": F.lit(0), "manual": F.least("n_toxic", F.lit(5))},
        F.lit(5),
    )
    scored = s.withColumn("score", score)
    return scored.withColumn("_t", agg.tier(F.col("score"), F.col("n_docs"))).select("*", "_t.*").drop("_t")


@plan.query("SELECT c_name AS key, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE trim(c_name) <> '' GROUP BY c_name ORDER BY n DESC, key LIMIT 20")
def top_organizations(t: Tables) -> DataFrame:
    # Counted before the join: a name for each key, not for each order.
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("m"))
    named = counts.join(t.customer, counts["o_custkey"] == t.customer["c_custkey"]).where(F.trim("c_name") != "")
    return named.groupBy(F.col("c_name").alias("key")).agg(F.sum("m").alias("n")).orderBy(F.desc("n"), "key").limit(20)


BINS = (("0-20", 0, 20), ("21-40", 21, 40), ("41-60", 41, 60), ("61-84", 61, 84), ("85-100", 85, 100), ("over", 101, 10**6))


@plan.query("""
WITH bins(bin, low, high) AS (VALUES ('0-20', 0, 20), ('21-40', 21, 40), ('41-60', 41, 60), ('61-84', 61, 84), ('85-100', 85, 100), ('over', 101, 1000000))
SELECT bin, count(p_partkey) AS n FROM bins LEFT JOIN part ON p_size * 2 BETWEEN low AND high GROUP BY bin
""")
def score_histogram(t: Tables) -> DataFrame:
    return agg.histogram(t.part, F.col("p_size") * 2, BINS)


TYPES = ["view", "click", "signup", "purchase", "error"]


@plan.query("""
SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'signup') AS signup,
    count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error,
    count(*) FILTER (event_type IN ('view', 'click', 'signup', 'purchase', 'error')) AS total
FROM events GROUP BY user_id
""")
def category_pivot(t: Tables) -> DataFrame:
    return agg.pivot_counts(t.events, "user_id", "event_type", TYPES)


def checks() -> dict[str, F.Column]:
    text = F.col("text")
    return {
        "short": F.col("n_chars") < 200,
        "shouting": F.upper(text) == text,
        "assignment": F.lower(text).rlike("(token|password) ?[=:]"),
        "repeated_mark": text.rlike("!!|%%%|&&&"),
        "piped": text.contains(" | "),
    }


_FINDINGS = """
SELECT source, doc_id, unnest(list_filter([
    CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN upper(text) = text THEN 'shouting' END,
    CASE WHEN regexp_matches(lower(text), '(token|password) ?[=:]') THEN 'assignment' END,
    CASE WHEN regexp_matches(text, '!!|%%%|&&&') THEN 'repeated_mark' END, CASE WHEN contains(text, ' | ') THEN 'piped' END], lambda x: x IS NOT NULL)) AS "check"
FROM documents
"""


@plan.query(_FINDINGS)
def quality_findings(t: Tables) -> DataFrame:
    return audit.findings(t.documents, "doc_id", checks(), ("source",))


@plan.query(f"""SELECT "check", source, count(*) AS n FROM ({_FINDINGS}) GROUP BY ROLLUP ("check", source)""")
def audit_totals(t: Tables) -> DataFrame:
    return audit.totals(audit.findings(t.documents, "doc_id", checks(), ("source",)), "source")


@plan.query(f"""
WITH f AS ({_FINDINGS}), r AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY "check") AS n FROM f)
SELECT "check", array_to_string(list(doc_id ORDER BY doc_id), ',') AS "rows", max(n) AS n FROM r WHERE place <= 10 GROUP BY "check"
""")
def finding_samples(t: Tables) -> DataFrame:
    found = audit.sample(audit.findings(t.documents, "doc_id", checks(), ("source",)), "doc_id")
    return found.select("check", F.concat_ws(",", F.transform("rows", lambda r: r.cast("string"))).alias("rows"), "n")


@plan.query("SELECT source, lang, count(*) AS n, sum(n_chars) AS chars, count(DISTINCT text) AS texts, avg(n_chars) AS mean_chars, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY source, lang")
def source_stats(t: Tables) -> DataFrame:
    chars = F.col("n_chars")
    return t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("chars"), F.countDistinct("text").alias("texts"), F.avg(chars).alias("mean_chars"), F.min(chars).alias("shortest"), F.max(chars).alias("longest"))


@plan.query("""SELECT regexp_replace(p_name || ' $' || CAST(CAST(p_retailprice AS INTEGER) AS VARCHAR), '[0-9,.]+', '#', 'g') AS key, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, key LIMIT 15""")
def pay_patterns(t: Tables) -> DataFrame:
    from sievery.functions.money import pattern_of

    shown = F.concat(F.col("p_name"), F.lit(" $"), F.rint("p_retailprice").cast("int").cast("string"))
    return agg.top_counts(t.part, pattern_of(shown), 15)


@plan.query("""
SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, CAST(floor(count(*) FILTER (n_chars < 200) * 100.0 / count(*) + 0.5) AS BIGINT) AS short_rate,
    count(text) - count(DISTINCT text) AS n_duplicates, count(*) FILTER (n_chars < 200) * 10 > count(*) AS many_short,
    (count(text) - count(DISTINCT text)) * 5 > count(*) AS many_duplicates, CAST(floor(max(share) * 100 + 0.5) AS BIGINT) AS largest_share
FROM (SELECT *, count(*) OVER (PARTITION BY source) * 1.0 / count(*) OVER () AS share FROM documents)
""")
def board_health(t: Tables) -> DataFrame:
    n, short = F.count(F.lit(1)), F.count_if(F.col("n_chars") < 200)
    whole = t.documents.agg(n.alias("n_docs"), F.countDistinct("source").alias("n_sources"), rate(short, n).alias("short_rate"), agg.duplicates("text").alias("n_duplicates"), (short * 10 > n).alias("many_short"))
    largest = t.documents.groupBy("source").count().agg((F.max("count") / F.sum("count")).alias("share"))
    both = whole.join(F.broadcast(largest))  # one row each
    return both.select("*", (F.col("n_duplicates") * 5 > F.col("n_docs")).alias("many_duplicates"), F.floor(F.col("share") * 100 + 0.5).cast("long").alias("largest_share")).drop("share")


@plan.query("""
WITH r AS (SELECT user_id, unnest(list_filter([CASE WHEN event_type = 'error' THEN 'failed' END, CASE WHEN value > 50 THEN 'large' END, CASE WHEN value < 1 THEN 'tiny' END], lambda x: x IS NOT NULL)) AS reason FROM events)
SELECT user_id, reason, count(*) AS n FROM r GROUP BY user_id, reason
""")
def rejection_summary(t: Tables) -> DataFrame:
    from sievery.functions.values import reasons

    marked = t.events.withColumn("reasons", reasons(("failed", F.col("event_type") == "error"), ("large", F.col("value") > 50), ("tiny", F.col("value") < 1)))
    return agg.reason_counts(marked, "user_id", "reasons")


@plan.query("""
WITH f AS (SELECT doc_id, CASE WHEN text IN (SELECT text FROM benchmark) THEN 'benchmark' WHEN count(*) OVER (PARTITION BY text) > 1 THEN 'duplicate' WHEN n_chars < 200 THEN 'rejected' WHEN lang <> 'en' THEN 'pending-review' ELSE 'accepted' END AS stage FROM documents)
SELECT stage, count(*) AS n FROM f GROUP BY stage
""")
def discovery_funnel(t: Tables) -> DataFrame:
    copies = t.documents.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    known = t.benchmark.select("text", F.lit(1).alias("known")).distinct()
    d = t.documents.join(copies, "text", "left").join(known, "text", "left")
    stage = F.when(F.col("known").isNotNull(), "benchmark").when(F.col("copies") > 1, "duplicate").when(F.col("n_chars") < 200, "rejected").when(F.col("lang") != "en", "pending-review").otherwise("accepted")
    return agg.count_by(d, stage, "stage")


@plan.query("""SELECT source, count(*) AS "rows", sum(strlen(text)) AS "bytes" FROM documents GROUP BY source ORDER BY "bytes" DESC, source""")
def size_by_source(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("bytes"), "source")


@plan.query("""
WITH c AS (SELECT CASE WHEN o_totalprice >= 400000 THEN 'A' WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'B' WHEN o_orderstatus = 'F' THEN 'C' WHEN o_totalprice < 50000 THEN 'D' ELSE 'E' END AS cause, o_orderpriority FROM orders)
SELECT cause, o_orderpriority, count(*) AS n, CAST(floor(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY o_orderpriority) + 0.5) AS BIGINT) AS share FROM c GROUP BY cause, o_orderpriority
""")
def root_causes(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    failed = F.col("o_orderstatus") == "F"
    cause = F.when(F.col("o_totalprice") >= 400000, "A").when(failed & F.col("o_orderpriority").startswith("1"), "B").when(failed, "C").when(F.col("o_totalprice") < 50000, "D").otherwise("E")
    counted = t.orders.groupBy(cause.alias("cause"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", rate(F.col("n"), F.sum("n").over(Window.partitionBy("o_orderpriority"))))
