"""Decisions by rank and by what came before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievery.operators import windows as w
from sievery.plans.registry import Registry, Tables

plan = Registry()
QUERIES, SQL = plan.queries, plan.sql

#: Precedence of decisions at one time; others count 1.
PRECEDENCE = {"error": 4, "signup": 3, "purchase": 2}
_RANK = "CASE event_type WHEN 'error' THEN 4 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END"


def precedence() -> F.Column:
    rank = F.lit(1)
    for kind, n in PRECEDENCE.items():
        rank = F.when(F.col("event_type") == kind, n).otherwise(rank)
    return rank


@plan.query(f"""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, {_RANK} DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def latest_decision(t: Tables) -> DataFrame:
    e = t.events.withColumn("day", F.date_trunc("day", "ts"))
    return w.keep_first(e, ["user_id"], [F.desc("day"), precedence().desc(), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@plan.query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n, min(doc_id) OVER (PARTITION BY md5(text)) AS first_row FROM documents)
SELECT doc_id, source, first_row FROM r WHERE n > 1
""")
def first_occurrence_duplicates(t: Tables) -> DataFrame:
    thin = t.documents.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    return w.mark_repeats(thin, ["h"], ["doc_id"], "doc_id").select("doc_id", "source", "first_row")


_KEEPER = "CASE event_type WHEN 'purchase' THEN 50 WHEN 'signup' THEN 20 ELSE 0 END + CAST(floor(value) AS BIGINT)"


@plan.query(f"""
WITH k AS (SELECT user_id, event_id, {_KEEPER} AS score, CAST(ts AS DATE) AS day FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY score DESC, event_id) AS n, count(*) OVER (PARTITION BY user_id, day) AS members FROM k)
SELECT user_id, event_id, score, CASE WHEN n = 1 THEN 'keep' ELSE 'archive' END AS verdict FROM r WHERE members > 1
""")
def duplicate_keeper(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    score = F.when(F.col("event_type") == "purchase", 50).when(F.col("event_type") == "signup", 20).otherwise(0) + F.floor("value")
    k = t.events.select("user_id", "event_id", score.alias("score"), F.to_date("ts").alias("day"))
    group = Window.partitionBy("user_id", "day")
    r = k.withColumns({"n": F.row_number().over(group.orderBy(F.desc("score"), "event_id")), "members": F.count(F.lit(1)).over(group)})
    return r.where("members > 1").select("user_id", "event_id", "score", F.when(F.col("n") == 1, "keep").otherwise("archive").alias("verdict"))


@plan.query("""
WITH e AS (SELECT doc_id, source, n_chars, lang <> 'en' AND n_chars < 8000 AS limited FROM documents),
one AS (SELECT *, row_number() OVER (PARTITION BY source, limited ORDER BY n_chars DESC, doc_id) AS n FROM e),
two AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS m FROM one WHERE NOT limited OR n <= 8)
SELECT doc_id, source, n_chars FROM two WHERE m <= 25 ORDER BY n_chars DESC, doc_id LIMIT 300
""")
def source_quota(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "n_chars", "lang")
    limited = (F.col("lang") != "en") & (F.col("n_chars") < 8000)
    return w.quota(d, "source", [F.desc("n_chars"), "doc_id"], limited, 8, 25, 300).select("doc_id", "source", "n_chars")


@plan.query("""
WITH p AS (SELECT user_id, event_id, value, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
u AS (SELECT *, sum(CASE WHEN n > 5 AND value >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n) AS used FROM p)
SELECT user_id, event_id, CASE WHEN n <= 5 THEN 'base' WHEN value >= 20 AND used <= 2 THEN 'overflow' ELSE 'backlog' END AS slot FROM u
""")
def overflow_slots(t: Tables) -> DataFrame:
    return w.base_and_overflow(t.events, ["user_id"], ["ts", "event_id"], 5, F.col("value") >= 20, 2).select("user_id", "event_id", "slot")


@plan.query("""
WITH b AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value >= 5 THEN 0 ELSE 1 END, value DESC, event_id) AS INTEGER) AS backlog_rank FROM b WHERE n > 5
""")
def backlog_rank(t: Tables) -> DataFrame:
    placed = w.base_and_overflow(t.events, ["user_id"], ["ts", "event_id"], 5, F.lit(False), 0).where("slot = 'backlog'")
    order = [F.when(F.col("value") >= 5, 0).otherwise(1), F.desc("value"), F.col("event_id")]
    return w.top_each(placed, ["user_id"], order, 1 << 30, "backlog_rank").select("user_id", "event_id", "backlog_rank")


@plan.query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE n <= 2 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""")
def company_then_global_cap(t: Tables) -> DataFrame:
    return w.each_then_all(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 2, 100)


@plan.query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS following FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)")
def neighbour_rail(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return w.neighbours(o, [F.desc("o_orderdate"), "o_orderkey"], "o_orderkey", ["o_custkey"]).drop("o_orderdate")


@plan.query("""
WITH d AS (SELECT doc_id, left(regexp_replace(lower(text), '[^a-z]', '', 'g'), 6) AS key, n_chars >= 300 AS kept FROM documents)
SELECT doc_id, kept, coalesce(max(CAST(kept AS INTEGER)) OVER (PARTITION BY key ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS repeat FROM d
""")
def seen_filter(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.substring(F.regexp_replace(F.lower("text"), "[^a-z]", ""), 1, 6).alias("key"), (F.col("n_chars") >= 300).alias("kept"))
    return w.running_seen(d, "key", ["doc_id"], F.col("kept")).select("doc_id", "kept", "repeat")


@plan.query("""
WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS streak FROM r
""")
def failure_streak(t: Tables) -> DataFrame:
    return w.streaks(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "streak")


@plan.query("""
WITH s AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug, right('00000000' || CAST(p_partkey % 7 AS VARCHAR), 4) AS suffix FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM s),
x AS (SELECT *, CASE WHEN n = 1 THEN slug ELSE slug || '-' || suffix END AS w FROM n),
m AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY CASE WHEN n > 1 THEN 1 ELSE 0 END, p_partkey) AS m FROM x)
SELECT p_partkey, CASE WHEN m = 1 THEN w ELSE w || '-' || CAST(m AS VARCHAR) END AS unique_slug FROM m
""")
def unique_slugs(t: Tables) -> DataFrame:
    from sievery.functions.text import slugify

    p = t.part.select("p_partkey", slugify(F.col("p_name")).alias("slug"), F.lpad((F.col("p_partkey") % 7).cast("string"), 4, "0").alias("suffix"))
    return w.unique_slugs(p, "slug", "suffix", ["p_partkey"]).select("p_partkey", "unique_slug")


@plan.query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events)
SELECT user_id, array_to_string(list(event_id ORDER BY n), ',') AS examples FROM r WHERE n <= 3 GROUP BY user_id
""")
def top_examples(t: Tables) -> DataFrame:
    best = w.top_each(t.events, ["user_id"], [F.desc("value"), "event_id"], 3, "n")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "event_id"))), lambda s: s["event_id"].cast("string"))
    return best.groupBy("user_id").agg(F.array_join(ordered, ",").alias("examples"))


@plan.query("""
SELECT doc_id FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 3 WHEN lang = 'fr' THEN 2 ELSE 1 END AS score, n_chars > 1000 AS long, source FROM documents)
ORDER BY score DESC, long DESC, source, doc_id LIMIT 200
""")
def priority_sort(t: Tables) -> DataFrame:
    score = F.when(F.col("lang") == "en", 3).when(F.col("lang") == "fr", 2).otherwise(1)
    return t.documents.orderBy(score.desc(), (F.col("n_chars") > 1000).desc(), "source", "doc_id").select("doc_id").limit(200)


@plan.query("""
WITH top AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders ORDER BY n LIMIT 4)
SELECT o.o_orderkey, array_to_string(list_slice(list(t.o_orderkey ORDER BY t.n), 1, 3), ',') AS related FROM orders o JOIN top t ON t.o_orderkey <> o.o_orderkey GROUP BY o.o_orderkey
""")
def related_items(t: Tables) -> DataFrame:
    """The three latest others: four candidates are enough for every row, held as one array."""
    top = t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey").limit(4).collect()
    latest = F.array(*[F.lit(r[0]) for r in top])
    others = F.slice(F.filter(latest, lambda k: k != F.col("o_orderkey")), 1, 3)
    return t.orders.select("o_orderkey", F.array_join(F.transform(others, lambda k: k.cast("string")), ",").alias("related"))
