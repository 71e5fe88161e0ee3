"""Life cycles over the event log, seen from a fixed time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.operators import state
from sievery.plans.registry import Registry, Tables

plan = Registry()
QUERIES, SQL = plan.queries, plan.sql

NOW = "2024-02-01"
_NOW = f"TIMESTAMP '{NOW}'"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _days(ts: str) -> str:
    return f"greatest(0, (epoch_us({_NOW}) - epoch_us({ts})) // 86400000000)"


@plan.query(f"""
WITH u AS (SELECT user_id, max(ts) AS seen, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id)
SELECT user_id, CAST(CASE WHEN last = 'signup' THEN 100 ELSE least(100, least(80, {_days('seen')} * 8) + CASE last WHEN 'error' THEN 18 WHEN 'purchase' THEN 28 ELSE 0 END) END AS BIGINT) AS stale_score FROM u
""")
def stale_score(t: Tables) -> DataFrame:
    u = t.events.groupBy("user_id").agg(F.max("ts").alias("seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    status = F.when(F.col("last") == "error", "needs_review").when(F.col("last") == "purchase", "expired").when(F.col("last") == "signup", "removed").otherwise("live")
    return u.select("user_id", state.stale_score(F.col("seen"), status, now()).alias("stale_score"))


@plan.query(f"""
WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS score, count(*) FILTER (event_type = 'click') AS surfaced, {_days('min(ts)')} AS since_first, {_days('max(ts)')} AS since_last,
    coalesce({_days("max(ts) FILTER (event_type = 'signup')")}, 8) AS since_review, max(ts) FILTER (event_type = 'signup') IS NULL AS unreviewed FROM events GROUP BY user_id)
SELECT user_id, CAST(score * 100 + greatest(0, 21 - since_last) * 3 + CASE WHEN surfaced = 0 THEN 12 + least(since_first, 21) ELSE 0 END
    - CASE WHEN NOT unreviewed AND since_review < 7 THEN (7 - since_review + 1) * 8 ELSE 0 END - surfaced * 5 - greatest(0, since_last - 120) * 4 - greatest(0, since_first - 45) AS BIGINT) AS rotation
FROM u
""")
def rotation_rank(t: Tables) -> DataFrame:
    u = t.events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("score"),
        F.count_if(F.col("event_type") == "click").alias("surfaced"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("review"),
    )
    rotation = state.rotation_score(F.col("score"), F.col("surfaced"), F.col("first"), F.col("last"), F.col("review"), now())
    return u.select("user_id", rotation.alias("rotation"))


@plan.query("""
WITH e AS (SELECT user_id, event_id, ts, CAST(event_type = 'error' AS INTEGER) AS missing FROM events),
r AS (SELECT *, sum(1 - missing) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
c AS (SELECT *, sum(missing) OVER w AS confirmations, min(CASE WHEN missing = 1 THEN ts END) OVER w AS since FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, CAST(confirmations AS BIGINT) AS confirmations, CASE WHEN confirmations = 0 THEN 'live' WHEN confirmations >= 2 AND ts >= since + INTERVAL 1 DAY THEN 'archived' ELSE 'grace' END AS status FROM c
""")
def lifecycle_replay(t: Tables) -> DataFrame:
    seen = t.events.select("user_id", "event_id", "ts", "event_type")
    return state.replay_missing(seen, ["user_id"], "ts", ["event_id"], F.col("event_type") == "error", 2, 1).select("user_id", "event_id", "confirmations", "status")


@plan.query(f"""
WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS confirmations, count(DISTINCT event_type) AS identities, max(ts) FILTER (event_type = 'view') AS verified, max(ts) FILTER (event_type = 'purchase') AS published FROM events GROUP BY user_id)
SELECT user_id, CAST(least(100, confirmations * 25 + CASE WHEN identities > 1 THEN 20 ELSE 0 END + CASE WHEN verified IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN published IS NOT NULL THEN 15 ELSE 0 END) AS BIGINT) AS confidence FROM u
""")
def archival_confidence(t: Tables) -> DataFrame:
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    u = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"), F.countDistinct("event_type").alias("identities"), at("view").alias("verified"), at("purchase").alias("published"))
    return u.select("user_id", state.archival_confidence(F.col("n"), F.col("identities"), F.col("verified"), F.col("published")).alias("confidence"))


@plan.query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS sightings FROM events GROUP BY user_id")
def first_last_seen(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("sightings"))
