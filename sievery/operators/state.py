"""Life cycle of records: scores, transitions, and replays of histories as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievery.functions.dates import days_between
from sievery.functions.values import clamp

GRACE_DAYS = 14
CONFIRMATIONS = 2


def stale_score(last_seen: Column, status: Column, now: Column) -> Column:
    """Eight points for each day unseen, up to 80, and what the status adds; removed is 100. Unknown times count 30 days."""
    age = F.when(last_seen.isNull(), 30).otherwise(days_between(last_seen, now))
    state = F.lower(F.coalesce(status, F.lit("")))
    score = F.least(F.lit(80), age * 8) + F.when(state == "needs_review", 18).when(state == "expired", 28).otherwise(0)
    return F.when(state == "removed", F.lit(100)).otherwise(clamp(score)).cast("long")


def archival_confidence(confirmations: Column, identities: Column, verified: Column, published: Column, required: int = CONFIRMATIONS) -> Column:
    """How sure it is that a record is gone: half for confirmations, the rest for identity and history."""
    return clamp(confirmations / F.lit(required) * 50 + F.when(identities > 1, 20).otherwise(0) + F.when(verified.isNotNull(), 15).otherwise(0) + F.when(published.isNotNull(), 15).otherwise(0))


def rotation_score(score: Column, surfaced: Column, first_seen: Column, last_seen: Column, last_review: Column, now: Column, cooldown: int = 7, stale_after: int = 120) -> Column:
    """Order in which a backlog comes up for review: relevance, freshness and never having been shown, less repetition and age."""
    since_first, since_last = days_between(first_seen, now), days_between(last_seen, now)
    since_review = F.when(last_review.isNull(), cooldown + 1).otherwise(days_between(last_review, now))
    never = F.when(surfaced == 0, 12 + F.least(since_first, F.lit(21))).otherwise(0)
    recent = F.when(since_review < cooldown, (cooldown - since_review + 1) * 8).otherwise(0)
    return (score * 100 + F.greatest(F.lit(0), 21 - since_last) * 3 + never - recent - surfaced * 5 - F.greatest(F.lit(0), since_last - stale_after) * 4 - F.greatest(F.lit(0), since_first - 45)).cast("long")


def replay_missing(df: DataFrame, by: list[str], at: str, order: list[str], missing: Column, required: int = CONFIRMATIONS, grace_days: int = GRACE_DAYS) -> DataFrame:
    """What each observation does to a record: live, grace or archived.

    A record that is missing gets a grace period from its first absence; it is archived when enough absences in a row
    confirm it and the grace has passed. Seen again, it starts anew.
    """
    w = Window.partitionBy(*by).orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    runs = df.withColumn("_missing", missing.cast("int")).withColumn("_run", F.sum(1 - F.col("_missing")).over(w))
    inner = Window.partitionBy(*by, "_run").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    counted = runs.withColumn("confirmations", F.sum("_missing").over(inner)).withColumn("_since", F.min(F.when(F.col("_missing") == 1, F.col(at))).over(inner))
    over = F.col(at) >= F.col("_since") + F.expr(f"INTERVAL {grace_days} DAYS")
    status = F.when(F.col("confirmations") == 0, "live").when((F.col("confirmations") >= required) & over, "archived").otherwise("grace")
    return counted.withColumn("status", status).drop("_missing", "_run", "_since")
