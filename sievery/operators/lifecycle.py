"""Transitions of published records. The clock is a column; a transition is an ordered list of changes to fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.functions.dates import deadline
from sievery.operators.state import stale_score

#: Days that a publication lasts without a deadline of its own.
SHELF_DAYS = 7
STATUS = {
    "live": ("live", "verified", "active", "published"),
    "needs_review": ("pending", "pending_review", "needs_review", "review"),
    "stale": ("stale", "aging"),
    "removed": ("removed", "archived", "expired"),
    "sync_error": ("sync_error", "fetch_failed", "parser_failed"),
}


def source_status(x: Column, otherwise: str = "live") -> Column:
    """One of five states by their many names."""
    low, found = F.lower(F.trim(F.coalesce(x, F.lit("")))), None
    for name, names in STATUS.items():
        found = F.when(low.isin(*names), name) if found is None else found.when(low.isin(*names), name)
    return found.otherwise(otherwise)


def changed(df: DataFrame, when: Column, changes: dict[str, Column]) -> DataFrame:
    """``df`` with new values where ``when`` holds; all conditions and values see the row as it was."""
    return df.withColumns({name: F.when(when, value.cast(df.schema[name].dataType)).otherwise(F.col(name)) for name, value in changes.items()})


def checked(now: Column, status: str, seen: bool, failed: bool = False) -> dict[str, Column]:
    """Freshness of a record that was looked at: when, how its source is, when it was last seen, and failures in a row."""
    fresh = {"last_checked_at": now, "source_status": F.lit(status), "stale_score": stale_score(now if seen else F.col("last_seen_at"), F.lit(status), now)}
    fresh["failed_sync_count"] = F.coalesce(F.col("failed_sync_count"), F.lit(0)) + 1 if failed else F.lit(0)
    return fresh | ({"last_seen_at": now} if seen else {})


def published(df: DataFrame, when: Column, now: Column) -> DataFrame:
    """Records that go public: verified until their deadline, else for some days; with a deadline that has passed they are expired at once."""
    until = deadline(F.col("description")).cast("timestamp_ntz")
    late = F.coalesce(until < now, F.lit(False))
    live, gone = checked(now, "live", seen=True), checked(now, "removed", seen=False)
    fresh = {name: F.when(late, gone.get(name, F.col(name))).otherwise(value) for name, value in live.items()}
    return changed(df, when, fresh | {
        "first_published_at": F.coalesce("first_published_at", now),
        "last_verified_at": now,
        "expires_at": F.coalesce(until, now + F.expr(f"INTERVAL {SHELF_DAYS} DAYS")),
        "stale_reason": F.when(late, "application deadline has passed").otherwise(""),
        "verification_status": F.when(late, "expired").otherwise("verified"),
        "verification_method": F.when(until.isNotNull(), "deadline_detected").otherwise("manual"),
    })


def withdrawn(df: DataFrame, when: Column, now: Column, to: str, reason: Column, method: str) -> DataFrame:
    """Records that are no longer public: ``needs_review`` sends them back, ``removed`` and ``expired`` archive them."""
    hidden = {"published": F.lit(False), "public_visibility": F.lit(False), "stale_reason": reason, "verification_status": F.lit(to), "verification_method": F.lit(method), "updated_at": now}
    review = to == "needs_review"
    fresh = checked(now, "needs_review" if review else "removed", seen=False, failed=review)
    return changed(df, when, fresh | hidden | {"status": F.lit("pending" if review else "archived")})


def extended(df: DataFrame, when: Column, now: Column, method: str = "source_recheck") -> DataFrame:
    """Records that a look at their source has confirmed, for some more days."""
    more = {"last_verified_at": now, "expires_at": now + F.expr(f"INTERVAL {SHELF_DAYS} DAYS"), "verification_status": F.lit("verified"), "verification_method": F.lit(method), "stale_reason": F.lit("")}
    return changed(df, when, checked(now, "live", seen=True) | more)


def is_public() -> Column:
    state = F.lower(F.coalesce(F.col("verification_status"), F.lit("")))
    return F.coalesce(F.col("published") & F.col("public_visibility") & (F.lower("status") == "published") & ~state.isin("expired", "removed"), F.lit(False))


def is_stale(now: Column) -> Column:
    """Past its end, or published for longer than a publication lasts."""
    start = F.coalesce("first_published_at", "updated_at")
    return F.coalesce(F.col("expires_at") <= now, F.lit(False)) | F.coalesce(start + F.expr(f"INTERVAL {SHELF_DAYS} DAYS") <= now, F.lit(False))


def reviewed(df: DataFrame, mode: Column, now: Column) -> DataFrame:
    """Public records after a review, with ``outcome``: past their deadline they expire; stale ones follow the page's ``mode``.

    A live page extends, a dead one removes, any other sends back for review. Records that are neither public nor stale are kept.
    """
    public, until = is_public(), deadline(F.col("description")).cast("timestamp_ntz")
    late = public & F.coalesce(until < now, F.lit(False))
    outcome = F.when(late, "expired").when(~(public & is_stale(now)), "kept").when(mode == "live", "extended").when(mode == "dead", "removed").otherwise("needs_review")
    out = df.withColumn("outcome", outcome)
    on = lambda name: F.col("outcome") == name
    out = withdrawn(out, on("expired"), now, "expired", F.lit("application deadline has passed"), "deadline_detected")
    out = withdrawn(out, on("removed"), now, "removed", F.lit("source says that it is closed"), "source_recheck")
    out = extended(out, on("extended"), now)
    return withdrawn(out, on("needs_review"), now, "needs_review", F.lit("could not be confirmed"), "source_recheck")


def identity_history(history: Column, id_: Column, title: Column, now: Column) -> Column:
    """``history`` (an array of id, title, recorded_at) with this identity appended unless it is there or empty."""
    seen = F.exists(history, lambda e: e["id"] == id_)
    entry = F.array(F.struct(id_.alias("id"), title.alias("title"), now.alias("recorded_at")))
    return F.when(F.coalesce(id_, F.lit("")) == "", history).when(seen, history).otherwise(F.concat(history, entry))
