"""Governance of pending records: nulls, missing columns, empty tables, keys of other records, and single factors."""

import datetime as dt

from pyspark.sql import functions as F

from sievery.functions import quality
from sievery.operators import governance

NOW = "2024-02-01 00:00:00"
SOURCES = "id string, organization string, provider string, source_classification string, trusted boolean, auto_publish boolean, manual_review_required boolean, scoring map<string,string>"
PENDING = "id string, source_id string, organization string, title string, apply_url string, source_url string, status string"


def test_governed(spark):
    pending = spark.createDataFrame(
        [("1", "s", "Acme", "Analyst", "https://a.org/jobs/1", "https://a.org", "pending"), ("2", None, "Acme!", "analyst", "https://a.org/jobs/1", None, None), ("3", None, None, None, None, None, None), ("4", "s", "B", "C", "", "", "Archived")], PENDING
    )
    sources = spark.createDataFrame([("S", "x", "taleo", None, None, None, None, None), ("s", "y", "lever", "", True, True, False, {"parser_stability": "high"})], SOURCES)
    archived = spark.createDataFrame([("2",), ("2",)], "id string")
    got = {r.id: r for r in governance.governed(pending, pending.limit(0), sources, archived, "id", F.lit(NOW).cast("timestamp_ntz")).collect()}
    assert set(got) == {"1", "2", "3"}
    # Equal address and equal organisation with title: two keys of another pending record.
    assert (got["1"].duplicate, got["2"].duplicate, got["3"].duplicate) == (40, 40, 100)
    # The first of two sources alike is that of the smaller id, by its bytes.
    assert got["1"].source_trust == 35 and "risky_source" in got["1"].blocked_by and got["2"].source_trust == 30
    assert "archive" in got["2"].blocked_by and "archive" not in got["1"].blocked_by
    assert (got["3"].url_quality, got["3"].location, got["3"].freshness) == (0, 0, 50) and not got["3"].publish
    assert governance.governed(pending.limit(0), pending, sources.limit(0), archived.limit(0), "id", F.lit(NOW).cast("timestamp_ntz")).isEmpty()


def test_publish(spark):
    row = {
        "id": "1", "source_id": "s", "organization": "Acme", "title": "Policy Analyst", "apply_url": "https://acme.org/jobs/1", "source_url": "https://acme.org/jobs", "status": "pending", "description_heading_used": "Role", "description_snippet": "The analyst leads work on energy policy with partners in many towns.",
        "description": "Responsibilities: the analyst leads work on energy policy with partners in many towns, writes reports and plans.", "salary": "$50,000 - $60,000", "raw_salary": "$50,000", "pay_confidence": "high", "salary_min": 50000.0, "salary_max": 60000.0, "location": "Boston, MA", "workplace_type": "On-site",
        "source_status": "live", "stale_score": 0, "last_checked_at": dt.datetime(2024, 1, 31), "date_posted": dt.datetime(2024, 1, 25),
    }
    df = spark.createDataFrame([tuple(row.values()), tuple((row | {"id": "2", "organization": "Other", "apply_url": "https://acme.org/jobs/2", "description": "This position is closed. " + row["description"]}).values())], list(row))
    sources = spark.createDataFrame([("s", "Acme", "lever", "trusted_ats", True, True, False, None)], SOURCES)
    got = {r.id: r for r in governance.governed(df, df.limit(0), sources, df.limit(0).select("id"), "id", F.lit(NOW).cast("timestamp_ntz")).collect()}
    assert got["1"].publish and got["1"].blocked_by == [] and got["1"].score >= 95
    assert got["2"].freshness == 0 and "freshness" in got["2"].blocked_by
    named = governance.governed(df, df.limit(0), sources, df.limit(0).select("id"), "id", F.lit(NOW).cast("timestamp_ntz"), ("acme",)).where("id = '1'").first()
    assert named.blocked_by == ["risky_source"]


def test_factors(spark):
    df = spark.createDataFrame([("", "", ""), ("https://acme.org/jobs/1", "https://acme.org/x", "Remote"), ("https://www.indeed.com/search?q=1", "https://acme.org", "Berlin, Germany, EU"), ("https://acme.org/jobs/1", "", "undefined")], "apply_url string, source_url string, location string")
    job = quality.of(df)
    rows = df.select(governance.url_quality(job).alias("u"), governance.location_quality(job).alias("l")).collect()
    assert [r.u for r in rows] == [0, 100, 40, 10] and [r.l for r in rows][:3] == [0, 75, 90]
