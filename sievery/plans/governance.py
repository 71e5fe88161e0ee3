"""Publication without a person: factors and gates over records made of parts, against the points that each should get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.operators import governance
from sievery.plans.registry import Registry, Tables

plan = Registry()
QUERIES, SQL = plan.queries, plan.sql

LONG = "Responsibilities: the analyst leads work on energy policy with partners in many towns, writes reports and plans meetings."
#: An address that says 404 is a page that is gone: nothing there is fresh.
#: Descriptions with the points that each gets for itself.
SAID = (("", 35), ("A short note on the work here, at best.", 50), (LONG, 75), (LONG + " Apply now.", 60), ("Work. <span>", 15))
PAY = (("high", 40), ("medium", 25), ("low", 10), ("", 0))
PLACES = (("Boston, MA", 80), ("", 0), ("Remote", 75), ("Oslo", 65))
LINKS = (("https://acme.org/jobs/{k}", 100), ("https://acme.org/login/jobs/{k}", 85), ("https://www.indeed.com/jobs/{k}", 70), ("", 0))


def _pick(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _points(cases: tuple[tuple[str, int], ...], key: str) -> str:
    return f"[{', '.join(str(n) for _, n in cases)}][CAST({key} % {len(cases)} + 1 AS INTEGER)]"


def _records(t: Tables) -> DataFrame:
    k, now = F.col("p_partkey"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    before = lambda days: now - F.make_dt_interval(days)
    link = F.replace(_pick([x for x, _ in LINKS], k), F.lit("{k}"), k.cast("string"))
    return t.part.select(
        k.alias("id"), F.when(k % 3 == 0, "s1").when(k % 3 == 1, "none").alias("source_id"), F.when(k % 2 == 0, "Acme").otherwise("Zenith").alias("organization"), F.concat(F.lit("Policy Analyst "), (k - k % 97 % 2).cast("string")).alias("title"),
        _pick([x for x, _ in SAID], k).alias("description"), F.when(k % 7 == 0, "Role").otherwise("").alias("description_heading_used"), F.when(k % 11 == 0, "The analyst leads work on energy policy with partners in many towns.").otherwise("Short.").alias("description_snippet"),
        link.alias("apply_url"), F.lit("https://acme.org/jobs").alias("source_url"), _pick([x for x, _ in PAY], k).alias("pay_confidence"), F.when(k % 5 < 3, "$50,000").otherwise("").alias("salary"), F.when(k % 5 == 4, "missing_pay_context").otherwise("").alias("pay_rejection_reason"),
        F.when(k % 5 < 2, 50000.0).alias("salary_min"), F.when(k % 5 == 0, 60000.0).alias("salary_max"), F.when(k % 13 == 0, F.array(F.lit("$50k"))).alias("pay_candidate_snippets"),
        F.when(k % 4 == 0, "live").when(k % 4 == 1, "needs_review").alias("source_status"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 60).alias("stale_score"), before((k % 40).cast("int")).alias("last_checked_at"), F.when(k % 6 > 0, before((k % 120).cast("int"))).alias("date_posted"),
        _pick([x for x, _ in PLACES], k).alias("location"), F.when(k % 10 == 0, "Archived").otherwise("pending").alias("status"),
    )


@plan.query(f"""
WITH p AS (SELECT p_partkey AS k, p_partkey - p_partkey % 97 % 2 AS t FROM part),
o AS (SELECT k, t, CASE WHEN k % 2 = 0 THEN 'Acme' ELSE 'Zenith' END AS org, {_points(PLACES, 'k')} AS place FROM p),
pen AS (SELECT * FROM o WHERE k % 10 > 0), pub AS (SELECT k + 1000000 AS k, org, t, 65 AS place FROM o WHERE k % 19 = 0),
keys AS (SELECT k, concat_ws('|', 'ot', org, t) AS key FROM pen UNION ALL SELECT k, concat_ws('|', 'otl', org, t, k % 4) FROM pen WHERE place > 0 UNION ALL SELECT k, 'url' || CAST(k AS VARCHAR) FROM pen WHERE k % 4 < 3),
pkeys AS (SELECT k, concat_ws('|', 'ot', org, t) AS key FROM pub UNION ALL SELECT k, concat_ws('|', 'otl', org, t, 3) FROM pub),
dup AS (SELECT keys.k, count(*) FILTER (key IN (SELECT key FROM pkeys)) AS n_public, count(*) FILTER (key IN (SELECT key FROM keys GROUP BY key HAVING count(DISTINCT k) > 1)) AS n_pending FROM keys GROUP BY keys.k),
f AS (SELECT k, least(100, {_points(SAID, 'k')} + CASE WHEN k % 7 = 0 THEN 15 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 10 ELSE 0 END) AS d, {_points(LINKS, 'k')} AS u,
    least(100, {_points(PAY, 'k')} + CASE WHEN k % 5 < 3 THEN 25 ELSE 0 END + CASE WHEN k % 5 = 4 THEN 5 ELSE 10 END + CASE WHEN k % 13 = 0 THEN 10 ELSE 0 END + CASE k % 5 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 0 END) AS y,
    CASE WHEN k % 4 < 3 AND contains(CAST(k AS VARCHAR), '404') THEN 0 ELSE greatest(0, least(100, 50 + CASE k % 3 WHEN 0 THEN 10 WHEN 1 THEN -30 ELSE 0 END + CASE k % 4 WHEN 0 THEN 10 WHEN 1 THEN -10 ELSE 0 END + CASE WHEN k % 40 < 3 THEN 15 WHEN k % 40 < 7 THEN 5 WHEN k % 40 > 30 THEN -10 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 0 WHEN k % 120 < 14 THEN 15 WHEN k % 120 > 90 THEN -10 ELSE 0 END)) END AS r,
    CAST(place AS INTEGER) AS l, greatest(0, 100 - 60 * coalesce(n_public, 0) - 30 * coalesce(n_pending, 0)) AS c, CASE WHEN k % 3 = 0 THEN 95 WHEN k % 2 = 0 THEN 5 ELSE 30 END AS s, coalesce(n_public, 0) AS n_public FROM pen LEFT JOIN dup USING (k)),
g AS (SELECT *, CAST((25 * d + 15 * u + 20 * y + 10 * (r + l + c + s) + 50) // 100 AS BIGINT) AS score FROM f)
SELECT k AS id, CAST(d AS BIGINT) AS description_quality, CAST(u AS BIGINT) AS url_quality, CAST(y AS BIGINT) AS pay_confidence, CAST(r AS BIGINT) AS freshness, CAST(l AS BIGINT) AS location, CAST(c AS BIGINT) AS duplicate, CAST(s AS BIGINT) AS source_trust, score,
    concat_ws(',', CASE WHEN score < 85 THEN 'score' END, CASE WHEN r < 30 THEN 'freshness' END, CASE WHEN k % 5 = 4 THEN 'pay' END, CASE WHEN k % 5 IN (0, 4) THEN 'description' END, CASE WHEN n_public > 0 THEN 'duplicate' END, CASE WHEN k % 4 = 3 THEN 'url' END,
        CASE WHEN k % 23 = 0 THEN 'archive' END, CASE WHEN k % 3 > 0 AND k % 2 = 0 THEN 'risky_source' END) AS blocked_by FROM g
""")
def governance_scores(t: Tables) -> DataFrame:
    """Factors, score and gates of parts as pending records; one source is good and known by id, one bad and known by its organisation."""
    rows = _records(t)
    public = rows.where("id % 19 = 0").select((F.col("id") + 1_000_000).alias("id"), "organization", "title", F.lit("Oslo").alias("location"), F.lit("").alias("apply_url"))
    kind = "id string, organization string, provider string, source_classification string, trusted boolean, auto_publish boolean, manual_review_required boolean, scoring map<string,string>"
    sources = t.spark.createDataFrame(
        [("S1", "One", "Lever", "trusted_ats", True, False, False, {"parser_stability": "high"}), ("s2", "acme", "taleo", "low_confidence", False, False, True, {"duplicate_rate": "low", "malformed_pay_rate": "high"})], kind
    )
    archived = rows.where("id % 23 = 0").select("id")
    out = governance.governed(rows, public, sources, archived, "id", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return out.select("id", *governance.WEIGHTS, "score", F.array_join("blocked_by", ",").alias("blocked_by"))
