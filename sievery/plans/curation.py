"""Canonical records, pay in prose, quality checks, readiness, triage and transitions, over records made of the tables.

Eight shapes of posting are made of each row, by its number; the SQL says what each shape has to become.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.functions import article, pay, quality, text, url, values
from sievery.operators import board, canonical, findings, keys, lifecycle, triage
from sievery.plans.registry import Registry, Tables
from sievery.storage import Workspace, spread

plan = Registry()
QUERIES, SQL = plan.queries, plan.sql


def _decoded(sql: str) -> str:
    for name, value in text.ENTITIES:
        sql = "replace({}, '{}', '{}')".format(sql, name.replace("'", "''"), value.replace("'", "''"))
    return sql


def _squeezed(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '[ \\t\\n\\x0B\\f\\r\\x{{00A0}}\\x{{FEFF}}]+', ' ', 'g'), ' ')"


#: Titles, places, kinds of work, companies and pay of the shapes; {} is a price.
SHAPES = (
    ("Communications Manager - Remote", "Chicago, IL", "", "Acme Inc", "Salary range: ${a} - ${b} per year."),
    ("Data Analyst (Hybrid)", "", "", "Northwind", "We pay ${a} to ${b} annually for this role."),
    ("Policy Director | Blue Sky Group", "Boston, MA", "On-site", "Blue Sky", "Compensation: ${a}-${b}"),
    ("Video Producer - Berlin, Germany", "", "remote", "Wave", "The team builds things. Pay is competitive salary."),
    ("Web Developer — Full-time, apply now", "POINT(1 2) Austin, TX", "", "Stone", "Rate: $45/hour, for 20 hours."),
    ("Software Engineer https://x.example/1", "remote", "hybrid", "Leaf", "No customers pay for utility bills here."),
    ("<b>Research Associate</b>", "undefined", "", "Oak posted by admin", "This position is closed. ${a}"),
    ("Current Openings", "Location listed on application", "", "River", "Budget of the group grew by 40% in 2020."),
)
TERMS = triage.Terms(context=("climate", "energy"), functions=("communications", "policy", "data", "research"), boost=("director",), engineering=("software engineer",), sales=("sales",), trusted="Acme", broad="Wave")


def _postings(t: Tables) -> DataFrame:
    """Raw rows: p_partkey, kind, and the fields of a posting."""
    key, kind = F.col("p_partkey"), F.col("p_partkey") % len(SHAPES)
    low = F.format_number(F.floor(F.col("p_retailprice")).cast("long") * 40 + 1000, 0)
    high = F.format_number(F.floor(F.col("p_retailprice")).cast("long") * 50 + 1000, 0)

    def shape(i: int) -> Column:
        chosen = F.lit(SHAPES[0][i])
        for k, row in enumerate(SHAPES[1:], 1):
            chosen = F.when(kind == k, row[i]).otherwise(chosen)
        return chosen

    said = F.replace(F.replace(shape(4), F.lit("{a}"), low), F.lit("{b}"), high)
    url = F.concat(F.lit("https://jobs.example.org/job/"), key.cast("string"), F.when(kind == 5, "x/feed.xml").otherwise("x"))
    return spread(t.part.select("p_partkey", "p_retailprice"), "p_partkey").select(
        "p_partkey", kind.alias("kind"), shape(0).alias("title"), shape(1).alias("location"), shape(2).alias("workplace_type"), shape(3).alias("organization"),
        F.concat(F.lit("<p>The person leads work on climate and energy with the team, writes, plans and reports.</p><p>"), said, F.lit("</p>")).alias("description"),
        url.alias("apply_url"), url.alias("source_url"), F.lit("").alias("job_type"), F.when(kind == 2, "renewable power").otherwise("").alias("sector"), F.lit("made").alias("source"),
    )




def _canonical(t: Tables) -> DataFrame:
    return canonical.canonical(_postings(t), F.lit("2024-02-01").cast("date"), keep=("p_partkey",))


_PRICES = "SELECT p_partkey, p_partkey % 8 AS kind, CAST(floor(p_retailprice) AS BIGINT) * 40 + 1000 AS a, CAST(floor(p_retailprice) AS BIGINT) * 50 + 1000 AS b FROM part"
_RANGE = "'$' || format('{:,}', a) || '–$' || format('{:,}', b) || ' / year'"


def _case(*values: str | None, of: str = "kind") -> str:
    return f"CASE {of} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values) if v is not None) + " END"


@plan.query(f"""
SELECT p_partkey,
    {_case("'Communications Manager'", "'Data Analyst'", "'Policy Director'", "'Video Producer'", "'Web Developer'", "'Software Engineer'", None, "'Current Openings'")} AS title,
    {_case("'high'", "'high'", "'high'", "'high'", "'high'", "'high'", None, "'low'")} AS title_confidence,
    {_case("'Acme Inc'", "'Northwind'", "'Blue Sky'", "'Wave'", "'Stone'", "'Leaf'", None, "'River'")} AS organization,
    {_case("'Chicago, IL'", "'Hybrid / Anywhere'", "'Boston, MA'", "'Berlin, Germany'", "'Austin, TX'", "'Remote'", None, "'Remote'")} AS location,
    {_case("'Remote'", "'Hybrid'", "'On-site'", "'Remote'", "''", "'Hybrid'", None, "''")} AS workplace_type,
    {_case("'Communications'", "'Data'", "'Policy'", "'Video'", "'Engineering'", "'Engineering'", None, "''")} AS specialization,
    CASE kind WHEN 2 THEN 'Clean Energy' ELSE '' END AS sector, 'Full-time' AS job_type, DATE '2024-02-01' AS date_posted
FROM ({_PRICES}) WHERE kind <> 6
""")
def canonical_projection(t: Tables) -> DataFrame:
    """The eight shapes as canonical records; the closed one is excluded."""
    out = _canonical(t)
    return out.select("p_partkey", "title", "title_confidence", "organization", "location", "workplace_type", "specialization", "sector", "job_type", "date_posted")


@plan.query(f"""
SELECT p_partkey, CASE WHEN kind < 3 THEN {_RANGE} WHEN kind = 4 THEN '$45/hr' ELSE '' END AS salary,
    CASE WHEN kind < 3 THEN CAST(a AS DOUBLE) WHEN kind = 4 THEN 45.0 END AS salary_min, CASE WHEN kind < 3 THEN CAST(b AS DOUBLE) WHEN kind = 4 THEN 45.0 END AS salary_max,
    CASE WHEN kind < 3 THEN 'year' WHEN kind = 4 THEN 'hour' ELSE 'Unknown' END AS salary_period, CASE WHEN kind IN (5, 7) THEN 'none' ELSE 'description_body' END AS pay_parse_source
FROM ({_PRICES}) WHERE kind <> 6
""")
def pay_from_prose(t: Tables) -> DataFrame:
    """Pay that the descriptions state, and no pay where they speak of other amounts."""
    return _canonical(t).select("p_partkey", "salary", "salary_min", "salary_max", "salary_period", "pay_parse_source")


@plan.query("""
WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r\\x{00A0}\\x{FEFF}]+', ' ', 'g'), ' ') AS x FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, turn, x, unnest(range(1, length(x) + 1)) AS pos FROM c),
w AS (SELECT DISTINCT conv_id, turn, substr(x, greatest(pos - 21, 0) + 1, pos + 29 - greatest(pos - 21, 0)) AS piece FROM p WHERE substr(lower(x), pos, 3) = 'the')
SELECT conv_id, turn, count(*) AS n_windows, CAST(sum(length(piece)) AS BIGINT) AS n_chars FROM w GROUP BY conv_id, turn
""")
def pay_windows(t: Tables) -> DataFrame:
    """Surroundings of a marker, 20 characters ahead of it to 30 behind its start."""
    found = t.conversations.where(F.col("text").isNotNull()).select("conv_id", "turn", F.explode(pay.windows(F.col("text"), 20, 30, ("the",))).alias("piece"))
    return found.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_windows"), F.sum(F.length("piece")).alias("n_chars"))


@plan.query(f"""
SELECT p_partkey, kind NOT IN (5, 7) AS ready, {_case(*["''"] * 5, "'invalid_source_url,invalid_apply_url'", None, "'low_title_confidence'")} AS reasons
FROM ({_PRICES}) WHERE kind <> 6
""")
def public_readiness(t: Tables) -> DataFrame:
    # Written, so that a field is not made anew wherever the score reads it.
    out = Workspace(t.spark).table(_canonical(t), "canonical")
    return out.withColumn("r", quality.readiness(quality.of(out))).select("p_partkey", "r.ready", F.array_join("r.reasons", ",").alias("reasons"))


@plan.query(f"""
SELECT p_partkey, {_case("'review_ready'", "'review_ready'", "'review_ready'", "'rejected_noise'", "'rejected_noise'", "'rejected_noise'", "'rejected_noise'", "'needs_cleanup'")} AS bucket,
    {_case("'meets review-ready threshold'", "'meets review-ready threshold'", "'meets review-ready threshold'", "'high-volume source missing climate context or priority specialization'", "'low sustainability or priority specialization relevance'", "'low sustainability or priority specialization relevance'", "'closed_application'", "'low-confidence title parse'")} AS reason
FROM ({_PRICES})
""")
def triage_pending(t: Tables) -> DataFrame:
    """Buckets of the shapes: excluded ones first, then the first rule that holds."""
    raw = _postings(t)
    clean = Workspace(t.spark).table(_canonical(t), "canonical")
    kept = triage.triaged(clean, TERMS, F.lit("")).select("p_partkey", "triage.bucket", "triage.reason")
    out = raw.select("p_partkey", canonical.exclusion(quality.of(raw)).alias("reason")).where("reason <> ''")
    return kept.unionByName(out.select("p_partkey", F.lit("rejected_noise").alias("bucket"), "reason"))


def _one(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else p for p in patterns)


_SAID = "lower(flat)"
_COUNT = lambda phrases: " + ".join(f"CAST(contains({_SAID}, '{p}') AS INTEGER)" for p in phrases)
#: Findings in texts, over doc_id, text, flat (white space normalised) and title.
_IN_TEXT = f"""
    SELECT doc_id, 'dead_role' AS "check" FROM d WHERE regexp_matches(title || ' ' || flat, '{_one(canonical.CLOSED)}') UNION ALL
    SELECT doc_id, 'structure' FROM d WHERE length(text) > 500 AND NOT contains(text, chr(10)) UNION ALL
    SELECT doc_id, 'structure' FROM d WHERE length(text) >= 200 AND regexp_matches(text, '[•●○]') AND regexp_matches(text, '(?m)^[ \\t]*[•●○*-]\\s') AND regexp_matches(text, '[^\\n \\t][ \\t]*[•●○]\\s') UNION ALL
    SELECT doc_id, 'description' FROM d WHERE regexp_matches(text, '(?i)viewBox|<svg|<span[> ]|<div[> ]|<style') UNION ALL
    SELECT doc_id, 'description' FROM d WHERE {_COUNT(findings.SEVERAL_ROLES)} >= 3 UNION ALL
    SELECT doc_id, 'description' FROM d WHERE ({" OR ".join(f"starts_with({_SAID}, '{p}')" for p in findings.OTHER_SECTIONS)}) AND length(text) > 150 AND {_COUNT(findings.ROLE_PHRASES)} = 0
"""
_TEXTS = f"SELECT doc_id, coalesce(text, '') AS text, {_squeezed("coalesce(text, '')")} AS flat"


@plan.query(f"""
WITH d AS ({_TEXTS}, CASE doc_id % 5 WHEN 0 THEN '$600,000' WHEN 1 THEN '$0' WHEN 2 THEN '$6' ELSE '' END AS salary, doc_id % 7 AS k, CASE doc_id % 7 WHEN 1 THEN 'Analyst (Data' WHEN 2 THEN 'Hybrid' ELSE 'Data Analyst' END AS title FROM documents),
f AS ({_IN_TEXT} UNION ALL
    SELECT doc_id, 'invalid_pay' FROM d WHERE salary <> '' UNION ALL
    SELECT doc_id, 'title_location' FROM d WHERE k IN (1, 2) UNION ALL
    SELECT doc_id, 'bad_link' FROM d WHERE k = 3 UNION ALL
    SELECT doc_id, 'work_mode' FROM d WHERE k = 4)
SELECT "check", count(*) AS n_findings, count(DISTINCT doc_id) AS n_records FROM f GROUP BY "check"
""")
def quality_checks(t: Tables) -> DataFrame:
    """Findings by check, over documents as descriptions with made fields."""
    k = F.col("doc_id") % 7
    records = t.documents.select(
        "doc_id", F.col("text").alias("description"),
        F.when(k == 1, "Analyst (Data").when(k == 2, "Hybrid").otherwise("Data Analyst").alias("title"),
        F.when(k == 3, "https://www.indeed.com/viewjob?jk=1").otherwise("https://example.org/job/1").alias("source_url"),
        F.when(k == 4, "Remote").otherwise("Boston, MA").alias("location"), F.lit("remote").alias("workplace_type"),
        F.when(F.col("doc_id") % 5 == 0, "$600,000").when(F.col("doc_id") % 5 == 1, "$0").when(F.col("doc_id") % 5 == 2, "$6").otherwise("").alias("salary"),
    )
    found = findings.findings(records, "doc_id")
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("doc_id").alias("n_records"))


@plan.query(f"""
WITH d AS ({_TEXTS}, CASE WHEN doc_id % 2 = 0 THEN 'Remote' ELSE 'Data Analyst' END AS title FROM documents),
f AS ({_IN_TEXT} UNION ALL SELECT doc_id, 'invalid_pay' FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'title_location' FROM d WHERE doc_id % 2 = 0)
SELECT doc_id, count(*) AS n_findings, string_agg(DISTINCT "check", ',' ORDER BY "check") AS checks, CASE WHEN bool_and("check" IN ({", ".join(f"'{c}'" for c in findings.REPAIRABLE)})) THEN 'repair' ELSE 'review' END AS route FROM f GROUP BY doc_id
""")
def repair_routing(t: Tables) -> DataFrame:
    """Where documents with findings go."""
    records = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "Remote").otherwise("Data Analyst").alias("title"), F.when(F.col("doc_id") % 3 == 0, "$0").otherwise("").alias("salary"), F.col("text").alias("description"))
    return findings.routed(findings.findings(records, "doc_id"), "doc_id")


_RECORDS = """
r AS (SELECT o_orderkey AS id, o_orderkey % 6 AS kind, TIMESTAMP '2024-02-01 00:00:00' AS now, o_orderdate AS seen FROM orders)
"""


def _records(t: Tables) -> DataFrame:
    """Stored records of orders, in six situations: fresh, past their end, old, with a deadline, hidden, and never published."""
    kind, now = F.col("o_orderkey") % 6, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    at = lambda days: now - F.expr(f"INTERVAL {days} DAYS")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), kind.alias("kind"),
        F.when(kind == 5, "pending").otherwise("published").alias("status"), (kind != 5).alias("published"), (kind != 4).alias("public_visibility"),
        F.when(kind == 3, "Apply by January 15, 2024.").otherwise("Open until filled.").alias("description"),
        F.when(kind == 1, at(1)).otherwise(now + F.expr("INTERVAL 3 DAYS")).alias("expires_at"),
        F.when(kind == 5, None).when(kind == 2, at(9)).otherwise(at(2)).alias("first_published_at"),
        at(2).alias("updated_at"), at(2).alias("last_seen_at"), at(2).alias("last_checked_at"), at(2).alias("last_verified_at"),
        F.lit("verified").alias("verification_status"), F.lit("manual").alias("verification_method"), F.lit("").alias("stale_reason"), F.lit("live").alias("source_status"),
        F.lit(0).cast("long").alias("stale_score"), F.lit(1).cast("int").alias("failed_sync_count"), F.element_at(F.array(F.lit("live"), F.lit("dead"), F.lit("uncertain")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("mode"),
    )


@plan.query(f"""
WITH {_RECORDS},
s AS (SELECT id, kind, id % 3 AS mode FROM r),
o AS (SELECT id, CASE WHEN kind = 3 THEN 'expired' WHEN kind IN (0, 4, 5) THEN 'kept' WHEN mode = 0 THEN 'extended' WHEN mode = 1 THEN 'removed' ELSE 'needs_review' END AS outcome, kind FROM s)
SELECT id, outcome, CASE WHEN outcome IN ('expired', 'removed') THEN 'archived' WHEN outcome = 'needs_review' OR kind = 5 THEN 'pending' ELSE 'published' END AS status,
    CASE WHEN outcome IN ('expired', 'removed', 'needs_review') OR kind = 5 THEN false ELSE true END AS published,
    CASE outcome WHEN 'needs_review' THEN 2 WHEN 'kept' THEN 1 ELSE 0 END AS failed_sync_count,
    CAST(CASE outcome WHEN 'expired' THEN 100 WHEN 'removed' THEN 100 WHEN 'needs_review' THEN 34 ELSE 0 END AS BIGINT) AS stale_score FROM o
""")
def stale_review(t: Tables) -> DataFrame:
    """Outcome of a review of stored records, and what it changes."""
    out = lifecycle.reviewed(_records(t), F.col("mode"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return out.select("id", "outcome", "status", "published", "failed_sync_count", "stale_score")


@plan.query(f"""
WITH {_RECORDS}
SELECT id, CASE WHEN kind = 3 THEN 'expired' ELSE 'verified' END AS verification_status, CASE WHEN kind = 3 THEN 'deadline_detected' ELSE 'manual' END AS verification_method,
    CASE WHEN kind = 3 THEN 'application deadline has passed' ELSE '' END AS stale_reason,
    CASE kind WHEN 3 THEN TIMESTAMP '2024-01-15 00:00:00' WHEN 5 THEN TIMESTAMP '2024-02-08 00:00:00' WHEN 1 THEN TIMESTAMP '2024-02-08 00:00:00' ELSE TIMESTAMP '2024-02-08 00:00:00' END AS expires_at,
    CASE kind WHEN 5 THEN TIMESTAMP '2024-02-01 00:00:00' WHEN 2 THEN TIMESTAMP '2024-01-23 00:00:00' ELSE TIMESTAMP '2024-01-30 00:00:00' END AS first_published_at,
    CASE WHEN kind = 3 THEN 'removed' ELSE 'live' END AS source_status FROM r
""")
def publish_lifecycle(t: Tables) -> DataFrame:
    out = lifecycle.published(_records(t), F.lit(True), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return out.select("id", "verification_status", "verification_method", "stale_reason", "expires_at", "first_published_at", "source_status")


@plan.query("""
WITH e AS (SELECT event_id, user_id, event_type, ts, value FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM e),
f AS (SELECT user_id, event_type, min(event_id) AS first_id FROM e GROUP BY ALL),
t AS (SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS tags FROM f GROUP BY user_id)
SELECT 'user::' || CAST(w.user_id AS VARCHAR) AS key, w.event_id, w.value, t.tags FROM w JOIN t ON w.user_id = t.user_id WHERE place = 1
""")
def merge_duplicates(t: Tables) -> DataFrame:
    """The latest row of each key with the tags of all its rows."""
    rows = t.events.select("event_id", "user_id", "ts", "value", F.array("event_type").alias("tags"))
    out = canonical.merged(rows, F.concat(F.lit("user::"), F.col("user_id").cast("string")), "ts", "event_id", "tags")
    return out.select("key", "event_id", "value", F.array_join("tags", ",").alias("tags"))


@plan.query("""
WITH p AS (SELECT page_id, page_id % 6 AS kind FROM pages)
SELECT page_id, kind = 0 AS valid, CASE kind WHEN 0 THEN 'review_ready' WHEN 2 THEN 'needs_cleanup' ELSE 'rejected_noise' END AS bucket,
    CASE kind WHEN 1 THEN 'manual_source_generic_non_job_title' WHEN 2 THEN 'manual_source_empty_title_recoverable_job_url' WHEN 3 THEN 'manual_source_missing_url' WHEN 4 THEN 'manual_source_non_job_url' WHEN 5 THEN 'manual_source_missing_organization' END AS reason FROM p
""")
def manual_candidates(t: Tables) -> DataFrame:
    """Candidates from sources that are read by hand, in six situations."""
    kind = F.col("page_id") % 6
    rows = t.pages.select(
        "page_id", F.when(kind == 1, "About us").when(kind == 2, "").otherwise("Policy Analyst").alias("title"), F.when(kind == 5, " ").otherwise("Acme").alias("organization"),
        F.when(kind == 3, "").when(kind == 4, "https://example.org/news/1").otherwise(F.concat(F.lit("https://example.org/job/"), F.col("page_id").cast("string"))).alias("original_url"), F.lit("").alias("description"),
    )
    return triage.manual_candidates(rows).select("page_id", "manual.valid", "manual.bucket", "manual.reason")


_CUT = "CASE WHEN length({0}) <= 170 THEN {0} WHEN length(regexp_extract(substr({0}, 1, 171), '(?s)^(.*) [^ ]*$', 1)) > 102 THEN trim(regexp_extract(substr({0}, 1, 171), '(?s)^(.*) [^ ]*$', 1), ' ') || '…' ELSE trim(substr({0}, 1, 170), ' ') || '…' END"


@plan.query(f"""
WITH t AS (SELECT doc_id, {_squeezed(_decoded("regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g')"))} AS x FROM documents),
s AS (SELECT *, list_filter(list_transform(regexp_extract_all(x, '([^.!?]+[.!?]+)', 1), lambda s: trim(s, ' ')), lambda s: s <> '') AS l FROM t)
SELECT doc_id, {_CUT.format('x')} AS short, coalesce(l[len(l)], x) AS last FROM s
""")
def article_excerpt(t: Tables) -> DataFrame:
    """Texts cut at a word, and their last sentences."""
    rows = t.documents.select("doc_id", article.plain(F.col("text")).alias("x"))
    return rows.select("doc_id", article.truncate_at_word(F.col("x")).alias("short"), article.last_sentence(F.col("x")).alias("last"))


@plan.query("""
SELECT page_id, CASE WHEN h = '' THEN NULL ELSE array_to_string(list_transform(string_split(trim(regexp_replace(h, '[-_]+', ' ', 'g'), ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS name
FROM (SELECT page_id, regexp_extract(regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www[.]', ''), '([^.]+)[.][^.]+$', 1) AS h FROM pages)
""")
def organization_from_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", url.organization(F.col("url"))["name"].alias("name"))


@plan.query("""
SELECT source, n, round(n * 100.0 / (SELECT count(*) FROM documents), 1) AS percent FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) WHERE n > 3
""")
def board_diversity(t: Tables) -> DataFrame:
    return board.shares(t.documents, "source", 3)


_AREAS = {"data": "data|number", "people": "people|team", "water": "water|river", "none": "zzzzzz"}


@plan.query(" UNION ALL ".join(f"SELECT '{a}' AS area, count(*) FILTER (regexp_matches(lower(text), '{p}')) AS n FROM documents" for a, p in _AREAS.items()))
def mission_areas(t: Tables) -> DataFrame:
    return board.areas(t.documents, F.col("text"), _AREAS)


@plan.query("""
WITH pub AS (SELECT * FROM orders WHERE o_orderkey % 10 < 6), pen AS (SELECT * FROM orders WHERE o_orderkey % 10 >= 6)
SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS example FROM pen WHERE o_custkey NOT IN (SELECT o_custkey FROM pub) GROUP BY o_custkey HAVING count(*) >= 1
""")
def waiting_elsewhere(t: Tables) -> DataFrame:
    named = t.orders.withColumn("title", F.col("o_orderpriority"))
    return board.waiting_elsewhere(named.where("o_orderkey % 10 < 6"), named.where("o_orderkey % 10 >= 6"), "o_custkey", 1)


@plan.query("""
WITH pub AS (SELECT * FROM documents WHERE doc_id % 4 > 0), n AS (SELECT count(*) AS r, count(DISTINCT lower(source)) AS o, count(*) FILTER (regexp_matches(text, '^[)][ ]*[A-Z]')) AS b FROM pub),
p AS (SELECT count(*) AS p, count(*) FILTER (lang <> 'en') AS f FROM documents WHERE doc_id % 4 = 0), g AS (SELECT count(*) AS g FROM documents WHERE doc_id % 8 = 0),
a AS (SELECT count(*) AS a FROM (VALUES ('nowhere'), ('elsewhere')) v(name) WHERE name NOT IN (SELECT lower(source) FROM pub WHERE source IS NOT NULL)),
c AS (SELECT 'failure' AS level, 'published_missing' AS "check", g AS n, g > 0 AS hit FROM g UNION ALL SELECT 'warning', 'expected_missing', a, a > 0 FROM a UNION ALL SELECT 'warning', 'broad_sources', f, f > p * 0.4 FROM p
    UNION ALL SELECT 'failure', 'broken_opening', b, b > 0 FROM n UNION ALL SELECT 'warning', 'few_organizations', o, o < 15 FROM n UNION ALL SELECT 'warning', 'few', r, r < 30 FROM n UNION ALL SELECT 'failure', 'critically_few', r, r < 20 FROM n)
SELECT level, "check", n FROM c WHERE hit
""")
def editorial_health(t: Tables) -> DataFrame:
    """Documents as a board: three of four are public, the others pending, and every eighth was published and is gone."""
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("organization"), F.lit("").alias("salary"), F.col("text").alias("description"), "lang")
    expected = t.spark.createDataFrame([("nowhere",), ("elsewhere",)], "name string")
    return board.health(d.where("id % 4 > 0"), d.where("id % 4 = 0"), d.where("id % 8 = 0").select("id"), F.coalesce(F.col("lang") != "en", F.lit(False)), expected)


@plan.query("""
WITH arc AS (SELECT DISTINCT trim(text, ' ') AS k FROM documents WHERE doc_id % 5 = 0 AND trim(text, ' ') <> ''),
f AS (SELECT CASE WHEN doc_id % 5 < 3 THEN 'public' ELSE 'pending' END AS dataset FROM documents WHERE doc_id % 5 > 0 AND trim(text, ' ') IN (SELECT k FROM arc))
SELECT dataset, 'au' AS matched, count(*) AS n FROM f GROUP BY dataset
""")
def archive_diagnostics(t: Tables) -> DataFrame:
    """Documents equal to an archived one, in two datasets; a key of the weak kind alone stops nothing."""
    tagged = lambda d: keys.tagged(("au", F.md5(F.nullif(F.trim("text"), F.lit("")).cast("binary"))), ("ot", F.col("source")))
    d = t.documents.withColumn("status", F.when(F.col("doc_id") % 5 == 0, "Archived").otherwise("live"))
    archive = board.archive_of(d, tagged(d)).select(F.col("doc_id").alias("archive_id"), "keys")
    rest = d.where("doc_id % 5 > 0").withColumn("keys", tagged(d))
    return board.guard_diagnostics({"public": rest.where("doc_id % 5 < 3"), "pending": rest.where("doc_id % 5 >= 3")}, archive, "doc_id", "archive_id")


@plan.query("""
SELECT s_suppkey, row_number() OVER (ORDER BY lower(s_name), s_name, s_suppkey) AS place FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) ELSE s_name END AS s_name FROM supplier)
QUALIFY place <= 20
""")
def name_sort(t: Tables) -> DataFrame:
    """The first twenty suppliers by name as people sort names."""
    named = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.lower("s_name")).otherwise(F.col("s_name")).alias("name"))
    first = named.orderBy(values.by_name(F.col("name")), "s_suppkey").limit(20)
    rows = first.agg(F.array_sort(F.collect_list(F.struct(values.by_name(F.col("name")).alias("name"), "s_suppkey"))).alias("l"))
    return rows.select(F.posexplode("l").alias("at", "e")).select("e.s_suppkey", (F.col("at") + 1).cast("long").alias("place"))
