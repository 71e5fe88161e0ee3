"""Validation of a board, versions of a table against each other, and postings on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.functions import quality
from sievery.operators import merge, validation
from sievery.plans.registry import Registry, Tables
from sievery.sources import cards
from sievery.storage import Workspace

plan = Registry()
QUERIES, SQL = plan.queries, plan.sql


def _any(patterns: tuple[str, ...]) -> str:
    """Patterns as one, in the other engine's writing."""
    return "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns).replace("'", "''")


SPECIALIZATIONS = ("Data", "Policy", "Video", "Engineering", "Operations", "Strategy")
SALARIES = ("", "$50,000 - $60,000 / year", "n/a", "40,000 - 50,000", "$500 per month", "up to $", "60000 / year", "€45 per hour", "competitive")
WORK = ("Remote", "Hybrid", "On-site", "", "remote-ish")
KINDS = ("Full-time", "Part-time", "Contract", "Gig", "")
PLACES = ("Boston, MA", "", "POINT (1 2)", "Denver, CO", "Posted Mar 3, 2024", "locality unknown", "Remote")
SURE = ("high", "low", "medium", "")
#: Pairs of organisations that are mixed up: what src1 says must not name src2's.
RIVALS = (("src1", r"\bthe\b"),)


def _cycled(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _listed(values: tuple[str, ...], key: str = "doc_id") -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({key} % {len(values)} + 1 AS INTEGER)]"


def _board(t: Tables) -> DataFrame:
    """Documents as postings; their texts are descriptions, whose first words are titles."""
    key = F.col("doc_id")
    said = F.trim(F.coalesce("text", F.lit("")))
    path = F.concat(F.lit("./pages/"), F.when(key % 17 == 0, "role").otherwise(F.concat(F.lit("role-"), F.col("source"))), F.lit("-"), (key - F.when(key % 19 == 0, key % 2).otherwise(0)).cast("string"), F.lit(".html"))
    return t.documents.select(
        "doc_id", F.when(key % 13 == 0, "").otherwise(path).alias("page_url"), F.when(key % 23 == 0, "./pages/elsewhere.html").otherwise("").alias("expected_page_url"), F.col("source").alias("organization"),
        F.array_join(F.slice(F.split(said, "[ \\t\\n\\r]+"), 1, 4), " ").alias("title"), F.lit("high").alias("title_confidence"), _cycled(SALARIES, key).alias("salary"), _cycled(KINDS, key).alias("job_type"), _cycled(WORK, key).alias("workplace_type"), _cycled(PLACES, key).alias("location"),
        said.alias("description"), F.when(key % 29 == 0, "").otherwise(F.substring(said, 1, 120)).alias("description_snippet"), _cycled((*SPECIALIZATIONS, "Baking", ""), key).alias("specialization"), _cycled(SURE, key).alias("specialization_confidence"),
        F.when(key % 31 == 0, F.array(F.concat(F.lit("./old/"), (key % 5).cast("string")), path)).when(key % 37 == 0, F.array(F.concat(F.lit("./pages/gone-"), key.cast("string"), F.lit(".html")))).otherwise(F.array().cast("array<string>")).alias("redirect_paths"),
    )


def _found(t: Tables) -> DataFrame:
    """All findings: of rows, and between postings, pages, records and pending ones."""
    jobs, key = _board(t), F.col("doc_id")
    pages = jobs.where("doc_id % 41 > 0").select(F.col("page_url").alias("path")).where("path <> ''")
    records = jobs.select(
        (key + F.when(key % 43 == 0, 1_000_000).otherwise(0)).alias("doc_id"), F.when(key % 10 == 3, "another").otherwise(F.col("organization")).alias("organization"), F.when(key % 9 == 1, "$80 / month").otherwise(F.col("salary")).alias("salary"), F.when(key % 47 == 0, F.array(F.lit("title"), F.lit("salary"))).alias("field_conflicts"),
        F.lit("published").alias("status"), F.lit(True).alias("published"), F.lit(True).alias("public_visibility"), F.when(key % 86 == 0, "sync_error").otherwise("live").alias("source_status"),
    )
    pending = jobs.select((key * 3).alias("doc_id"), F.when(key % 4 == 0, "backlog").otherwise("review_ready").alias("triage_bucket"), (key % 1000).alias("resurfacing_priority_score"))
    edits = jobs.select("doc_id", "salary", "location", F.create_map(F.lit("salary"), F.when(key % 2 == 0, "$1"), F.lit("location"), F.lit("here")).alias("last"))
    parts = [
        validation.row_findings(jobs, "doc_id", SPECIALIZATIONS, RIVALS), validation.repeated(jobs, "duplicate_page_url", F.col("page_url")), validation.broken_links(jobs, "doc_id", pages), validation.redirect_findings(jobs, "doc_id", pages),
        validation.record_findings(jobs, records, "doc_id"), validation.pending_findings(pending, jobs, "doc_id"), validation.blanked_edits(edits, "doc_id", "last", ["salary", "location"]), validation.repeated(records, "duplicate_id", F.col("doc_id") % 1_000_000),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_MONTHLY = "regexp_matches(salary, '(?i)\\bmonth(?:ly)?\\b|/\\s*mo\\b')"
_USABLE = f"(regexp_matches(description, '[A-Za-z]{{3,}}') AND NOT regexp_matches(description, '{_any(quality.JUNK)}') AND lower(description) <> lower(title) AND lower(description) <> '' AND NOT regexp_matches(description, '^[>\"''< |/\\\\-]+$'))"
_SLUG = "regexp_replace(regexp_replace(lower(organization), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_PAGE = "regexp_extract(page_url, '([^/]*?)(?:\\.html)?$', 1)"


def _either(pattern: str) -> str:
    return f"(regexp_matches(description, '{pattern}') OR regexp_matches(snippet, '{pattern}'))"


_CASES = {
    "missing_page_url": "page_url = ''",
    "stale_page_url": "page_url <> '' AND expected <> '' AND page_url <> expected",
    "organization_page_url": f"{_SLUG} <> '' AND {_PAGE} <> '' AND NOT contains({_PAGE}, {_SLUG})",
    "invalid_pay": f"salary <> '' AND (NOT regexp_matches(salary, '[0-9]') OR regexp_matches(salary, '{_any(validation.BAD_PAY)}'))",
    "missing_currency_symbol": "NOT regexp_matches(salary, '(?i)[€$£]|\\b(?:USD|CAD|EUR|GBP)\\b') AND (regexp_matches(salary, '(?i)\\b\\d[\\d,]*(?:\\.\\d+)?\\s*(?:-|–|—|to)\\s*\\d[\\d,]*(?:\\.\\d+)?\\b') OR regexp_matches(salary, '(?i)^\\d[\\d,\\s]+(?:/\\s*(?:hour|day|week|month|year))?$'))",
    "tiny_monthly_pay": f"job_type = 'Full-time' AND NOT regexp_matches(title, '(?i)\\b(?:intern|internship|fellow|volunteer|part[-\\s]?time|contractor|hourly)\\b') AND {_MONTHLY} AND salary = '$500 per month'",
    "invalid_title": f"title = '' OR regexp_matches(title, '{_any(validation.BAD_TITLES)}') OR len(regexp_extract_all(title, '\\b(?:Remote|Hybrid|On-site|Onsite)\\b')) > 1",
    "invalid_workplace": "work NOT IN ('Remote', 'Hybrid', 'On-site', '')",
    "invalid_job_type": "job_type = 'Gig'",
    "invalid_location": f"regexp_matches(place, '{_any(validation.BAD_LOCATIONS)}')",
    "invalid_snippet": f"snippet = '' AND {_USABLE} OR regexp_matches(snippet, '{_any(validation.BAD_SNIPPETS)}')",
    "malformed_opening": _either(_any(validation.BAD_OPENINGS)),
    "malformed_template": _either(_any(validation.BAD_TEMPLATES)),
    "missing_description": f"NOT {_USABLE}",
    "lowercase_description": "(regexp_matches(description, '^[a-z][^!?]{12,}') AND NOT regexp_matches(description, '(?i)^(?:e\\.g\\.|i\\.e\\.)') OR regexp_matches(snippet, '^[a-z][^!?]{12,}') AND NOT regexp_matches(snippet, '(?i)^(?:e\\.g\\.|i\\.e\\.)'))",
    "unmapped_specialization": "field IN ('Baking', '')",
    "unsure_specialization": "field <> '' AND sure IN ('low', '')",
    "generic_specialization": "field IN ('Operations', 'Strategy') AND sure <> 'high'",
    "missed_video": f"field <> 'Video' AND regexp_matches(concat_ws(' ', title, description, snippet, ''), '{_any((validation.VIDEO,))}')",
    "identity_conflict": f"lower(organization) = 'src1' AND {_either(RIVALS[0][1])}",
}
_BOARD = f"""
j0 AS (SELECT doc_id AS k, coalesce(source, '') AS organization, source, trim(coalesce(text, ''), ' ') AS description FROM documents),
j AS (SELECT k, organization, source, description, CASE WHEN k % 13 = 0 THEN '' ELSE coalesce(p, '') END AS page_url, p, CASE WHEN k % 23 = 0 THEN './pages/elsewhere.html' ELSE '' END AS expected, array_to_string((string_split_regex(description, '[ \\t\\n\\r]+'))[1:4], ' ') AS title,
    {_listed(SALARIES, 'k')} AS salary, {_listed(KINDS, 'k')} AS job_type, {_listed(WORK, 'k')} AS work, {_listed(PLACES, 'k')} AS place, CASE WHEN k % 29 = 0 THEN '' ELSE trim(substr(description, 1, 120), ' ') END AS snippet, {_listed((*SPECIALIZATIONS, 'Baking', ''), 'k')} AS field, {_listed(SURE, 'k')} AS sure
    FROM (SELECT *, './pages/' || CASE WHEN k % 17 = 0 THEN 'role' ELSE 'role-' || source END || '-' || CAST(k - CASE WHEN k % 19 = 0 THEN k % 2 ELSE 0 END AS VARCHAR) || '.html' AS p FROM j0)),
pg AS (SELECT DISTINCT page_url AS path FROM j WHERE k % 41 > 0 AND page_url <> ''),
h AS (SELECT k, page_url AS target, unnest(CASE WHEN k % 31 = 0 THEN ['./old/' || CAST(k % 5 AS VARCHAR), p] WHEN k % 37 = 0 THEN ['./pages/gone-' || CAST(k AS VARCHAR) || '.html'] ELSE [] END) AS path FROM j),
hops AS (SELECT * FROM h WHERE path <> ''), edges AS (SELECT path, count(*) AS n, min(target) AS target FROM hops GROUP BY path),
r AS (SELECT k + CASE WHEN k % 43 = 0 THEN 1000000 ELSE 0 END AS id, k, CASE WHEN k % 10 = 3 THEN 'another' ELSE organization END AS kept FROM j),
q AS (SELECT k * 3 AS id, k FROM j),
f AS (
    {' UNION ALL '.join(f"SELECT '{name}' AS c, CAST(k AS VARCHAR) AS id FROM j WHERE {case}" for name, case in _CASES.items())}
    UNION ALL SELECT 'duplicate_page_url', page_url FROM j WHERE page_url <> '' GROUP BY page_url HAVING count(*) > 1
    UNION ALL SELECT 'broken_link', CAST(k AS VARCHAR) FROM j WHERE page_url <> '' AND page_url NOT IN (SELECT path FROM pg)
    UNION ALL SELECT 'redirect_loop', CAST(k AS VARCHAR) FROM hops WHERE path = target
    UNION ALL SELECT 'redirect_orphan', CAST(k AS VARCHAR) FROM hops WHERE path NOT IN (SELECT path FROM pg)
    UNION ALL SELECT 'redirect_duplicate', path FROM edges WHERE n > 1
    UNION ALL SELECT 'redirect_chain', path FROM edges WHERE target IN (SELECT path FROM edges)
    UNION ALL SELECT 'record_organization', CAST(j.k AS VARCHAR) FROM r JOIN j ON j.k = r.id WHERE r.kept <> '' AND {_SLUG} <> '' AND organization <> r.kept AND contains({_PAGE}, {_SLUG})
    UNION ALL SELECT 'pay_downgrade', CAST(r.id AS VARCHAR) FROM r JOIN j ON j.k = r.id WHERE r.k % 9 = 1
    UNION ALL SELECT 'overwrite_conflict', CAST(id AS VARCHAR) FROM r, range(2) WHERE k % 47 = 0
    UNION ALL SELECT 'disappeared', CAST(id AS VARCHAR) FROM r WHERE id NOT IN (SELECT k FROM j)
    UNION ALL SELECT 'removed_after_failed_fetch', CAST(id AS VARCHAR) FROM r WHERE k % 86 = 0 AND id NOT IN (SELECT k FROM j)
    UNION ALL SELECT 'pending_and_public', CAST(id AS VARCHAR) FROM q WHERE id IN (SELECT k FROM j)
    UNION ALL SELECT 'waiting_in_backlog', CAST(id AS VARCHAR) FROM q WHERE k % 4 = 0 AND k % 1000 >= 900
    UNION ALL SELECT 'blanked_edit', CAST(k AS VARCHAR) FROM j WHERE k % 2 = 0 AND salary = '' UNION ALL SELECT 'blanked_edit', CAST(k AS VARCHAR) FROM j WHERE place = '')
"""
_RULES = "(VALUES " + ", ".join(f"('{r.name}', '{r.level}', {str(r.repairable).lower()})" for r in validation.RULES) + ") AS rules(c, level, repairable)"
_COUNTED = """
parts AS (SELECT c, substr(md5(id), 1, 1) AS part, count(*) AS n, min(id) AS first FROM f GROUP BY ALL),
told AS (SELECT c, CAST(sum(n) AS BIGINT) AS n, list_sort(list(first))[1:10] AS examples FROM parts GROUP BY c)
"""


@plan.query(f"""
WITH {_BOARD}, {_COUNTED}
SELECT rules.c AS "check", level, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM documents), 4) AS share, coalesce(array_to_string(examples, ' '), '') AS examples FROM {_RULES} LEFT JOIN told ON told.c = rules.c
""")
def board_validation(t: Tables) -> DataFrame:
    """The report on documents as a board: every check with its count, share and examples."""
    total = t.documents.agg(F.count(F.lit(1))).scalar()
    return validation.report(t.spark, _found(t), total).select("check", "level", "n", "share", F.array_join("examples", " ").alias("examples"))


@plan.query(f"""
WITH {_BOARD}, p AS (SELECT * FROM {_RULES} WHERE repairable), o AS (SELECT c, row_number() OVER () AS place FROM {_RULES})
SELECT f.id, arg_min(f.c, o.place) AS reason, count(DISTINCT f.c) AS checks FROM f JOIN p ON p.c = f.c JOIN o ON o.c = f.c GROUP BY f.id
""")
def validation_routing(t: Tables) -> DataFrame:
    """Postings that go back to repair, and why."""
    return validation.routed(_found(t))


@plan.query(f"""
WITH {_BOARD}, now AS (SELECT c, count(*) AS n FROM f GROUP BY c), old AS (SELECT c, count(*) AS n FROM f WHERE CAST(substr(md5(id), 1, 1) AS VARCHAR) < '8' OR c LIKE 'redirect%' GROUP BY c)
SELECT rules.c AS "check", level, coalesce(old.n, 0) AS before, now.n AS after FROM {_RULES} JOIN now ON now.c = rules.c LEFT JOIN old ON old.c = rules.c WHERE now.n > coalesce(old.n, 0)
""")
def validation_drift(t: Tables) -> DataFrame:
    """Checks that got worse since a run that knew half of the findings."""
    # Written, so that two reports don't look at every text twice.
    found = Workspace(t.spark).table(_found(t).select("check", "id"), "found")
    earlier = found.where((F.substring(F.md5(F.col("id").cast("binary")), 1, 1) < "8") | F.col("check").startswith("redirect"))
    return validation.regressions(validation.report(t.spark, earlier, 1), validation.report(t.spark, found, 1))


_FIELDS = ("status", "price", "priority", "clerk")
_VERSIONS = """
o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p, o_orderpriority AS q, CAST(o_custkey AS VARCHAR) AS c FROM orders),
a AS (SELECT k, s AS status, p AS price, q AS priority, c AS clerk FROM o WHERE k % 7 > 0),
b AS (SELECT k, s AS status, CASE WHEN k % 5 = 0 THEN p + 1 ELSE p END AS price, CASE WHEN k % 11 = 0 THEN ' ' ELSE q END AS priority, CASE WHEN k % 4 = 0 THEN NULL ELSE c END AS clerk FROM o WHERE k % 9 > 0),
d AS (SELECT k, CASE WHEN k % 6 = 0 THEN 'X' ELSE s END AS status, CASE WHEN k % 15 = 0 THEN p + 2 WHEN k % 10 = 0 THEN p + 1 ELSE p END AS price, CASE WHEN k % 22 = 0 THEN NULL ELSE q END AS priority, c AS clerk FROM o WHERE k % 4 <> 3),
m AS (SELECT k, a.k IS NOT NULL AS ia, b.k IS NOT NULL AS ib, d.k IS NOT NULL AS id, {columns} FROM a FULL JOIN b USING (k) FULL JOIN d USING (k)),
u AS ({fields}),
l AS (SELECT k, field, CASE WHEN ia THEN 'A' ELSE '-' END || CASE WHEN NOT ib THEN '-' WHEN ia AND x IS NOT DISTINCT FROM y THEN 'A' ELSE 'B' END
    || CASE WHEN NOT id THEN '-' WHEN ia AND x IS NOT DISTINCT FROM z THEN 'A' WHEN ib AND y IS NOT DISTINCT FROM z THEN 'B' ELSE 'C' END AS pattern,
    coalesce(trim(x), '') <> '' OR coalesce(trim(y), '') <> '' OR coalesce(trim(z), '') <> '' AS any_value, CASE WHEN id THEN coalesce(trim(z), '') <> '' WHEN ib THEN coalesce(trim(y), '') <> '' ELSE coalesce(trim(x), '') <> '' END AS last_value FROM u),
e AS (SELECT k, field, pattern, any_value AND NOT last_value AS blanked FROM l WHERE len(list_distinct(list_filter(string_split(pattern, ''), lambda c: c <> '-'))) > 1)
""".format(
    columns=", ".join(f"a.{f} AS a_{f}, b.{f} AS b_{f}, d.{f} AS d_{f}" for f in _FIELDS),
    fields=" UNION ALL ".join(f"SELECT k, ia, ib, id, '{f}' AS field, CAST(a_{f} AS VARCHAR) AS x, CAST(b_{f} AS VARCHAR) AS y, CAST(d_{f} AS VARCHAR) AS z FROM m" for f in _FIELDS),
)


def _versions(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    o = t.orders.select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").cast("string").alias("clerk"))
    k = F.col("k")
    older = o.where("k % 9 > 0").withColumns({"price": F.when(k % 5 == 0, F.col("price") + 1).otherwise(F.col("price")), "priority": F.when(k % 11 == 0, " ").otherwise(F.col("priority")), "clerk": F.when(k % 4 != 0, F.col("clerk"))})
    newer = o.where("k % 4 <> 3").withColumns({
        "status": F.when(k % 6 == 0, "X").otherwise(F.col("status")), "price": F.when(k % 15 == 0, F.col("price") + 2).when(k % 10 == 0, F.col("price") + 1).otherwise(F.col("price")), "priority": F.when(k % 22 != 0, F.col("priority")),
    })
    return merge.compare_versions({"current": o.where("k % 7 > 0"), "older": older, "proposed": newer}, "k", list(_FIELDS))


@plan.query(f"""
WITH {_VERSIONS}, g AS (SELECT k, string_agg(field || ':' || pattern || CASE WHEN blanked THEN '!' ELSE '' END, ' ' ORDER BY field) AS differences FROM e GROUP BY k)
SELECT m.k, concat_ws(',', CASE WHEN ia THEN 'current' END, CASE WHEN ib THEN 'older' END, CASE WHEN id THEN 'proposed' END) AS present, coalesce(differences, '') AS differences FROM m LEFT JOIN g ON g.k = m.k
""")
def version_cross_check(t: Tables) -> DataFrame:
    """Three versions of orders: which has a row, and which changed what."""
    said = F.array_join(F.array_sort(F.transform("differences", lambda d: F.concat(d["field"], F.lit(":"), d["pattern"], F.when(d["blanked"], "!").otherwise("")))), " ")
    return _versions(t).select("k", F.array_join("present", ",").alias("present"), said.alias("differences"))


@plan.query(f"""
WITH {_VERSIONS}, parts AS (SELECT field, pattern, substr(md5(CAST(k AS VARCHAR)), 1, 1) AS part, count(*) AS n, count(*) FILTER (blanked) AS blanked, min(CAST(k AS VARCHAR)) AS first FROM e GROUP BY ALL)
SELECT field, pattern, CAST(sum(n) AS BIGINT) AS n, CAST(sum(blanked) AS BIGINT) AS blanked, array_to_string(list_sort(list(first))[1:10], ' ') AS examples FROM parts GROUP BY ALL
""")
def version_cross_counts(t: Tables) -> DataFrame:
    """Differences of the three versions by field, with how many lost a value and a few examples."""
    return merge.count_differences(_versions(t), "k").withColumn("examples", F.array_join("examples", " "))


@plan.query("""
WITH p AS (SELECT page_id, url, page_id % 4 AS kind, page_id % 3 + 1 AS n FROM pages), x AS (SELECT page_id, url, kind, unnest(range(n)) AS i FROM p)
SELECT page_id, CASE WHEN i = 1 THEN 'Data Analyst' ELSE 'Policy Director' END || CASE kind WHEN 3 THEN '' ELSE ' ' || chr(CAST(65 + i AS INTEGER)) END AS title,
    'https://jobs.example.org/jobs/' || CASE kind WHEN 3 THEN CASE WHEN i = 1 THEN 'data-analyst' ELSE 'policy-director' END ELSE CAST(page_id * 10 + i AS VARCHAR) END AS apply_url,
    CASE kind WHEN 0 THEN 'Remote' WHEN 1 THEN 'Boston, MA' WHEN 2 THEN 'hybrid' ELSE '' END AS location,
    CASE kind WHEN 0 THEN 'Research' ELSE '' END AS department, CASE kind WHEN 1 THEN 'Salary range: $' || format('{:,}', 50000 + 1000 * (page_id % 30)) || ' - $90,000 per year' ELSE '' END AS pay
FROM x WHERE kind < 3 OR i < 2
""")
def page_cards(t: Tables) -> DataFrame:
    """Careers pages in four ways of writing, built of pages behind their own markup: lists, table rows, blocks in capitals, and bare links."""
    key = F.col("page_id")
    i = lambda x: F.transform(F.sequence(F.lit(0).cast("long"), key % 3), x)
    name = lambda j: F.when(j == 1, "Data Analyst").otherwise("Policy Director")
    title = lambda j: F.concat(name(j), F.lit(" "), F.char((j + 65).cast("int")))
    number = lambda j: (key * 10 + j).cast("string")
    pay = F.concat(F.lit("$"), F.format_number((50000 + 1000 * (key % 30)).cast("long"), 0))
    listed = i(lambda j: F.concat(F.lit("<li><h3>"), title(j), F.lit("</h3> Department: Research<br>Remote <a class=b href='/jobs/"), number(j), F.lit("'>Apply now</a>")))
    table = i(lambda j: F.concat(F.lit("<tr><td><a href=\"https://jobs.example.org/jobs/"), number(j), F.lit("\">"), title(j), F.lit("</a></td><td>Location: Boston, MA</td><td>Salary range: "), pay, F.lit(" - $90,000 per year.</td></tr>")))
    blocks = i(lambda j: F.concat(F.lit("<DIV CLASS=job><STRONG>"), title(j), F.lit("</STRONG><P>This position is hybrid</P><A HREF='../jobs/"), number(j), F.lit("'>View role</A></DIV>")))
    bare = i(lambda j: F.concat(F.lit("<p><a href='/jobs/"), F.when(j == 1, "data-analyst").otherwise("policy-director"), F.lit("'>Learn more</a></p>")))
    html = (
        F.when(key % 4 == 0, F.concat(F.lit("<ul>"), F.array_join(listed, ""), F.lit("</ul>"))).when(key % 4 == 1, F.concat(F.lit("<table>"), F.array_join(table, ""), F.lit("</table>")))
        .when(key % 4 == 2, F.array_join(blocks, "\n")).otherwise(F.array_join(bare, ""))
    )
    pages = t.pages.select("page_id", F.lit("https://jobs.example.org/careers/").alias("url"), F.concat(F.coalesce("html", F.lit("")), F.lit("<main>"), html, F.lit("</main>")).alias("html"))
    found = cards.postings(pages)
    return found.where(F.col("apply_url").startswith("https://jobs.example.org/jobs/")).select("page_id", "title", "apply_url", "location", "department", "pay")
