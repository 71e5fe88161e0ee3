"""Functions and operators on small inputs with known results."""

import datetime
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sievery import storage
from sievery.functions import article, dates, fields, money, pay, quality, taxonomy, text, url, values
from sievery.operators import canonical, findings, lifecycle, state, triage
from sievery.sources import connectors, files


@pytest.fixture(scope="module")
def of(spark):
    """Values of a column builder over a list of rows of texts."""

    def run(build, *rows, kind="string"):
        width = len(rows[0]) if isinstance(rows[0], tuple) else 1
        table = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} {kind}" for k in range(width)))
        got = table.select("i", build(*[F.col(f"c{k}") for k in range(width)]).alias("x")).orderBy("i").collect()
        return [r.x for r in got]

    return run


PAY = [
    ("$80,000 - $100,000", 80000, 100000, "USD", "year", True), ("$80k-$100k", 80000, 100000, "USD", "year", True), ("USD 80k – 100k", 80000, 100000, "USD", "year", True),
    ("salary range: $70,000 - $90,000", 70000, 90000, "USD", "year", True), ("compensation: $70,000-$90,000", 70000, 90000, "USD", "year", True), ("USD 70,000 - 90,000", 70000, 90000, "USD", "year", True),
    ("CA$90k–CA$120k", 90000, 120000, "CAD", "year", True), ("CAD $90,000 to $120,000", 90000, 120000, "CAD", "year", True), ("€70k - €90k", 70000, 90000, "EUR", "year", True),
    ("EUR 70,000–90,000", 70000, 90000, "EUR", "year", True), ("£60k–£85k", 60000, 85000, "GBP", "year", True), ("$35/hour - $45/hour", 35, 45, "USD", "hour", True),
    ("$35 to $45 per hour", 35, 45, "USD", "hour", True), ("$35/hr", 35, 35, "USD", "hour", True), ("$800/day", 800, 800, "USD", "day", True), ("$5k/mo", 5000, 5000, "USD", "month", True),
    ("$5,000/month", 5000, 5000, "USD", "month", True), ("Salary not listed", None, None, "Unknown", "Unknown", False), ("Competitive", None, None, "Unknown", "Unknown", True),
    ("Up to $120k", None, 120000, "USD", "year", True), ("Starting at $75k", 75000, None, "USD", "year", True),
    ("Salary: Estimated at $75,780 – $84,200*; Based on experience", 75780, 84200, "USD", "year", True), ("$62,000 - $69,000", 62000, 69000, "USD", "year", True),
    ("Salary: Estimated at $62,280 – $69,200*; Based on experience", 62280, 69200, "USD", "year", True),
    ("Salary: Estimated at $54,450 – $60,500*; Based on experience & HR policies", 54450, 60500, "USD", "year", True),
    ("The HR department handles all recruiting. Salary: $75,000 - $90,000.", 75000, 90000, "USD", "year", True),
    ("41 147", None, None, "Unknown", "Unknown", False), ("", None, None, "Unknown", "Unknown", False), (None, None, None, "Unknown", "Unknown", False),
]


def test_parse_range(of):
    got = of(money.parse_range, *[c[0] for c in PAY])
    assert [tuple(r) for r in got] == [c[1:] for c in PAY]


def test_money(of):
    assert of(lambda p, q: money.currency(p, q), ("$5", "Toronto, Canada"), ("5", "Berlin"), ("5", "London"), ("5", "")) == ["CAD", "EUR", "GBP", "Unknown"]
    assert of(money.malformed, "41 147", "$41 147 - $52 000", "salary 00 - $5", "$41,147", None) == ["malformed_split_salary_fragment", "malformed_salary_range", "malformed_salary_range", "", ""]
    down = of(lambda a, b, c, p: money.suspicious_downgrade(a.cast("double"), b.cast("double"), c.cast("double"), p), ("57000", "57000", "570", "month"), ("57000", None, "60000", "year"), (None, None, "5", "month"))
    assert down == [True, False, False]


def test_dates(spark, of):
    day = datetime.date(2024, 1, 2)
    assert of(lambda x: dates.parse_or(x, F.lit(day)), "2024-03-04T05:06", "soon", None) == [datetime.date(2024, 3, 4), day, day]
    assert of(dates.deadline, "Apply by March 5, 2024.", "deadline: 2024-03-06", "whenever") == [datetime.date(2024, 3, 5), datetime.date(2024, 3, 6), None]
    assert of(lambda x: dates.long_date(x.cast("date")), "2024-03-05") == ["March 5, 2024"]
    assert of(lambda x: dates.add_days(x.cast("date"), 7).cast("date"), "2024-02-28") == [datetime.date(2024, 3, 6)]


def test_text(of):
    assert of(text.slugify_unicode, "<b>Crème Brûlée</b>!", None) == ["creme-brulee", None]
    assert of(text.compact_token, "Ab-c 1", None) == ["bc1", ""]
    assert of(text.decode_numeric_entities, "&#233;&#xE9; &#0; x") == ["éé &#0; x"]
    assert of(lambda x: F.split(text.structured_text(x), "\n+"), "<nav>menu</nav><h2>Role</h2><ul><li>one</li><li>two</li></ul>") == [["", "Role", "- one", "- two", ""]]
    assert of(text.distinct_sentences, "This sentence is long enough. THIS sentence is long enough! Short.") == [["This sentence is long enough"]]
    assert of(text.collapse_repeats, "apply now apply now today") == ["apply now today"]
    assert of(lambda x: text.count_matches(x, "a+"), "aa b a") == [2]
    assert of(text.snippet, "Hi. This is the first sentence that says something.") == ["This is the first sentence that says something"]
    assert of(text.title_case_keep, "senior iOS developer") == ["Senior IOS Developer"]
    assert of(text.fix_parentheses, "a (b) c) (d", None) == ["a (b) c d", None]
    assert of(text.links, "<A HREF='/x'>1</A><a class=\"k\" href=\"/y\">2</a><a href=/z>3</a><a href='/x'>4</a>") == [["/x", "/y", "/z"]]


def test_url_and_values(of):
    assert of(url.normalize_url, "HTTPS://Example.org/A/#top", "ftp://x", None) == ["https://example.org/A", "", ""]
    assert of(url.provider, "https://jobs.lever.co/x", "https://example.org", None) == ["lever", "custom", "custom"]
    assert of(url.is_tracking, "https://x.org/?utm_source=a", "https://x.org/?q=ref") == [True, False]
    assert of(url.absolute_url, ("https://x.org/a/b", "../c"), ("https://x.org", "https://y.org/d"), ("https://[bad", "x")) == ["https://x.org/c", "https://y.org/d", None]
    assert of(values.as_list, " a, ,b ", None) == [["a", "b"], []]
    old, new = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit(""), F.lit("c"), F.lit("3"))
    assert of(lambda x: values.merge_maps(old, new), "x") == [{"a": "1", "b": "2", "c": "3"}]
    assert of(lambda x: taxonomy.classify([(x, "high")], (("one", "a"), ("two", "b")), "none"), "b a", "b", "c", None) == [Row(label="one", confidence="high"), Row(label="two", confidence="high"), Row(label="none", confidence="low"), Row(label="none", confidence="low")]


def test_titles(of):
    cases = {
        ("Communications Manager - Remote", "Acme"): "Communications Manager", ("Data Analyst (Hybrid)", ""): "Data Analyst", ("Policy Director | Acme Inc", "Acme"): "Policy Director",
        ("Web Developer - Chicago, IL", ""): "Web Developer", ("Editor On-site", ""): "Editor", ("Writer — Full-time role", ""): "Writer", ("<b>Lead &amp; Planner</b>", ""): "Lead & Planner",
        ("Senior Editor - Politics", ""): "Senior Editor - Politics", (None, None): "", ("Remote", ""): "Remote",
    }
    assert of(fields.clean_title, *cases) == list(cases.values())
    assert [tuple(r) for r in of(fields.title_parts, "Producer - Berlin, Germany", "Analyst (Remote)", "Plain")] == [("Producer", "", "Berlin, Germany"), ("Analyst", "Remote", ""), ("Plain", "", "")]
    quality_of = {"Policy Analyst": "high", "Current Openings": "low", "Read my interview!": "low", "": "low", "Something": "low", "Editor March": "medium", "Manager Remote": "medium"}
    assert [r.confidence for r in of(fields.title_quality, *quality_of)] == list(quality_of.values())
    assert of(fields.title_quality, "Something")[0].warnings == ["missing_role_signal"]
    no = of(fields.no_title, ("Anna", "", ""), ("Analyst", "", ""), ("Acme Inc", "Acme", ""), ("Berlin", "", ""), ("Texas", "", ""), ("Our Impact Manager", "", ""), ("Policy Manager", "Acme", "Boston, MA"), (None, None, None))
    assert no == [True, False, True, True, True, True, False, True]


def test_places_and_kinds(of):
    got = of(fields.clean_location, ("Chicago, IL", "", ""), (None, "", ""), ("hybrid", "Hybrid", ""), ("POINT(1 2) Austin, TX", "", ""), ("Remote / Boston, MA", "", ""), ("Editor", "", "Editor"), ("anywhere", "Hybrid", ""))
    assert got == ["Chicago, IL", "Remote", "Hybrid / Anywhere", "Austin, TX", "Boston, MA", "Remote", "Hybrid / Anywhere"]
    assert of(fields.physical_location, "Boston, MA", "Remote", "US", "", None) == [True, False, False, False, False]
    assert of(fields.valid_location, "Boston", "locality x", "") == [True, False, False]
    assert of(fields.workplace, ("work from home", "", ""), ("", "3 days in office", ""), ("", "", "Boston, MA"), ("$50,000", "", ""), (None, None, None)) == ["Remote", "Hybrid", "On-site", "", ""]
    assert of(fields.employment_type, "contractor", "part_time", "Full-Time", "--", None, "Apprentice") == ["Contract", "Part-time", "Full-time", "Full-time", "Full-time", "Apprentice"]
    assert of(fields.sector, "renewable power", "ocean health", None) == ["Clean Energy", "Ocean Health", ""]
    assert of(fields.clean_organization, "Acme posted by admin", "| Oak |", None) == ["Acme", "Oak", ""]


def test_pay_in_prose(of):
    stated = of(pay.best_statement, "We build. Salary range: $70,000 - $90,000 per year. Join us.", "Customers pay for utility bills.", "Earn up to $30 per hour.", "Founded in 2019 with 40 people.", None)
    assert [s.startswith(x) for s, x in zip(stated, ["Salary range: $70,000 - $90,000 per year", "", "up to $30 per hour", "", ""], strict=True)] == [True] * 5
    assert stated[1] == stated[3] == stated[4] == ""
    ranges = "The annual salary for candidates based in Ohio is $50,000 - $60,000. The annual salary for candidates based in Utah: $45,000 to $58,000."
    assert of(pay.by_location, ranges, "none") == [Row(low=45000.0, high=60000.0, places=2), None]
    why = of(lambda t, p: pay.rejection(t, F.lit(None).cast("double"), F.lit(None).cast("double"), p), ("2024", "salary"), ("$50 20% of", "salary"), ("job id: 12345", ""), ("$70", "nothing"), ("$70", "salary"), ("", ""))
    assert why == ["looks_like_year", "looks_like_percentage", "looks_like_ats_field", "missing_pay_context", "", ""]
    assert of(lambda t: pay.rejection(t, F.lit(600000.0), F.lit(700000.0), t), "salary $600,000") == ["exceeds_max_threshold_500k"]
    assert of(pay.state, ("$5", "", ""), ("", "$x", ""), ("", "", ""), ("$5", "", "odd")) == ["clean", "uncertain_blocked", "absent_allowed", "uncertain_blocked"]


def test_canonical(spark):
    raw = [
        {"id": 1, "title": "Communications Manager - Remote", "organization": "Acme", "location": "Chicago, IL Remote", "description": "<p>The manager leads work on climate and energy. Salary range: $70,000 - $90,000 per year.</p>", "apply_url": "https://x.org/jobs/1", "source_url": "https://x.org/jobs/1"},
        {"id": 2, "title": "Editor", "organization": "Bad Corp", "description": "no longer accepting applications"},
        {"id": 3, "title": "Editor", "organization": "Blocked Co", "description": "fine"},
        {"id": 4},
    ]
    table = spark.createDataFrame([Row(**{k: r.get(k) for k in ("id", "title", "organization", "location", "description", "apply_url", "source_url")}) for r in raw], "id int, title string, organization string, location string, description string, apply_url string, source_url string")
    got = {r.id: r for r in canonical.canonical(table, F.lit("2024-01-01").cast("date"), ("blocked",), ("id",)).collect()}
    assert set(got) == {1, 4}
    one = got[1]
    assert (one.title, one.workplace_type, one.salary, one.salary_min, one.salary_max, one.specialization, one.job_type) == ("Communications Manager", "Remote", "$70,000–$90,000 / year", 70000.0, 90000.0, "Communications", "Full-time")
    assert got[4].title == "" and got[4].date_posted == datetime.date(2024, 1, 1)
    ready = canonical.canonical(table, F.lit("2024-01-01").cast("date"), ("blocked",), ("id",))
    ready = {r.id: r.r for r in ready.select("id", quality.readiness(quality.of(ready)).alias("r")).collect()}
    assert ready[1].ready and not ready[4].ready and "missing_title" in ready[4].reasons
    assert canonical.canonical(table.limit(0), F.lit("2024-01-01").cast("date")).count() == 0


def test_merged(spark):
    rows = [(1, "a", "2024-01-02", ["x", "y"]), (2, "a", "2024-01-03", ["y", "z"]), (3, "a", "2024-01-03", []), (4, "b", None, None)]
    got = {r.key: r for r in canonical.merged(spark.createDataFrame(rows, "n int, k string, at string, tags array<string>"), F.col("k"), "at", "n", "tags").collect()}
    assert (got["a"].n, got["a"].tags, got["b"].n, got["b"].tags) == (3, ["x", "y", "z"], 4, [])


def test_scores(of):
    assert of(quality.apply_url, "https://x.org/job/1", "https://x.org/feed/", "https://x.org/a.json", "https://apply.workable.com/x/j/AB1/", "https://apply.workable.com/x/", "") == [True, False, False, True, False, False]
    assert of(quality.mission_score, "climate policy and democracy", "nothing") == [27, 0]
    assert of(lambda t: quality.editorial_score(t, F.lit(4), F.lit(10)), "Director, remote, salary") == [13.0]
    assert of(quality.usable_description, ("Writes text.", "Editor", "Acme"), ("Editor", "editor", ""), ("see viewBox here", "", ""), ("12", "", "")) == [True, False, False, False]


def test_findings(spark):
    rows = [
        Row(id=1, title="Analyst (Data", location="Remote", workplace_type="remote", salary="$0", raw_salary="50%", source_url="https://indeed.com/x", apply_url="https://a.myworkdayjobs.com/apply/1", external_id="", description="<div>x</div>", status="closed", published="true"),
        Row(id=2, title="Analyst", location="Boston", workplace_type="remote", salary="$50,000", raw_salary="$50,000", source_url="https://x.bamboohr.com/careers/", apply_url="", external_id="", description="About us " + "we are many and do things. " * 30, status="", published=""),
        Row(id=3, title="hybrid", location=None, workplace_type=None, salary=None, raw_salary="pay is good and fair", source_url=None, apply_url=None, external_id=None, description="also hiring positions include open positions", status=None, published=None),
        Row(id=4, title="Analyst", location="Boston", workplace_type="", salary="", raw_salary="", source_url="", apply_url="", external_id="", description="fine", status="", published=""),
    ]
    found = findings.findings(spark.createDataFrame(rows), "id")
    got = {}
    for r in found.collect():
        got.setdefault(r.id, set()).add(r.issue)
    assert got[1] == {"location repeats the workplace", "status is closed but it is published", "salary is zero", "raw pay holds a percentage", "source is a generic board", "application form as address", "raw html", "unbalanced parentheses"}
    assert got[2] == {"careers page without a posting", "starts with another section", "one paragraph"}
    assert got[3] == {"raw pay is prose", "several roles", "title is a workplace"}
    assert 4 not in got
    assert {r.id: r.route for r in findings.routed(found, "id").collect()} == {1: "review", 2: "review", 3: "review"}


def test_triage(spark):
    terms = triage.Terms(context=("climate",), functions=("policy",), engineering=("software engineer",), broad="Board")
    base = {"title": "Policy Analyst", "organization": "Acme", "original_url": "https://x.org/job/1", "description": "Work on climate.", "salary": "", "title_confidence": "high", "source": "", "location": "Boston", "parse_warning": "", "manual_review_required": ""}
    cases = [
        ({}, "review_ready", "meets review-ready threshold"), ({"title": ""}, "rejected_noise", "missing title or organization"), ({"original_url": ""}, "rejected_noise", "missing or broken original_url"),
        ({"original_url": "https://x.org/careers/"}, "rejected_noise", "non-role listing or policy url"), ({"title": "Berlin"}, "rejected_noise", "non-role title"), ({"title_confidence": "low"}, "needs_cleanup", "low-confidence title parse"),
        ({"title": "Policy Intern"}, "rejected_noise", "internship pay missing or unclear"), ({"title": "Software Engineer", "description": "Code."}, "rejected_noise", "unrelated engineering or sales role without sustainability context"),
        ({"source": "Board", "description": "x"}, "rejected_noise", "high-volume source missing climate context or priority specialization"), ({"description": "x"}, "rejected_noise", "low sustainability or priority specialization relevance"),
        ({"parse_warning": "source board organization uncertain"}, "needs_cleanup", "source board organization uncertain"), ({"title": "Policy! Analyst"}, "needs_cleanup", "relevant role but scraped title needs cleanup"),
        ({"manual_review_required": "true"}, "review_ready", "manual review source"), ({"manual_review_required": "true", "title": "FAQ", "description": ""}, "rejected_noise", "manual_source_generic_non_job_title"),
    ]
    table = spark.createDataFrame([Row(n=i, **{**base, **c[0]}) for i, c in enumerate(cases)])
    got = {r.n: r.triage for r in triage.triaged(table, terms, F.lit("")).collect()}
    assert [(got[i].bucket, got[i].reason) for i in range(len(cases))] == [c[1:] for c in cases]
    excluded = triage.triaged(table.limit(1), terms, F.lit("closed_application")).first().triage
    assert (excluded.bucket, excluded.reason) == ("rejected_noise", "closed_application")
    manual = spark.createDataFrame([("Policy Analyst", "A", "https://x.org/job/1", ""), ("", "A", "https://x.org/news/1", "We seek a Donor Engagement Manager today"), ("ab cd", "A", "https://x.org/job/1", "")], "title string, organization string, original_url string, description string")
    assert [(r.manual.valid, r.manual.reason) for r in triage.manual_candidates(manual).collect()] == [(True, None), (False, "manual_source_non_job_url"), (False, "manual_source_generic_non_specific_title")]


def test_lifecycle(spark, of):
    assert of(lifecycle.source_status, "Verified", "pending", "aging", "expired", "fetch_failed", "odd", None) == ["live", "needs_review", "stale", "removed", "sync_error", "live", "live"]
    history = F.array().cast("array<struct<id:string,title:string,recorded_at:string>>")
    once = lambda i: lifecycle.identity_history(history, i, F.lit("t"), F.lit("now"))
    assert [len(x) for x in of(lambda i: lifecycle.identity_history(once(i), i, F.lit("u"), F.lit("later")), "a", "", None)] == [1, 0, 0]
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    got = of(lambda s, t: state.stale_score(t.cast("timestamp"), s, now), ("live", "2024-01-30"), ("removed", "2024-01-30"), ("needs_review", "2023-01-01"), ("live", None))
    assert got == [16, 100, 98, 80]


PAYLOADS = {
    "https://boards.greenhouse.io/x": {"jobs": [{"id": 1, "title": "A", "location": {"name": "L"}, "absolute_url": "https://g/1"}]},
    "https://jobs.lever.co/x": [{"id": "b", "text": "B", "categories": {"location": "L", "commitment": "Full"}, "hostedUrl": "https://l/1"}],
    "https://jobs.ashbyhq.com/x": {"jobs": [{"id": "c", "title": "C", "location": "L", "jobUrl": "https://a/1"}]},
    "https://x.bamboohr.com/careers": {"result": [{"id": "d", "jobOpeningName": "D", "location": {"city": "L"}}]},
    "https://x.recruitee.com": {"offers": [{"id": 5, "title": "E", "city": "L", "careers_url": "https://r/1"}]},
    "https://careers.smartrecruiters.com/x": {"content": [{"id": "f", "name": "F", "location": {"city": "L"}, "ref": "https://s/1"}]},
    "https://recruiting.paylocity.com/x": {"Jobs": [{"JobId": 7, "JobTitle": "G", "LocationName": "L"}]},
    "https://app.careerpuck.com/x": {"jobs": [{"id": "h", "title": "H", "location": "L", "publicUrl": "https://c/1"}]},
    "https://x.hire.trakstar.com": {"results": [{"id": "i", "title": "I", "location": {"city": "L"}, "hosted_url": "https://t/1"}]},
}


def test_dispatch(spark):
    rows = [(u, json.dumps(p)) for u, p in PAYLOADS.items()] + [("https://apply.workable.com/x", "| a |"), ("https://example.org", "{}"), ("https://jobs.lever.co/y", "not json")]
    got = connectors.dispatched(spark.createDataFrame(rows, "url string, payload string")).collect()
    assert len(got) == len(rows)
    known = {r.url: r for r in got}
    assert [known[u].title for u in PAYLOADS] == list("ABCDEFGHI") and {known[u].location for u in PAYLOADS} == {"L"}
    assert (known["https://apply.workable.com/x"].provider, known["https://apply.workable.com/x"].title, known["https://apply.workable.com/x"].raw_payload) == ("workable", None, "| a |")
    assert known["https://jobs.lever.co/y"].title is None
    one = connectors.from_json_provider(spark.createDataFrame([rows[1]], "url string, payload string"), "lever").collect()
    assert (one[0].title, one[0].job_type) == ("B", "Full")


def test_markup_sources(spark):
    page = lambda s: spark.createDataFrame([("u", s)], "url string, html string")
    markdown = "| Title | a | b | c | d | e | f |\n|---|---|---|---|---|---|---|\n| [Editor](https://x.org/1) | 1 | 2 | 3 | 4 | 5 | 6 |\n| short |"
    got = connectors.markdown_rows(spark.createDataFrame([("u", markdown)], "url string, payload string")).collect()
    assert [(r.cells[0], r.link) for r in got] == [("Editor", "https://x.org/1")]
    rss = "<rss><item><title><![CDATA[A &amp; B]]></title><link>https://x.org/1</link><pubDate>d</pubDate><description>t</description></item></rss>"
    assert [tuple(r) for r in connectors.rss_items(spark.createDataFrame([("u", rss)], "url string, payload string")).collect()] == [("u", "A & B", "https://x.org/1", "d", "t")]
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"T","hiringOrganization":{"name":"O"}},{"@type":"Other"}]}</script>'
    assert [(r.title, r.organization) for r in connectors.json_ld(page(ld)).collect()] == [("T", "O")]
    script = '<script>window.data = {"jobs":[{"title":"T","url":"/1"},{"title":""}]};</script>'
    assert [json.loads(r.object)["title"] for r in connectors.embedded_objects(page(script)).collect()] == ["T"]
    assert page('<script>window.pageData = {"a":1};</script>').select(connectors.embedded_assignment(F.col("html"), "pageData")).first()[0] == '{"a":1}'
    assert [(r.href, r.label) for r in connectors.anchors(page('<a href="/1"><b>One</b></a><a href="/2">Two</a>')).collect()] == [("/1", "One"), ("/2", "Two")]


def test_files(spark, tmp_path):
    at, schema = f"file://{tmp_path}/t", "k int, v string"
    table = spark.createDataFrame([(1, "a"), (2, "[object Object]"), (2, "b")], schema)
    assert files.read_json(spark, at, schema).count() == 0
    assert files.write_if_changed(table, at, table.schema) and not files.write_if_changed(table.orderBy(F.desc("v")), at, table.schema)
    # The table may be made of what it replaces.
    assert files.write_if_changed(files.read_json(spark, at, schema).where("k = 1"), at, table.schema)
    assert [tuple(r) for r in files.read_json(spark, at, schema).collect()] == [(1, "a")]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]
    assert {r.v for r in files.sanitized(table, spark.createDataFrame([(1,)], "k int"), "k").collect()} == {"", "b"}
    kept, path = spark.createDataFrame([(i,) for i in range(10)], "k int"), f"file://{tmp_path}/p"
    with pytest.raises(files.RefusedWrite):
        files.guarded_overwrite(kept.limit(0), kept, path, "k")
    with pytest.raises(files.RefusedWrite):
        files.guarded_overwrite(kept.where("k < 5"), kept, path, "k", kept.where("k = 7"))
    files.guarded_overwrite(kept.where("k < 5"), kept, path, "k", kept.where("k >= 5"))
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(files.RefusedWrite, match="largest"):
        files.write_limited(table, f"file://{tmp_path}/l", "k", 10)
    files.write_limited(table, f"file://{tmp_path}/l", "k", 10_000)
    assert files.bytes_by_source(table, "k").first().k == 2


def test_streaming(spark, tmp_path):
    from sievery.streaming import replay

    rows = [(1, 7, "publish", "2024-01-01 00:00:00"), (2, 7, "archive", "2024-01-01 00:00:00"), (3, 8, "error", "2024-01-02 00:00:00"), (4, 8, "error", "2024-01-03 00:00:00"), (5, 9, "error", "2024-01-01 00:00:00"), (6, 9, "view", "2024-01-02 00:00:00")]
    for i in range(2):
        spark.createDataFrame(rows[i::2], "event_id long, user_id long, event_type string, ts string").selectExpr("event_id", "user_id", "event_type", "CAST(ts AS TIMESTAMP) AS ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = lambda: spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    query = replay.latest_decisions(stream(), {"archive": 4, "publish": 2}, f"{tmp_path}/latest").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "latest").iterdir() if p.name.isdigit())
    assert {r.user_id: r.event_type for r in spark.read.parquet(f"{tmp_path}/latest/{last}").collect()}[7] == "archive"
    query = replay.failure_streaks(stream(), "error").writeStream.format("memory").queryName("streaks").outputMode("update").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert max(r.streak for r in spark.table("streaks").where("user_id = 8").collect()) == 2


def test_articles(of):
    html = "<p>Share this now.</p><p>The river town has a new library, which opens to all in the spring of the coming year, they say.</p><blockquote>Books are for everyone.</blockquote><h2>One</h2><h3>Two</h3>"
    assert of(lambda h: article.excerpt(F.lit("d"), h, F.lit("Library")), html, "", "no markup at all") == ["The river town has a new library, which opens to all in the spring of the coming year, they say.", "d", "no markup at all"]
    assert of(lambda h: article.pull_quote(h, F.lit("x")), html, "<p>Short.</p>", "") == ["Books are for everyone.", "Short.", "x"]
    assert of(article.contents, html) == [[Row(level=2, text="One"), Row(level=3, text="Two")]]
    long_ = "This first sentence is long enough to be taken as one. Then more."
    assert of(article.first_sentence, long_, "Short") == [long_[:54], "Short"]
    assert of(article.last_sentence, long_, "none") == ["Then more.", "none"]
    assert of(lambda x: article.truncate_at_word(x, 20), "one two three four five six") == ["one two three four…"]


def test_addresses_and_json(of):
    assert of(url.board_page, "https://apply.workable.com/acme/jobs/view/AB12/?x=1", "https://x.org/1") == ["https://apply.workable.com/acme/j/AB12/", "https://x.org/1"]
    assert of(url.organization, "https://river-town.teamtailor.com/jobs", "https://boards.greenhouse.io/blue_sky/jobs/1", "https://www.acme.org/x", "https://jobs.ashbyhq.com/acme", "none") == [Row(name="River Town", confidence="high"), Row(name="Blue Sky", confidence="medium"), Row(name="Acme", confidence="high"), None, None]
    assert of(values.flat_text, '{"z":"last","title":"first","n":{"a":[1,true,"x"]}}', "plain", None) == ["first last 1 x", "plain", None]


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    table = spark.createDataFrame([(i, "é" * 10, (i, "x" * 5), None) for i in range(20)], "id long, name string, pair struct<a:long,b:string>, none string")
    hinted = lambda df: "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(storage.broadcast_if_small(table, 20)) and not hinted(storage.broadcast_if_small(table, 19))
    assert not hinted(storage.broadcast_if_small(table, 20, 399)) and hinted(storage.broadcast_if_small(table.select("id"), 20, 0))
    assert hinted(storage.broadcast_if_small(table.where("id < 0"), 0, 0))


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        def __init__(self, master):
            self.conf, self.set = self, {"spark.master": master}.__setitem__
            self.get = {"spark.master": master}.get

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_folder(Unset(master))
    assert storage.shared_folder(Unset("local[2]")).startswith("file://")
