"""Checks of a board, versions against each other, and cards of pages, on small tables with known results."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievery.operators import audit, merge, validation
from sievery.sources import cards

GOOD = {
    "id": "1", "page_url": "./pages/analyst-acme.html", "expected_page_url": "", "organization": "Acme", "title": "Policy Analyst", "title_confidence": "high", "salary": "$50,000 - $60,000 / year", "job_type": "Full-time", "workplace_type": "Remote",
    "location": "Boston, MA", "description": "The analyst leads work on policy.", "description_snippet": "The analyst leads work.", "specialization": "Policy", "specialization_confidence": "high",
}
CASES = [
    ({}, set()),
    ({"page_url": " "}, {"missing_page_url"}),
    ({"page_url": None}, {"missing_page_url"}),
    ({"expected_page_url": "./pages/other-acme.html"}, {"stale_page_url"}),
    ({"page_url": "./pages/analyst-other.html"}, {"organization_page_url"}),
    ({"salary": "n/a"}, {"invalid_pay"}),
    ({"salary": "$ , 5"}, {"invalid_pay"}),
    ({"salary": "competitive"}, {"invalid_pay"}),
    ({"salary": ""}, set()),
    ({"salary": "50,000 - 60,000"}, {"missing_currency_symbol"}),
    ({"salary": "60 000 / year"}, {"missing_currency_symbol"}),
    ({"salary": "60,000 USD"}, set()),
    ({"salary": "$50 / month"}, {"tiny_monthly_pay"}),
    ({"salary": "$50 / month", "job_type": "Part-time"}, set()),
    ({"salary": "$50 / month", "title": "Policy Intern"}, set()),
    ({"title": ""}, {"invalid_title"}),
    ({"title": "Policy Analyst Remote"}, {"invalid_title"}),
    ({"title": "Remote Analyst, Remote Team"}, {"invalid_title"}),
    ({"title": "Why we need an analyst?"}, {"invalid_title"}),
    ({"title": "a b c d e f g h i j k l m"}, {"invalid_title"}),
    ({"title_confidence": "Low"}, {"invalid_title"}),
    ({"workplace_type": "at home"}, {"invalid_workplace"}),
    ({"workplace_type": None}, set()),
    ({"job_type": "Gig"}, {"invalid_job_type"}),
    ({"location": "POINT (1 2)"}, {"invalid_location"}),
    ({"location": "posted March 3, 2024"}, {"invalid_location"}),
    ({"description_snippet": ""}, {"invalid_snippet"}),
    ({"description_snippet": "the Previous one"}, {"invalid_snippet", "lowercase_description"}),
    ({"description": ") Acme hires"}, {"malformed_opening"}),
    ({"description_snippet": "Apply now for it"}, {"malformed_opening"}),
    ({"description": "Acme hires. The will lead."}, {"malformed_template"}),
    ({"description": ""}, {"missing_description"}),
    ({"description": "policy analyst"}, {"missing_description", "lowercase_description"}),
    ({"description": "e.g. work of many kinds"}, set()),
    ({"specialization": ""}, {"unmapped_specialization"}),
    ({"specialization": "Baking"}, {"unmapped_specialization"}),
    ({"specialization_confidence": ""}, {"unsure_specialization"}),
    ({"specialization": "Strategy", "specialization_confidence": "medium"}, {"generic_specialization"}),
    ({"title": "Video Editor"}, {"missed_video"}),
    ({"title": "Video Editor", "specialization": "Video"}, set()),
    ({"description": "The team at Zenith leads work."}, {"identity_conflict"}),
]


def test_row_findings(spark):
    rows = [tuple(str(i) if k == "id" else (GOOD | change)[k] for k in GOOD) for i, (change, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in GOOD))
    found = defaultdict(set)
    for r in validation.row_findings(df, "id", ("Policy", "Video", "Strategy"), (("acme", "(?i)zenith"),)).collect():
        found[int(r.id)].add(r.check)
    assert [found[i] for i in range(len(CASES))] == [expected for _, expected in CASES]


def test_findings_between_rows(spark):
    jobs = spark.createDataFrame(
        [("1", "a.html", ["old.html", "a.html"], "Acme", "$90,000"), ("2", "a.html", ["old.html"], "B", ""), ("3", "c.html", ["b.html"], "C", ""), ("4", "b.html", [], "D", ""), ("5", "", None, "E", "")],
        "id string, page_url string, redirect_paths array<string>, organization string, salary string",
    )
    pages = spark.createDataFrame([("a.html",), ("a.html",), ("b.html",), ("old.html",)], "path string")
    got = Counter((r.check, r.id) for r in validation.redirect_findings(jobs, "id", pages).unionByName(validation.broken_links(jobs, "id", pages)).unionByName(validation.repeated(jobs, "duplicate_page_url", F.col("page_url"))).collect())
    assert got == Counter([("redirect_loop", "1"), ("redirect_duplicate", "old.html"), ("redirect_chain", "old.html"), ("redirect_chain", "a.html"), ("broken_link", "3"), ("duplicate_page_url", "a.html")])
    none = jobs.limit(0)
    assert validation.redirect_findings(none, "id", pages).isEmpty() and validation.repeated(none, "x", F.col("id")).isEmpty()


def test_records_pending_and_edits(spark):
    jobs = spark.createDataFrame([("1", "Acme", "$90,000 / year", "analyst-acme.html"), ("2", "B", "", "x.html")], "id string, organization string, salary string, page_url string")
    kind = "id string, organization string, salary string, field_conflicts array<string>, status string, published boolean, public_visibility boolean, source_status string"
    records = spark.createDataFrame(
        [("1", "Other", "$50 / month", ["title", None], "published", True, True, "live"), ("2", "Z", "", None, "published", True, True, ""), ("3", "C", "", None, "Published", True, True, "sync_error"), ("4", "D", "", None, "published", True, None, None), (None, None, None, None, None, None, None, None)], kind
    )
    got = sorted((r.check, r.id) for r in validation.record_findings(jobs, records, "id").collect())
    assert got == [("disappeared", "3"), ("overwrite_conflict", "1"), ("overwrite_conflict", "1"), ("pay_downgrade", "1"), ("record_organization", "1"), ("removed_after_failed_fetch", "3")]
    pending = spark.createDataFrame([("1", "Backlog", 900), ("7", "backlog", 899), ("8", None, 999)], "id string, triage_bucket string, resurfacing_priority_score int")
    assert sorted((r.check, r.id) for r in validation.pending_findings(pending, jobs, "id").collect()) == [("pending_and_public", "1"), ("waiting_in_backlog", "1")]
    edits = spark.createDataFrame([("1", " ", "here", {"a": "was", "b": "was"}), ("2", None, None, {"a": " ", "c": "was"}), ("3", None, None, None)], "id string, a string, b string, last map<string,string>")
    assert [(r.id, r.detail) for r in validation.blanked_edits(edits, "id", "last", ["a", "b"]).collect()] == [("1", "a")]


def test_report_and_verdict(spark):
    found = spark.createDataFrame([("invalid_pay", str(i), "") for i in range(500)] + [("missed_video", "a", ""), ("missed_video", None, "")], "check string, id string, detail string")
    told = validation.report(spark, found, 1000)
    by = {r.check: r for r in told.collect()}
    assert len(by) == len(validation.RULES) and (by["invalid_pay"].n, by["invalid_pay"].share, len(by["invalid_pay"].examples)) == (500, 0.5, audit.EXAMPLES)
    assert set(by["invalid_pay"].examples) <= {str(i) for i in range(500)} and by["missed_video"].n == 2 and by["missed_video"].examples == ["a"] and by["broken_link"].n == 0
    state = lambda df: validation.verdict(df).first().state
    assert state(told) == "routed" and state(validation.report(spark, found.where("check = 'missed_video'"), 0)) == "passed"
    worse = found.unionByName(spark.createDataFrame([("broken_link", "9", "")], found.schema))
    assert state(validation.report(spark, worse, 10)) == "blocked"
    assert [(r.check, r.before, r.after) for r in validation.regressions(told, validation.report(spark, worse, 10)).collect()] == [("broken_link", 0, 1)]
    assert [(r.id, r.reason, r.checks) for r in validation.routed(worse.where("id in ('3', '9', 'a')")).orderBy("id").collect()] == [("3", "invalid_pay", 1), ("9", "invalid_pay", 1)]


@pytest.mark.parametrize("values, pattern, blanked", [
    (("x", "x", "y"), "AAC", False), (("x", "y", "x"), "ABA", False), (("x", "y", "z"), "ABC", False), (("x", None, ""), "ABC", True), (("x", "missing", "y"), "A-C", False), (("missing", "x", None), "-BC", True), (("x", "x", "x"), None, None), (("missing", "x", "missing"), None, None),
])
def test_compare_versions(spark, values, pattern, blanked):
    versions = {name: spark.createDataFrame([] if v == "missing" else [(1, v)], "k int, v string") for name, v in zip("abc", values, strict=True)}
    row = merge.compare_versions(versions, "k", ["v"]).first()
    assert row.present == [n for n, v in zip("abc", values, strict=True) if v != "missing"]
    assert [(d.field, d.pattern, d.blanked) for d in row.differences] == ([] if pattern is None else [("v", pattern, blanked)])


PAGE = """<html><body><nav><a href="/about">About us</a></nav>
<ul class=jobs><li><h3>Policy Analyst</h3> Location: Boston, MA<br>Team: Research<p>Salary range: $70,000 - $90,000 per year.</p><a href='/jobs/1'>Apply now</a>
<li><H3>Data Engineer</H3><A HREF=/jobs/2>Learn more</A> Remote <script>var x = "<a href='/jobs/9'>no</a>";</script></ul>
<div><a href="/jobs/1">Policy Analyst</a></div><a href="/careers/program-officer">Read more</a><a>none</a><a href="mailto:x@y.org">Mail</a></body>"""


def test_cards(spark):
    pages = spark.createDataFrame([(1, "https://x.org/careers", PAGE), (2, "https://x.org/", None), (3, "https://x.org/", ""), (4, "https://x.org/", "<<a <b <li><a href='/jobs/5'>Policy Director</a")], "page int, url string, html string")
    got = {(r.page, r.title): r for r in cards.postings(pages).collect()}
    assert set(got) == {(1, "Policy Analyst"), (1, "Data Engineer"), (1, "Program Officer"), (4, "Policy Director")}
    first = got[1, "Policy Analyst"]
    assert (first.apply_url, first.location, first.department, first.page_url) == ("https://x.org/jobs/1", "Boston, MA", "Research", "https://x.org/careers")
    assert "$70,000 - $90,000 per year" in first.pay and first.pay_source == "description_body"
    assert got[1, "Data Engineer"].location == "Remote" and got[1, "Data Engineer"].pay == ""


def test_a_card_with_its_pay(spark):
    html = "<html><body><article><h2>Lifecycle Marketing Manager</h2><p>We help.</p><p>Salary range: $70,000 - $90,000 per year.</p><a href='https://acme.applytojob.com/apply/vMAl/Lifecycle-Marketing-Manager'>Apply</a></article></body></html>"
    [row] = cards.postings(spark.createDataFrame([("https://acme.applytojob.com/apply", html)], "url string, html string")).collect()
    assert row.title == "Lifecycle Marketing Manager" and "70,000" in row.pay and "90,000" in row.pay


def test_deep_pages():
    deep = "<div>" * 20_000 + "<a href='/jobs/1'>Analyst</a> here"
    assert [(x[0], x[1]) for x in cards.links_of(deep)] == [("/jobs/1", "Analyst")]
