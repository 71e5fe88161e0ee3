"""Descriptions of postings."""

import pytest

from sievery.functions import description


def normalized(spark, *rows):
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "id int, said string, title string")
    return [r.normalized for r in description.normalized(df, "said", "title").orderBy("id").collect()]


def test_the_section_about_the_role_stays(spark):
    page = "<p>About us</p><p>We are a group of people with many offices in the world.</p><h2>Responsibilities</h2><p>The analyst will lead research on grids and manage two budgets.</p><p>You will coordinate partners across the region every week.</p><h2>Benefits</h2><p>Our benefits are good and the office has dogs and snacks.</p>"
    plain = "About us. We are a group of people with many offices in the world. Responsibilities. The analyst will lead research on grids and manage two budgets. You will coordinate partners across the region every week. Benefits. Our benefits are good and the office has dogs and snacks."
    for got in normalized(spark, (page, "Policy Analyst"), (plain, "Policy Analyst")):
        assert got.description.startswith("The analyst will lead research on grids and manage two budgets.")
        assert "coordinate partners" in got.description and "benefits" not in got.description and "About us" not in got.description
        assert got.diagnostics.heading_used == "Responsibilities." and got.diagnostics.section_used


def test_dirty_input_of_a_careers_page(spark):
    dirty = "Previous post navigation. Share to twitter. The manager will develop communications plans for climate campaigns. Apply now"
    told, twice, template, empty, none = normalized(
        spark,
        (dirty, "Communications Manager"),
        ("You will build the data team and its tools. You will build the data team and its tools. We are an equal opportunity employer and will hire people.", "Data Lead"),
        ("The will manage a team of five across two of our offices. remote", "Press $1 Officer"),
        ("", "x"), (None, None),
    )
    assert told.description == "The manager will develop communications plans for climate campaigns."
    assert twice.description == "You will build the data team and its tools." and twice.diagnostics.sentences == 1
    assert template.description.startswith("The Press $1 Officer will manage a team of five")
    assert empty.description == none.description == "" and none.diagnostics.sentences == 0


def test_sections_of_a_careers_page_go(spark):
    said = "We hire people who care.\n\nLife at Acme\n\nDogs and snacks all day.\n\nKey responsibilities\n\nThe lead will run campaigns in six countries for us.\n\nJoin our team\n\nMore dogs."
    df = spark.createDataFrame([(said,)], "said string")
    kept = df.select(description.without_careers_pages(df.said)).first()[0]
    assert kept == "We hire people who care.\n\nKey responsibilities\n\nThe lead will run campaigns in six countries for us."


@pytest.mark.parametrize("start,expected", [("will lead the whole team of analysts in our office", "The Director will lead the whole team of analysts in our office"), ("- builds tools that the whole region works with daily", "Builds tools that the whole region works with daily")])
def test_openings(spark, start, expected):
    assert normalized(spark, (start, "Director"))[0].description == expected


def test_a_table_is_not_lost_when_a_rename_fails(spark, tmp_path, monkeypatch):
    from sievery.sources import files

    path, renamed = str(tmp_path / "table"), files._renamed
    spark.range(3).write.parquet(path)
    for fails in (0, 1):
        calls = iter([k != fails for k in range(2)] + [True])
        monkeypatch.setattr(files, "_renamed", lambda fs, a, b: next(calls) and renamed(fs, a, b))
        with pytest.raises(OSError):
            files.replace_table(spark.range(5), path, "parquet")
        assert spark.read.parquet(path).count() == 3
    monkeypatch.setattr(files, "_renamed", renamed)
    files.replace_table(spark.read.parquet(path).union(spark.range(4)), path, "parquet")
    assert spark.read.parquet(path).count() == 7 and [p.name for p in tmp_path.iterdir()] == ["table"]


SITE_TITLES = (r"(?i)^join\s+#?teamacme\b",)
SITE_PAGES = (r"info[.]jazz[.]example/", r"study[.]example/(?:article|report)/", r"/(?:teamacme)/", r"/job-offers/?[?](?:.*[?&])?(?:ci|cn)=", r"power[.]example/careers/(?:join-our-team/|life-at-|ca-|equal-)", r"acme[.]example/en/press/", r"acme[.]example/en/portal/why-work-here/")
CANDIDATES = [
    ("", "https://jobs.uni.example/postings/9798", "Partners of the Center Maintain current knowledge of enterprise GIS technologies, literature review and attendance at conferences and symposia. GIS Manager Perform other job-related duties as assigned.", True, "GIS Manager"),
    ("Report: Proven State and Local Strategies To Create Good Jobs", "https://www.study.example/article/proven-state-and-local-strategies/", "", False, None),
    ("Interagency Working Group on Coal & Power Plant Communities", "https://communities.example/funding-opportunities/", "", False, None),
    ("Find jobs in Copenhagen", "https://www.acme.example/en/portal/job-offers/?ci=Copenhagen", "", False, None),
    ("Discover job opportunities in India", "https://www.acme.example/en/portal/job-offers/?cn=IN", "", False, None),
    ("Explore jobs opportunities in Tokyo", "https://www.acme.example/en/portal/job-offers/?ci=Tokyo", "", False, None),
    ("Join #TeamAcme in Singapore", "https://www.acme.example/en/portal/job-offers/?cn=SG", "", False, None),
    ("Senior Policy Advisor", "https://www.acme.example/en/portal/job-offers/senior-policy-advisor-123456/", "", True, "Senior Policy Advisor"),
    ("CA Privacy", "https://www.power.example/careers/ca-ccpa-notice.html", "", False, None),
    ("English (Canada)", "https://jobs.power.example/?locale=en_CA", "", False, None),
    ("Sr Product Manager I - NEA", "https://jobs.power.example/job/Juno-Beach-Sr-Product-Manager-I-NEA-FL-33408/1384482400/", "", True, "Sr Product Manager I - NEA"),
    ("View Jobs", "https://www.power.example/careers/join-our-team/corporate-jobs/information-technology-jobs.html", "", False, None),
    ("Join Our Team", "https://www.power.example/careers/join-our-team.html", "", False, None),
    ("Equal Opportunity Employer", "https://www.power.example/careers/equal-opportunity-employer.html", "", False, None),
    ("View All Jobs", "http://alliance.applytojob.com/apply/", "", False, None),
    ("Powered by", "https://info.jazz.example/job-seekers.html", "", False, None),
    ("Donor Engagement Manager", "https://brigade.applytojob.com/apply/Rq9AD0rnpz/Donor-Engagement-Manager", "", True, "Donor Engagement Manager"),
    ("Volunteer Coordinator", "https://brigade.applytojob.com/apply/dAp7L2PwiF/Volunteer-Coordinator", "", True, "Volunteer Coordinator"),
    ("What counts are the people at Acme", "https://www.acme.example/en/portal/teamacme/it-was-great-to-develop-my-coding-skills/", "", False, None),
    ("Floating Wind Opportunities (acme.example)", "https://www.acme.example/en/press/renewables/2021-12-07-study", "", False, None),
]


def test_candidates_from_sources_that_are_read_by_hand(spark):
    from sievery.operators import triage

    rows = [(i, t, "Org", u, d) for i, (t, u, d, *_) in enumerate(CANDIDATES)]
    df = spark.createDataFrame(rows, "i int, title string, organization string, original_url string, raw_description string")
    got = triage.manual_candidates(df, SITE_TITLES, SITE_PAGES).orderBy("i").collect()
    for r, (title, *_, valid, shown) in zip(got, CANDIDATES, strict=True):
        assert r.manual.valid == valid and (r.manual.title == shown or not valid), title
    # The general rules alone know most of them.
    alone = triage.manual_candidates(df).orderBy("i").collect()
    assert sum(r.manual.valid == c[3] for r, c in zip(alone, CANDIDATES, strict=True)) >= 17


def test_every_alternative_of_a_field_of_work_has_its_label(spark):
    from sievery.functions.taxonomy import first_match
    from sievery.operators.canonical import SPECIALIZATIONS

    said = [(term, label) for label, pattern in SPECIALIZATIONS for term in pattern[5:-3].split("|")]
    df = spark.createDataFrame(said, "term string, label string")
    # An earlier rule may know a word of the term.
    order = [label for label, _ in SPECIALIZATIONS]
    for term, label, found in df.select("term", "label", first_match(df.term, SPECIALIZATIONS).alias("found")).collect():
        assert found is not None and order.index(found) <= order.index(label), term
    own = {"creator lead": "Video", "creator network": "Video", "bluesky": "Social Media", "rapid response clips": "Social Media", "linkedin content": "Social Media"}
    assert {t: f for t, f in df.select("term", first_match(df.term, SPECIALIZATIONS)).collect() if t in own} == own
