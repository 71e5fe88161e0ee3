"""Validation of a published board: checks as a table of rules, findings as rows, one aggregate for the report.

A finding is (check, id, detail). Checks of a single row all come out of one pass; checks between rows or tables are
equi-joins and counts that give findings of the same form. ``report`` aggregates whatever findings there are, with
counts, shares and a bounded number of examples, and never gathers the rows of a check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievery.functions import quality, text
from sievery.functions.fields import MONTHS, any_of
from sievery.functions.money import suspicious_downgrade
from sievery.functions.quality import Fields
from sievery.operators import audit

# What a field of a published posting may not hold.
WORKPLACES = ("Remote", "Hybrid", "On-site", "")
JOB_TYPES = ("Full-time", "Part-time", "Contract", "Temporary", "Internship", "Fellowship", "Paid Fellowship", "")
BAD_PAY = (
    r"(?i)^(?:-|—|–|\$-|\$0|0|n\/a|na|not listed|not disclosed|undisclosed)$",
    r"(?i)\$\s*,|\bpay range\s*\$[\s,.-]*\$\s*[,.-]*",
    r"(?i)\$\d{1,3},\s*\.\d{1,2}\s*(?:to|-|–|—)\s*\$\s*[,.\s\d]*",
    r"(?i)\bup to\s*\$[\s,.-]*$",
)
BAD_LOCATIONS = (
    r"(?i)\bTitle Business(?: Platform Location Date)?\b",
    r"(?i)\bPOINT\s*\(",
    r"(?i)\blocality\b",
    rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}},\s+\d{{4}}\b",
    r"(?i)\b\d+\s+hours?\)\s*(?:On-site|Remote|Hybrid)\b",
)
BAD_SNIPPETS = quality.JUNK[:10]
BAD_OPENINGS = (
    r"^\)\s*[A-Z]",
    r"(?i)^we strongly encourage candidates",
    r"(?i)^(?:apply now|back to jobs|see all openings|www\.)",
)
BAD_TEMPLATES = (
    r"(?i)\bThe\s+will\b",
    r"(?i)\bThe\s+is\b",
    r"(?i)\bThe\s+are\b",
    r"(?i)\bThe\s*,",
    r"(?i)\bThe\s*\.",
    r"(?i)\bThe&nbsp;will\b",
    r"(?i)\bThe\s*<\/",
)
BAD_TITLES = (
    r"\b(?:Remote|Hybrid|On-site|Onsite)\b$",
    r"[!?]|[A-Za-z]{3,}\.\s+[A-Z]|\.\.\.",
    r"(?i)\b(?:pivoting|click here|read my interview|linkedin|share their stories|want a .* career)\b",
    rf"(?i)\b(?:{MONTHS})\b",
    r"(?i)<div|href=|class=|aria-label=|https?:\/\/",
)
VIDEO = r"(?i)\b(?:video|videographer|video editor|video producer|multimedia producer|motion designer|motion graphics|youtube|documentary|short-form video|short form video|digital video|social video|film producer)\b"
GENERIC_SPECIALIZATIONS = ("strategy", "sales", "operations", "programs", "admin")
BACKLOG_PRIORITY = 900
LONGEST_TITLE = 12


@dataclass(frozen=True)
class Rule:
    """A check's name and what its findings mean: ``error`` blocks publication, ``warning`` and ``count`` are only told.

    A record with findings of a repairable check can be taken off the board instead of stopping the publication.
    """

    name: str
    level: str
    repairable: bool = False


RULES = (
    Rule("missing_page_url", "error", True),
    Rule("stale_page_url", "error", True),
    Rule("organization_page_url", "error", True),
    Rule("invalid_pay", "error", True),
    Rule("missing_currency_symbol", "error", True),
    Rule("tiny_monthly_pay", "error"),
    Rule("invalid_title", "error", True),
    Rule("invalid_workplace", "error", True),
    Rule("invalid_job_type", "error", True),
    Rule("invalid_location", "error", True),
    Rule("invalid_snippet", "error", True),
    Rule("malformed_opening", "error", True),
    Rule("malformed_template", "error", True),
    Rule("missing_description", "error", True),
    Rule("lowercase_description", "count"),
    Rule("unmapped_specialization", "count"),
    Rule("unsure_specialization", "count"),
    Rule("generic_specialization", "count"),
    Rule("missed_video", "count"),
    Rule("identity_conflict", "error"),
    Rule("duplicate_id", "error"),
    Rule("duplicate_page_url", "error"),
    Rule("broken_link", "error"),
    Rule("redirect_loop", "error"),
    Rule("redirect_orphan", "count"),
    Rule("redirect_duplicate", "count"),
    Rule("redirect_chain", "count"),
    Rule("record_organization", "error"),
    Rule("pay_downgrade", "error", True),
    Rule("overwrite_conflict", "count"),
    Rule("blanked_edit", "error"),
    Rule("disappeared", "error"),
    Rule("removed_after_failed_fetch", "error"),
    Rule("pending_and_public", "count"),
    Rule("waiting_in_backlog", "error"),
)


def symbol_missing(pay: Column) -> Column:
    """A range or a lone amount without any currency."""
    named = pay.rlike(r"(?i)[€$£]|\b(?:USD|CAD|EUR|GBP)\b")
    return ~named & (pay.rlike(r"(?i)\b\d[\d,]*(?:\.\d+)?\s*(?:-|–|—|to)\s*\d[\d,]*(?:\.\d+)?\b") | pay.rlike(r"(?i)^\d[\d,\s]+(?:\/\s*(?:hour|day|week|month|year))?$"))


def bad_title(x: Column) -> Column:
    return (x == "") | any_of(x, BAD_TITLES) | (F.size(F.split(x, r"\s+")) > LONGEST_TITLE) | (F.regexp_count(x, F.lit(r"\b(?:Remote|Hybrid|On-site|Onsite)\b")) > 1)


def page_slug(path: Column) -> Column:
    """The name of a page's file, without folder and ending."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.html)?$", 1)


def pay_numbers(pay: Column) -> Column:
    """A struct of ``low``, ``high`` and ``period`` of the positive amounts in a pay text; nulls where there is none."""
    amounts = F.filter(F.transform(F.regexp_extract_all(pay, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double")), lambda a: a > 0)
    period = F.lit("unknown")
    for name, pattern in (("day", r"(?i)\b(?:daily|day)\b"), ("hour", r"(?i)\bhour(?:ly)?\b|/\s*hr\b"), ("year", r"(?i)\b(?:annual|annually|year)\b|/\s*yr\b"), ("month", r"(?i)\bmonth(?:ly)?\b|/\s*mo\b")):
        period = F.when(pay.rlike(pattern), name).otherwise(period)
    return F.struct(F.array_min(amounts).alias("low"), F.array_max(amounts).alias("high"), period.alias("period"))


def row_findings(jobs: DataFrame, id_: str, specializations: tuple[str, ...], rivals: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Findings of all checks that look at one posting, in one pass; columns that the table lacks count as empty.

    ``specializations`` are the known ones. ``rivals`` are pairs of organisations that sources mix up, as (lower-case
    name, pattern of the other's name): a posting of the first whose texts name the second is an identity conflict.
    """
    names = ("page_url", "expected_page_url", "organization", "title", "title_confidence", "salary", "job_type", "workplace_type", "location", "description", "description_snippet", "summary", "specialization", "specialization_confidence", "function")
    given = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in jobs.columns else F.lit("") for c in names}
    # One projection makes every field once; the checks read columns.
    rows = jobs.select(F.col(id_).cast("string").alias("id"), *[c.alias(f"f_{n}") for n, c in given.items()])
    rows = rows.withColumns({"f_snippet": F.when(F.col("f_description_snippet") != "", F.col("f_description_snippet")).otherwise(F.col("f_summary")), "f_pay": pay_numbers(F.col("f_salary")), "f_slug": text.slugify(F.col("f_organization"))})
    job = Fields({n: F.col(f"f_{n}") for n in (*names, "snippet", "slug")})
    texts = [job["description"], job["snippet"], job["summary"]]
    rows = rows.withColumn("f_usable", quality.usable_description(job["description"], job["title"], F.lit("")))
    usable = F.col("f_usable")
    full_time = job["job_type"].rlike("(?i)full[-\\s]?time") & ~job["title"].rlike(r"(?i)\b(?:intern|internship|fellow|volunteer|part[-\s]?time|contractor|hourly)\b")
    either = lambda condition: condition(texts[0]) | condition(texts[1]) | condition(texts[2])
    fragment = lambda x: x.rlike(r"^[a-z][^!?]{12,}") & ~x.rlike(r"(?i)^(?:e\.g\.|i\.e\.)")
    mixed = F.lit(False)
    for name, other in rivals:
        mixed = mixed | ((F.lower(job["organization"]) == name) & (texts[0].rlike(other) | texts[1].rlike(other)))
    sure = F.lower(job["specialization_confidence"])
    cases = (
        ("missing_page_url", job["page_url"] == "", job["title"]),
        ("stale_page_url", (job["page_url"] != "") & (job["expected_page_url"] != "") & (job["page_url"] != job["expected_page_url"]), job["page_url"]),
        ("organization_page_url", (job["slug"] != "") & (page_slug(job["page_url"]) != "") & ~F.contains(page_slug(job["page_url"]), job["slug"]), job["page_url"]),
        ("invalid_pay", (job["salary"] != "") & (~job["salary"].rlike("[0-9]") | any_of(job["salary"], BAD_PAY)), job["salary"]),
        ("missing_currency_symbol", symbol_missing(job["salary"]), job["salary"]),
        ("tiny_monthly_pay", full_time & (F.col("f_pay.period") == "month") & (F.col("f_pay.high") < 1000), job["salary"]),
        ("invalid_title", bad_title(job["title"]) | (F.lower(job["title_confidence"]) == "low"), job["title"]),
        ("invalid_workplace", ~job["workplace_type"].isin(*WORKPLACES), job["workplace_type"]),
        ("invalid_job_type", ~job["job_type"].isin(*JOB_TYPES), job["job_type"]),
        ("invalid_location", any_of(job["location"], BAD_LOCATIONS), job["location"]),
        ("invalid_snippet", ((job["snippet"] == "") & usable) | any_of(job["snippet"], BAD_SNIPPETS), job["snippet"]),
        ("malformed_opening", either(lambda x: any_of(x, BAD_OPENINGS)), job["snippet"]),
        ("malformed_template", either(lambda x: any_of(x, BAD_TEMPLATES)), job["snippet"]),
        ("missing_description", ~usable, job["title"]),
        ("lowercase_description", either(fragment), job["snippet"]),
        ("unmapped_specialization", ~job["specialization"].isin(*specializations) | (job["specialization"] == ""), job["specialization"]),
        ("unsure_specialization", (job["specialization"] != "") & sure.isin("low", ""), job["specialization"]),
        ("generic_specialization", F.lower(job["specialization"]).isin(*GENERIC_SPECIALIZATIONS) & (sure != "high"), job["specialization"]),
        ("missed_video", F.concat_ws(" ", job["title"], job["description"], job["snippet"], job["function"]).rlike(VIDEO) & (job["specialization"] != "Video"), job["specialization"]),
        ("identity_conflict", mixed, job["organization"]),
    )
    told = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(name).alias("check"), F.substring(detail, 1, 180).alias("detail"))) for name, c, detail in cases]))
    return rows.select("id", F.explode(told).alias("f")).select("f.check", "id", "f.detail")


def _finding(df: DataFrame, check: str, id_: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), id_.cast("string").alias("id"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))


def repeated(df: DataFrame, check: str, value: Column) -> DataFrame:
    """A finding for each value that several rows have; nulls and blanks are none."""
    counts = df.select(F.trim(value.cast("string")).alias("v")).where("v <> ''").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return _finding(counts.where("n > 1"), check, F.col("v"), F.col("n"))


def broken_links(jobs: DataFrame, id_: str, pages: DataFrame) -> DataFrame:
    """Postings whose page is not among the files (``path``)."""
    named = jobs.select(F.col(id_).alias("id"), F.trim("page_url").alias("path")).where("path <> ''")
    return _finding(named.join(pages.select("path").distinct(), "path", "left_anti"), "broken_link", F.col("id"), F.col("path"))


def redirect_findings(jobs: DataFrame, id_: str, pages: DataFrame) -> DataFrame:
    """Loops, orphans, duplicates and chains of redirects (arrays ``redirect_paths`` to ``page_url``)."""
    hops = jobs.select(F.col(id_).alias("id"), F.trim("page_url").alias("target"), F.explode(F.transform("redirect_paths", lambda p: F.trim(p))).alias("path")).where("path <> ''")
    edges = hops.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))
    found = _finding(hops.where("path = target"), "redirect_loop", F.col("id"), F.col("path"))
    found = found.unionByName(_finding(hops.join(pages.select("path").distinct(), "path", "left_anti"), "redirect_orphan", F.col("id"), F.col("path")))
    found = found.unionByName(_finding(edges.where("n > 1"), "redirect_duplicate", F.col("path"), F.col("n")))
    onward = edges.select(F.col("path").alias("target"))
    return found.unionByName(_finding(edges.join(onward, "target", "left_semi"), "redirect_chain", F.col("path"), F.col("target")))


def record_findings(jobs: DataFrame, records: DataFrame, id_: str) -> DataFrame:
    """What the stored records say of the board, in one outer join by id.

    ``records`` has organization, salary, field_conflicts (array of field names), status, published,
    public_visibility and source_status. A record's organization is in conflict where the public one is that of the
    posting's own page.
    """
    a = jobs.select(F.col(id_).alias("id"), F.col("organization").alias("organization"), F.col("salary").alias("salary"), F.col("page_url").alias("page_url"), F.lit(True).alias("public"))
    b = records.select(F.col(id_).alias("id"), F.trim("organization").alias("kept_organization"), F.col("salary").alias("kept_salary"), "field_conflicts", "status", "published", "public_visibility", "source_status", F.lit(True).alias("kept"))
    met = b.join(a, "id", "left").withColumns({"now": pay_numbers(F.coalesce("salary", F.lit(""))), "then": pay_numbers(F.coalesce("kept_salary", F.lit("")))})
    slug = text.slugify(F.trim("organization"))
    shown = F.coalesce(F.col("published"), F.lit(False)) & F.coalesce(F.col("public_visibility"), F.lit(False)) & (F.lower("status") == "published")
    gone = shown & F.col("public").isNull()
    cases = (
        ("record_organization", (F.col("kept_organization") != "") & (slug != "") & (F.trim("organization") != F.col("kept_organization")) & F.contains(page_slug(F.col("page_url")), slug), F.col("kept_organization")),
        ("pay_downgrade", suspicious_downgrade(F.col("now.low"), F.col("now.high"), F.col("then.high"), F.col("then.period")), F.col("kept_salary")),
        ("disappeared", gone, F.col("kept_organization")),
        ("removed_after_failed_fetch", gone & (F.lower("source_status") == "sync_error"), F.col("source_status")),
    )
    told = [F.when(c, F.struct(F.lit(name).alias("check"), F.coalesce(detail, F.lit("")).alias("detail"))) for name, c, detail in cases]
    conflicts = F.transform(F.coalesce("field_conflicts", F.array().cast("array<string>")), lambda f: F.struct(F.lit("overwrite_conflict").alias("check"), F.coalesce(f, F.lit("")).alias("detail")))
    return met.select("id", F.explode(F.concat(F.array_compact(F.array(*told)), conflicts)).alias("f")).select("f.check", F.col("id").cast("string").alias("id"), "f.detail")


def blanked_edits(df: DataFrame, id_: str, last: str, fields: list[str]) -> DataFrame:
    """Fields that a person once filled (map ``last``: field to value) and that are blank now."""
    blank = lambda f: F.coalesce(F.trim(F.col(f).cast("string")) == "", F.lit(True))
    once = lambda f: F.coalesce(F.trim(F.try_element_at(last, F.lit(f))) != "", F.lit(False))
    told = F.array_compact(F.array(*[F.when(once(f) & blank(f), F.lit(f)) for f in fields]))
    return _finding(df.select(F.col(id_).alias("id"), F.explode(told).alias("field")), "blanked_edit", F.col("id"), F.col("field"))


def pending_findings(pending: DataFrame, jobs: DataFrame, id_: str) -> DataFrame:
    """Pending records that are public as well, and those of high priority that wait in the backlog."""
    overlap = pending.select(id_).join(jobs.select(id_), id_, "left_semi")
    waiting = pending.where((F.lower("triage_bucket") == "backlog") & (F.col("resurfacing_priority_score") >= BACKLOG_PRIORITY))
    return _finding(overlap, "pending_and_public", F.col(id_), F.lit("")).unionByName(_finding(waiting, "waiting_in_backlog", F.col(id_), F.col("resurfacing_priority_score")))


def report(spark: SparkSession, found: DataFrame, total: int | Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """check, level, n, share of ``total`` and up to ten example ids of every rule, also of those without findings."""
    told = audit.counted(found, ["check"], "id")
    listed = spark.createDataFrame([(r.name, r.level, r.repairable) for r in rules], "check string, level string, repairable boolean")
    whole = total if isinstance(total, Column) else F.lit(total)
    n = F.coalesce("n", F.lit(0)).cast("long")
    share = F.when(whole > 0, F.round(n / whole, 4)).otherwise(0.0)
    return F.broadcast(listed).join(told, "check", "left").select("check", "level", "repairable", n.alias("n"), share.alias("share"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def regressions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Checks of two reports whose count rose, with both counts; a check that the earlier one lacks had none."""
    before = previous.select("check", F.col("n").alias("before"))
    met = current.select("check", "level", F.col("n").alias("after")).join(before, "check", "left").withColumn("before", F.coalesce("before", F.lit(0)).cast("long"))
    return met.where(F.col("after") > F.col("before")).select("check", "level", "before", "after")


def verdict(told: DataFrame) -> DataFrame:
    """One row of a report: how many checks fail as errors and warnings, how many of the errors no repair can mend, and the state.

    ``passed`` without errors, ``routed`` where records taken off the board mend all of them, else ``blocked``.
    """
    hit = lambda c: F.count_if((F.col("n") > 0) & c)
    error = F.col("level") == "error"
    row = told.agg(hit(error).alias("errors"), hit(F.col("level") == "warning").alias("warnings"), hit(error & ~F.col("repairable")).alias("blocking"))
    return row.withColumn("state", F.when(F.col("blocking") > 0, "blocked").when(F.col("errors") > 0, "routed").otherwise("passed"))


def routed(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Records to be taken off the board: id, the first of its repairable checks in the order of the rules, and how many it has."""
    order = {r.name: i for i, r in enumerate(rules) if r.repairable}
    place = F.create_map(*[F.lit(v) for pair in order.items() for v in pair])
    mendable = found.where(F.col("check").isin(*order)).select("id", F.struct(place[F.col("check")].alias("place"), "check").alias("c"))
    return mendable.groupBy("id").agg(F.min("c")["check"].alias("reason"), F.countDistinct("c.check").alias("checks"))
