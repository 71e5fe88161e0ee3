"""Triage of pending records: relevance by terms, checks of candidates from sources that are read by hand, and the first rule that decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.functions import fields, quality, text, url
from sievery.functions.values import reasons

# What is no posting by its address or title.
NO_ROLE_PAGES = (
    r"/(?:funding-opportunities|funding|grants|policy|resources|press|press-release|news|blog|faq|privacy|privacy-policy|cookie|legal|accessibility|equal-opportunity|ca-ccpa-notice)\b",
    r"/(?:reports?|articles?|people|profile|team|employee|story|stories|meet-our|career-stories?|global-presence)/",
    r"/terms-of-|[?]locale=|[?]searchby=|/search[?]|/[?]q=",
    r"[.]applytojob[.]com/apply/?(?:[?]|$)",
)
LISTINGS = r"(?i)^https?://[^/?#]+(?:/(?:careers|jobs))?/?$|^https?://[^/?#]+/[^?#]*(?:/careers|/jobs)/?$|/go/|/content/"
POSTINGS = r"(?i)/postings/|/job/|/jobs/.*/[0-9]{6,}/|-[a-z]{2}-[0-9]{5,}/|^https?://[^/]+/(?:[^/]+/)*apply/[^/]+/[^/]"
NO_ROLE_TITLES = r"(?i)^(?:home|about(?: us)?|contact(?: us)?|careers?|jobs?|news|press|blog|faq|privacy(?: policy)?|cookies?|search|previous|next|apply(?: now)?|learn more|read more|benefits|our (?:team|people|story|impact))$"
# Titles of pages of sources that are read by hand.
PAGE_TITLES = (
    r"(?i)^view all jobs?\s*(?:\([^)]*\))?$",
    r"(?i)^powered by",
    r"(?i)^apply now?\s*$",
    r"(?i)^apply\s*$",
    r"(?i)^find jobs?\s+in\b",
    r"(?i)^jobs?\s+in\b",
    r"(?i)^discover job opportunities?\s+in\b",
    r"(?i)^explore jobs?\s+opportunities?\s+in\b",
    r"(?i)^explore career options?\s+in\b",
    r"(?i)^explore programmes?\s*$",
    r"(?i)^find out more about\b",
    r"(?i)^join our vibrant\b",
    r"(?i)^join our team",
    r"(?i)^check out our\b",
    r"(?i)^further insights on\b",
    r"(?i)^untitled\s*$",
    r"(?i)^welcome\s*$",
    r"(?i)^learn more\s*$",
    r"(?i)^funding opportunities?\s*$",
    r"(?i)^reports?\s*$",
    r"(?i)^articles?\s*$",
    r"(?i)^resources\s*$",
    r"(?i)^search jobs?\s*$",
    r"(?i)^why work here",
    r"(?i)^onboarding\b",
    r"(?i)^learning & development\b",
    r"(?i)^equal opportunity employer\b",
    r"(?i)^statements?\s*&?\s*positions?\s*$",
    r"(?i)^see\s+(?:nuclear|power)\s+",
    r"(?i)^view jobs?\s*$",
    r"(?i)^find open positions?\s*$",
    r"(?i)^emerging leaders\b",
    r"(?i)\b\.html\s*$",
)
SENIOR = "manager|director|analyst|specialist|lead|coordinator|associate|officer|engineer|consultant|representative|advisor|supervisor|technician|assistant|head|vp|chief|president|attorney|counsel|developer|architect|scientist|planner|writer|editor|producer|strategist"
NAMED_ROLE = rf"\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){{0,4}}\s+(?i:{SENIOR}))\b"
UNRELATED = r"medical|beauty|retail|cosmetic|insurance|hospital|pharma"


@dataclass(frozen=True)
class Terms:
    """What a board looks for, as lower-case substrings, and patterns of sources that it trusts or that bring much of no use."""

    context: tuple[str, ...]
    functions: tuple[str, ...]
    boost: tuple[str, ...] = ()
    engineering: tuple[str, ...] = ()
    sales: tuple[str, ...] = ()
    trusted: str = "(?!)"
    broad: str = "(?!)"
    least: int = 7
    ready: int = 8


def page_title(title: Column, more: tuple[str, ...] = ()) -> Column:
    return title.rlike(NO_ROLE_TITLES) | fields.any_of(title, (*PAGE_TITLES, *more))


def no_role_title(title: Column, more: tuple[str, ...] = ()) -> Column:
    """Why a title names no posting: empty_title, generic_non_job_title, generic_non_specific_title, or the empty text."""
    short = title.rlike("^[a-z ]+$") & (fields.word_number(title) <= 2) & ~F.lower(title).rlike(rf"\b(?:{SENIOR})\b")
    return F.when(title == "", "empty_title").when(page_title(title, more), "generic_non_job_title").when(short, "generic_non_specific_title").otherwise("")


def no_role_url(address: Column, more: tuple[str, ...] = ()) -> Column:
    return fields.any_of(F.lower(address), (*NO_ROLE_PAGES, *more))


def recovered_title(title: Column, description: Column, more: tuple[str, ...] = ()) -> Column:
    """The title, or where it names no posting, the first phrase of the description that names a role."""
    named = F.regexp_extract(description, NAMED_ROLE, 1)
    bad = (title == "") | page_title(title, more)
    return F.when(bad & F.length(named).between(6, 150), named).otherwise(title)


def manual_candidates(df: DataFrame, titles: tuple[str, ...] = (), pages: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``manual``, a struct of ``valid``, ``bucket``, ``reason`` and ``title``, for candidates from sources that are read by hand.

    ``titles`` and ``pages`` are patterns of single sites' own titles and lower-case addresses that are no postings, besides the general ones.
    """
    job = quality.of(df)
    title = recovered_title(job["title"], F.coalesce(F.nullif(job["raw_description"], F.lit("")), job["description"]), titles)
    address = url.normalize_url(F.coalesce(*[F.nullif(job[x], F.lit("")) for x in ("original_url", "apply_url", "source_url")], F.lit("")))
    step = df.withColumns({"_title": title, "_address": address})
    step = step.withColumns({"_wrong": no_role_title(F.col("_title"), titles), "_no_role": no_role_url(F.col("_address"), pages)})
    posting = (F.col("_address") != "") & ~F.col("_no_role") & F.concat("_address", F.lit("/")).rlike(POSTINGS)
    reason = (
        F.when((F.col("_wrong") == "empty_title") & posting, "manual_source_empty_title_recoverable_job_url")
        .when(F.col("_wrong") != "", F.concat(F.lit("manual_source_"), "_wrong"))
        .when(F.col("_address") == "", "manual_source_missing_url")
        .when(F.col("_no_role"), "manual_source_non_job_url")
        .when(job["organization"] == "", "manual_source_missing_organization")
    )
    step = step.withColumn("_reason", reason)
    bucket = F.when(F.col("_reason").isNull(), "review_ready").when(F.col("_reason") == "manual_source_empty_title_recoverable_job_url", "needs_cleanup").otherwise("rejected_noise")
    return step.select(*df.columns, F.struct(F.col("_reason").isNull().alias("valid"), bucket.alias("bucket"), F.col("_reason").alias("reason"), F.col("_title").alias("title")).alias("manual"))


def relevance(df: DataFrame, terms: Terms) -> DataFrame:
    """``df`` with ``relevance``, a struct of ``score``, ``reasons``, ``context``, ``match``, ``paid``, ``broad`` and ``unrelated``: what speaks for a record and against it."""
    job = quality.of(df)
    said = F.lower(F.concat_ws(" ", *[job[x] for x in ("title", "organization", "sector", "function", "location", "workplace_type", "description", "raw_description", "tags", "notes")]))
    step = df.withColumns({"_said": said, "_origin": F.concat_ws(" ", job["organization"], job["source"], job["source_url"]), "_role": F.lower(F.concat_ws(" ", job["title"], job["function"], job["specialization"]))})
    step = step.withColumns({f"_n_{name}": text.hits(F.col("_said"), t) for name, t in (("context", terms.context), ("function", terms.functions), ("boost", terms.boost), ("engineering", terms.engineering), ("sales", terms.sales))})
    step = step.withColumns({"_trusted": F.col("_origin").rlike(terms.trusted), "_broad": F.col("_origin").rlike(terms.broad), "_match": text.hits(F.col("_role"), terms.functions) > 0, "_paid": (job["salary"] != "") | (job["raw_salary"] != "")})
    step = step.withColumn("_context", (F.col("_n_context") > 0) | F.col("_trusted"))
    context, match, broad, engineering, sales = F.col("_context"), F.col("_match"), F.col("_broad"), F.col("_n_engineering") > 0, F.col("_n_sales") > 0
    unclear = (job["organization"] == "") | job["organization"].rlike("(?i)unknown|multiple employers|various")
    direct = (url.host(job["apply_url"]) != "") & (url.host(job["apply_url"]) == url.host(job["source_url"]))
    cases = [
        ("climate_context", 4, F.col("_n_context") > 0),
        ("functional_relevance", 3, F.col("_n_function") > 0),
        ("priority_specialization_match", 4, match),
        ("priority_function_terms", F.least("_n_boost", F.lit(4)), F.col("_n_boost") > 0),
        ("trusted_sustainability_source", 2, F.col("_trusted")),
        ("pay_captured", 1, F.col("_paid")),
        ("location_captured", 1, (job["location"] != "") | (job["workplace_type"] != "")),
        ("direct_employer_apply_url", 2, direct),
        ("unrelated_engineering", -5, engineering & ~context),
        ("unrelated_sales", -5, sales & ~engineering & ~context),
        ("generic_sales_role", -4, sales & (~context | (F.col("_n_function") == 0))),
        ("pure_engineering_without_sustainability", -4, engineering & ~context),
        ("high_volume_weak_match", -6, broad & ~(context & match)),
        ("broad_board_unclear_employer", -3, broad & unclear),
        ("unrelated_industry", -6, F.col("_said").rlike(UNRELATED) & ~context),
    ]
    held = step.withColumns({f"_case{i}": c for i, (_, _, c) in enumerate(cases)})
    score = sum((F.when(F.col(f"_case{i}"), n).otherwise(0) for i, (_, n, _) in enumerate(cases)), F.lit(0)).cast("long")
    why = reasons(*[(name, F.col(f"_case{i}")) for i, (name, _, _) in enumerate(cases)])
    found = F.struct(score.alias("score"), why.alias("reasons"), context.alias("context"), match.alias("match"), F.col("_paid").alias("paid"), broad.alias("broad"), (engineering | sales).alias("unrelated"))
    return held.select(*df.columns, found.alias("relevance"))


def triaged(df: DataFrame, terms: Terms, excluded: Column, seen: Column | None = None) -> DataFrame:
    """``df`` with ``triage``, a struct of ``bucket``, ``reason`` and ``score``: the first rule that holds decides.

    ``excluded`` is a reason for exclusion or empty; ``seen`` is true where the address was kept before.
    """
    job = quality.of(df)
    address = url.normalize_url(F.coalesce(F.nullif(job["original_url"], F.lit("")), F.nullif(job["apply_url"], F.lit("")), job["source_url"]))
    step = relevance(manual_candidates(df), terms).withColumns({"_excluded": excluded, "_seen": F.coalesce(seen, F.lit(False)) if seen is not None else F.lit(False), "_address": address, "_title": job["title"]})
    title, address, score = F.col("_title"), F.col("_address"), F.col("relevance.score")
    bad = fields.any_of(title, fields.BAD_TITLES) | fields.only_first_name(title) | fields.only_organization(title, job["organization"]) | fields.only_location(title, job["location"]) | ~F.length(title).between(4, 160)
    intern = F.concat_ws(" ", title, job["description"], job["raw_description"]).rlike(r"(?i)\b(?:intern|internship|fellowship)\b")
    by_hand = (F.lower(job["manual_review_required"]) == "true") | job["source_classification"].isin("tracked_manual_org", "manual_review_community", "community_submission_source")
    suits = F.col("relevance.context") & F.col("relevance.match")
    step = step.withColumns({
        "_bad": bad, "_intern": intern, "_by_hand": by_hand, "_suits": suits, "_suspicious": fields.any_of(title, fields.HEADLINES) | (fields.word_number(title) > 12),
        "_listing": address.rlike(LISTINGS) | no_role_url(address), "_nameless": (title == "") | (job["organization"] == ""), "_low": job["title_confidence"] == "low", "_unsure": F.lower(job["parse_warning"]).contains("organization uncertain"),
    })
    rules = [
        (F.col("_excluded") != "", "rejected_noise", F.col("_excluded")),
        (F.col("_by_hand"), F.col("manual.bucket"), F.coalesce("manual.reason", F.lit("manual review source"))),
        (F.col("_nameless"), "rejected_noise", "missing title or organization"),
        (address == "", "rejected_noise", "missing or broken original_url"),
        (F.col("_seen"), "rejected_noise", "duplicate role url"),
        (F.col("_listing"), "rejected_noise", "non-role listing or policy url"),
        (F.col("_bad"), "rejected_noise", "non-role title"),
        (F.col("_low"), "needs_cleanup", "low-confidence title parse"),
        (F.col("_intern") & ~F.col("relevance.paid"), "rejected_noise", "internship pay missing or unclear"),
        (F.col("relevance.unrelated") & ~F.col("relevance.context"), "rejected_noise", "unrelated engineering or sales role without sustainability context"),
        (F.col("relevance.broad") & ~F.col("_suits"), "rejected_noise", "high-volume source missing climate context or priority specialization"),
        (~(F.col("_suits") & (score >= terms.least)), "rejected_noise", "low sustainability or priority specialization relevance"),
        (F.col("_unsure"), "needs_cleanup", "source board organization uncertain"),
        (~F.col("_suspicious") & (score >= terms.ready), "review_ready", "meets review-ready threshold"),
        (F.col("_suspicious"), "needs_cleanup", "relevant role but scraped title needs cleanup"),
        (F.lit(True), "needs_cleanup", "relevant but needs cleanup before review"),
    ]
    plain = lambda x: x if isinstance(x, Column) else F.lit(x)
    decided = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.struct(plain(bucket).alias("bucket"), plain(why).alias("reason"))) for c, bucket, why in rules])
    step = step.withColumn("_decided", decided)
    return step.select(*df.columns, F.struct("_decided.bucket", "_decided.reason", score.alias("score")).alias("triage"))
