"""Whether a pending record may be published without a person: seven factors of 0 to 100, their weighted sum, and gates.

A factor is a base and a list of points, each with its condition. Keys by which records are the same as others are
looked up in an index that has the smallest and the largest id of each key, which is enough to know of another record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.functions import fields, pay, quality
from sievery.functions.quality import Fields
from sievery.functions.values import clamp, has_value
from sievery.operators.windows import keep_first

# Weights in hundredths, thresholds, and patterns that a factor looks for.
WEIGHTS = {"description_quality": 25, "url_quality": 15, "pay_confidence": 20, "freshness": 10, "location": 10, "duplicate": 10, "source_trust": 10}
LEAST_SCORE = 85
LEAST_FRESHNESS = 30
BOILERPLATE = (
    r"(?i)apply\s*(now|today|here)",
    r"(?i)equal opportunity",
    r"(?i)we are an",
    r"(?i)qualified[-\s]?applicants",
    r"(?i)e[- ]?verify",
    r"(?i)drug[- ]?free",
)
USEFUL = r"(?i)responsibilities|qualifications|requirements|about\s+(the\s+)?(role|position)|what\s+you('ll| will)"
GENERIC_BOARDS = (
    r"(?i)linkedin\.com\/jobs",
    r"(?i)indeed\.com",
    r"(?i)glassdoor\.com",
    r"(?i)monster\.com",
    r"(?i)simplyhired",
    r"(?i)ziprecruiter",
    r"(?i)google\.com\/search",
)
LOGINS = (
    r"(?i)login",
    r"(?i)sign[-\s]?in",
    r"(?i)auth",
    r"(?i)search",
    r"(?i)apply\s*$",
)
POSTING_PATHS = r"(?i)\/jobs\/|\/careers\/|\/job\/|\/position|\/opportunity|\/posting|\?gh_jid=|\/apply\/"
CLOSURES = (
    r"(?i)position\s+(filled|closed)",
    r"(?i)role\s+(filled|closed)",
    r"(?i)this\s+(position|role)\s+(has been|is)\s+(filled|closed)",
    r"(?i)no\s+(longer|more)\s+(accepting|available)",
    r"(?i)application\s+(deadline|period)\s+(has|ended|passed)",
    r"(?i)we\s+are\s+no\s+longer",
    r"(?i)page\s+not\s+found",
)
STRUCTURED_PROVIDERS = ("greenhouse", "lever", "ashby", "bamboohr", "workable")
RISKY_PROVIDERS = ("taleo",)


def points(base: int, *cases: tuple[int, Column]) -> Column:
    """``base`` and the points of the conditions that hold, within 0 and 100; a condition that is null does not hold."""
    return clamp(sum((F.when(c, n).otherwise(0) for n, c in cases), F.lit(base)))


def description_quality(job: Fields) -> Column:
    said, snippet = job["description"], job["description_snippet"]
    said = F.when(said != "", said).otherwise(job["raw_description"])
    return points(
        0,
        (30, F.length(said) > 100),
        (15, F.length(said).between(31, 100)),
        (20, ~quality.junk(said) & ~quality.junk(job["raw_description"])),
        (15, ~fields.any_of(said, BOILERPLATE)),
        (15, job["description_heading_used"] != ""),
        (10, (F.length(snippet) > 50) & ~fields.any_of(snippet, BOILERPLATE)),
        (10, said.rlike(USEFUL)),
    )


def _addresses(job: Fields) -> tuple[Column, Column]:
    return F.when(job["apply_url"] != "", job["apply_url"]).otherwise(job["original_url"]), job["source_url"]


def url_quality(job: Fields) -> Column:
    apply_to, source = _addresses(job)
    host = lambda x: F.regexp_extract(x, "https?://([^/]+)", 1)
    whole = points(
        0,
        (25, quality.apply_url(apply_to)),
        (15, quality.web_url(source)),
        (20, ~fields.any_of(apply_to, GENERIC_BOARDS)),
        (15, ~fields.any_of(apply_to, LOGINS)),
        (15, apply_to.rlike(POSTING_PATHS)),
        (10, (host(apply_to) != "") & (host(apply_to) == host(source))),
    )
    return F.when((apply_to != "") & (source != ""), whole).when(apply_to != "", 10).otherwise(0).cast("long")


def pay_confidence(job: Fields, low: Column, high: Column, candidates: Column) -> Column:
    """``low`` and ``high`` are the parsed amounts, ``candidates`` an array of texts that might be pay."""
    why, raw, sure = job["pay_rejection_reason"], job["raw_salary"], F.lower(job["pay_confidence"])
    bounded = (high > 0) & (high <= pay.HIGHEST) & (high >= low)
    numbered = F.exists(candidates, lambda s: s.rlike("[0-9,]+"))
    return points(
        0,
        (40, sure == "high"),
        (25, sure == "medium"),
        (10, sure == "low"),
        (25, job["salary"].rlike("[0-9,]") | low.isNotNull() | high.isNotNull()),
        (15, raw.rlike("[0-9]") & (why != "missing_pay_context")),
        (5, raw.rlike("[0-9]") & (why == "missing_pay_context")),
        (5, why == "missing_pay_context"),
        (10, why == ""),
        (10, numbered & F.exists(candidates, lambda s: s.rlike("[$£€¥]"))),
        (-10, job["pay_parse_failed_snippet"].rlike("[$£€¥]")),
        (10, bounded),
        (5, ~F.coalesce(bounded, F.lit(False)) & (low > 0) & (low <= pay.HIGHEST)),
    )


def freshness(job: Fields, stale_score: Column, checked: Column, posted: Column, now: Column) -> Column:
    """Of the times of the last check and the posting, in days before ``now``; nothing that is said to be closed is fresh."""
    days = lambda x: (F.unix_micros(now.cast("timestamp")) - F.unix_micros(x.cast("timestamp"))) / 86_400_000_000
    since_check, since_post, state = days(checked), days(posted), F.lower(job["source_status"])
    closed = fields.any_of(job["description"], CLOSURES) | F.contains(job["apply_url"], F.lit("404"))
    told = points(
        50,
        (-30, stale_score > 50),
        (-10, (stale_score > 20) & (stale_score <= 50)),
        (10, stale_score == 0),
        (10, state == "live"),
        (-10, state == "needs_review"),
        (15, since_check < 3),
        (5, (since_check >= 3) & (since_check < 7)),
        (-10, since_check > 30),
        (15, since_post < 14),
        (-10, since_post > 90),
    )
    return F.when(closed, 0).otherwise(told).cast("long")


def location_quality(job: Fields) -> Column:
    place = job["location"]
    work = F.when(job["workplace_type"] == "", "").otherwise(fields.workplace(job["workplace_type"], F.lit(""), F.lit("")))
    valid = fields.valid_location(place)
    told = points(
        40,
        (25, valid),
        (-15, ~valid),
        (15, place.rlike(r"^[A-Za-z\s.]+,\s*[A-Z]{2}|^[A-Za-z\s.]+,\s*[A-Za-z\s.]+,")),
        (10, place.rlike("(?i)USA|United States|Canada|UK|Germany|Remote")),
        (10, work.isin("Remote", "On-site")),
        (5, work == "Hybrid"),
        (-5, (work != "") & F.contains(F.lower(place), F.lower(work))),
    )
    return F.when(place == "", 0).otherwise(told).cast("long")


def source_trust(source: Column) -> Column:
    """``source`` is a struct of provider, source_classification, trusted, auto_publish, manual_review_required and ``scoring``, a map of rates; null where none is known."""
    rate = lambda name: F.coalesce(F.try_element_at(source["scoring"], F.lit(name)), F.lit(""))
    kind, provider = F.coalesce(source["source_classification"], F.lit("")), F.lower(F.coalesce(source["provider"], F.lit("")))
    good = F.contains(kind, F.lit("trusted")) | F.contains(kind, F.lit("high_confidence"))
    told = points(
        50,
        (20, source["trusted"]),
        (10, source["auto_publish"]),
        (10, rate("parser_stability") == "high"),
        (10, rate("fetch_reliability") == "high"),
        (10, rate("structured_ats_confidence") == "high"),
        (5, rate("manual_cleanup_frequency") == "low"),
        (-10, rate("manual_cleanup_frequency") == "high"),
        (5, rate("malformed_pay_rate") == "low-target"),
        (-10, rate("malformed_pay_rate") == "high"),
        (5, rate("malformed_title_rate") == "low-target"),
        (-10, rate("malformed_title_rate") == "high"),
        (5, rate("duplicate_rate") == "low"),
        (10, good),
        (-15, ~good & kind.rlike("low_confidence|experimental")),
        (-10, source["manual_review_required"]),
        (5, provider.isin(*STRUCTURED_PROVIDERS)),
        (-15, provider == "taleo"),
    )
    return F.when(source.isNull(), 30).otherwise(told).cast("long")


def risky(source: Column, named: tuple[str, ...] = ()) -> Column:
    """Whether records of a source always need a person: those named, by id or organisation, and providers that are read badly."""
    rate = lambda name: F.coalesce(F.try_element_at(source["scoring"], F.lit(name)), F.lit(""))
    low = lambda c: F.lower(F.coalesce(source[c], F.lit("")))
    unsteady = (low("provider") == "bamboohr") & ((rate("parser_stability") == "low") | (rate("malformed_pay_rate") == "high") | (rate("manual_cleanup_frequency") == "high"))
    by_name = low("id").isin(*named) | low("organization").isin(*named) if named else F.lit(False)
    return F.coalesce(source.isNotNull() & (by_name | low("provider").isin(*RISKY_PROVIDERS) | unsteady), F.lit(False))


def duplicate_keys(job: Fields) -> Column:
    """Keys by which a record is the same as another: its number, its address, and organisation with title, alone and with place."""
    plain = lambda c: F.regexp_replace(F.lower(job[c]), "[^a-z0-9]+", "")
    both = (plain("organization") != "") & (plain("title") != "")
    apply_to, _ = _addresses(job)
    return F.array_distinct(F.array_compact(F.array(
        F.when(job["external_id"] != "", F.concat(F.lit("eid:"), F.lower(job["external_id"]))),
        F.when(apply_to != "", F.concat(F.lit("url:"), F.lower(apply_to))),
        F.when(both, F.concat(F.lit("ot:"), plain("organization"), F.lit(":"), plain("title"))),
        F.when(both & (plain("location") != ""), F.concat(F.lit("otl:"), plain("organization"), F.lit(":"), plain("title"), F.lit(":"), plain("location"))),
    )))


def _ends(df: DataFrame, id_: str, name: str) -> DataFrame:
    """The smallest and largest id of each key."""
    keyed = df.select(F.col(id_).cast("string").alias("_i"), F.explode(duplicate_keys(quality.of(df))).alias("_key"))
    return keyed.groupBy("_key").agg(F.min("_i").alias(f"_{name}_low"), F.max("_i").alias(f"_{name}_high"))


def shared_keys(pending: DataFrame, public: DataFrame, id_: str) -> DataFrame:
    """id, and how many of its keys other public (``n_public``) and pending (``n_pending``) records have; records without keys have no row."""
    own = pending.select(F.col(id_), F.explode(duplicate_keys(quality.of(pending))).alias("_key"))
    met = own.join(_ends(pending, id_, "pending"), "_key").join(_ends(public, id_, "public"), "_key", "left")
    other = lambda name: F.coalesce((F.col(f"_{name}_low") != F.col(id_).cast("string")) | (F.col(f"_{name}_high") != F.col(id_).cast("string")), F.lit(False)).cast("int")
    return met.groupBy(id_).agg(F.sum(other("public")).alias("n_public"), F.sum(other("pending")).alias("n_pending"))


def with_sources(pending: DataFrame, sources: DataFrame) -> DataFrame:
    """``pending`` with ``source_row``: the source of its ``source_id``, else of its organisation, else null. Of sources alike the first by id counts."""
    known = sources.select(F.struct(*sources.columns).alias("_s"))
    by = lambda c: keep_first(known.select(F.lower(F.col(f"_s.{c}")).alias(f"_{c}"), F.col("_s").alias(f"_by_{c}")).where(has_value(F.col(f"_{c}"))), [f"_{c}"], [F.col(f"_by_{c}.id")])
    met = pending.join(by("id"), F.lower("source_id") == F.col("_id"), "left").join(by("organization"), F.lower(pending["organization"]) == F.col("_organization"), "left")
    return met.withColumn("source_row", F.coalesce("_by_id", "_by_organization")).drop("_id", "_by_id", "_organization", "_by_organization")


def governed(pending: DataFrame, public: DataFrame, sources: DataFrame, archived: DataFrame, id_: str, now: Column, named: tuple[str, ...] = ()) -> DataFrame:
    """id, the seven factors, ``score``, ``publish`` and ``blocked_by``, the gates that a pending record does not pass.

    ``archived`` has the ids that the archive guard stopped. Archived rows of ``pending`` are left out. Nulls count as
    empty; columns that a table lacks, too. Ids are unique; an id that repeats counts as one record with all its keys.
    """
    live = pending.where(F.lower(F.coalesce("status", F.lit(""))) != "archived") if "status" in pending.columns else pending
    rows = with_sources(live, sources).join(shared_keys(live, public, id_), id_, "left").join(archived.select(id_, F.lit(True).alias("_archived")).distinct(), id_, "left")
    job = quality.of(rows)
    number = lambda c: F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")
    given = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    candidates = F.coalesce(given("pay_candidate_snippets", "array<string>"), F.array().cast("array<string>"))
    made = {
        "description_quality": description_quality(job),
        "url_quality": url_quality(job),
        "pay_confidence": pay_confidence(job, number("salary_min"), number("salary_max"), candidates),
        "freshness": freshness(job, number("stale_score"), given("last_checked_at", "timestamp"), given("date_posted", "timestamp"), now),
        "location": location_quality(job),
        "duplicate": clamp(F.lit(100) - 60 * F.coalesce("n_public", F.lit(0)) - 30 * F.coalesce("n_pending", F.lit(0))),
        "source_trust": source_trust(F.col("source_row")),
    }
    apply_to, source = _addresses(job)
    amount, like = job["salary"], F.lower(job["pay_like_detected"]) == "true"
    pay_open = ~amount.rlike("[0-9]") & ((job["pay_rejection_reason"] == "missing_pay_context") | (amount != "") | like)
    gates = {
        "pay": pay_open,
        "description": ~quality.usable_description(job["description"], job["title"], job["organization"]) | quality.junk(job["description"]),
        "duplicate": F.coalesce(F.col("n_public") > 0, F.lit(False)),
        "url": ~(quality.apply_url(apply_to) & quality.web_url(source)),
        "archive": F.coalesce("_archived", F.lit(False)),
        "risky_source": risky(F.col("source_row"), named),
    }
    step = rows.select(id_, *[c.alias(f"f_{n}") for n, c in made.items()], *[c.alias(f"g_{n}") for n, c in gates.items()])
    total = sum((F.col(f"f_{n}") * w for n, w in WEIGHTS.items()), F.lit(0))
    step = step.withColumn("score", F.floor((total + 50) / 100).cast("long"))
    failed = F.array_compact(F.array(F.when(F.col("score") < LEAST_SCORE, "score"), F.when(F.col("f_freshness") < LEAST_FRESHNESS, "freshness"), *[F.when(F.col(f"g_{n}"), n) for n in gates]))
    step = step.withColumn("blocked_by", failed)
    return step.select(id_, *[F.col(f"f_{n}").alias(n) for n in made], "score", (F.size("blocked_by") == 0).alias("publish"), "blocked_by")
