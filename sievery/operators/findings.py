"""Quality checks of records: each finds issues in a row, all in one pass, and what is found decides where a record goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.functions import fields, quality
from sievery.operators.canonical import CLOSED

# Boards that are no employer's page, and phrases by which descriptions are judged.
BOARDS = ("indeed.com", "linkedin.com/jobs", "glassdoor.com", "monster.com", "ziprecruiter.com", "simplyhired.com", "careerbuilder.com", "dice.com", "google.com/jobs")
SEVERAL_ROLES = ("also hiring", "positions include", "open positions", "we are looking for a", "we are seeking a", "we are hiring for", "multiple positions")
OTHER_SECTIONS = ("about us", "about the company", "company overview", "our mission", "we are a", "about our organization")
ROLE_PHRASES = ("you will", "this role", "this position", "responsibilities", "qualifications", "requirements", "the ideal candidate")
MODES = ("remote", "hybrid", "on-site", "on site")
DEAD_STATES = ("closed", "expired", "removed", "archived")
LOW_PAY, HIGH_PAY = (0.0, 6.0), 500_000.0

LOWERED = ("title", "location", "workplace_type", "description", "source_url", "apply_url", "status")

#: Checks whose findings a repair can mend; records with others need a person.
REPAIRABLE = ("work_mode", "structure", "title_location", "description")


def _hits(x: Column, phrases: tuple[str, ...]) -> Column:
    return sum((F.when(F.contains(x, F.lit(p)), 1).otherwise(0) for p in phrases), F.lit(0))


def _starts(x: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | x.startswith(p)
    return found


def cases(job: quality.Fields, description: Column) -> list[tuple[str, str, str, Column]]:
    """check, issue, field and condition of all findings; ``description`` keeps its line ends, and ``low_...`` are fields in lower case."""
    low = {x: job[f"low_{x}"] for x in LOWERED}
    raw, said = job["raw_salary"], description
    amount = F.regexp_extract(F.regexp_replace(job["salary"], "[$,£€¥]", ""), r"^ *([0-9]+(?:[.][0-9]+)?)", 1).try_cast("double")
    whole = F.regexp_extract(F.regexp_replace(raw, "[$,£€¥ ]", ""), r"^([0-9]+(?:[.][0-9]+)?)", 1).try_cast("double")
    letters = F.length(F.regexp_replace(raw, "[^a-zA-Z]", ""))
    mode = low["workplace_type"]
    generic = lambda x: _hits(x, BOARDS) > 0
    workday = lambda x: F.contains(x, F.lit("myworkdayjobs.com")) & F.contains(x, F.lit("/apply/"))
    bullets = r"(?m)^[ \t]*[•●○*-]\s"
    return [
        ("work_mode", "location repeats the workplace", "location", (mode != "") & (low["location"] == mode)),
        ("work_mode", "location contains the workplace", "location", (mode != "") & (low["location"] != mode) & F.contains(low["location"], mode)),
        ("dead_role", "says that it is closed", "description", fields.any_of(F.concat_ws(" ", job["title"], job["description"]), CLOSED)),
        ("dead_role", "status is closed but it is published", "status", low["status"].isin(*DEAD_STATES) & (F.lower(job["published"]) == "true")),
        ("invalid_pay", "salary above the highest believed", "salary", (amount > HIGH_PAY) & (job["manual_pay_approved"] == "")),
        ("invalid_pay", "salary is zero", "salary", amount == LOW_PAY[0]),
        ("invalid_pay", "salary is a placeholder", "salary", amount == LOW_PAY[1]),
        ("invalid_pay", "raw pay holds a uuid", "raw_salary", raw.rlike("(?i)[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}")),
        ("invalid_pay", "raw pay holds a date", "raw_salary", raw.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}")),
        ("invalid_pay", "raw pay holds a percentage", "raw_salary", raw.contains("%")),
        ("invalid_pay", "raw pay is prose", "raw_salary", (F.length(raw) > 10) & ~raw.rlike("[$£€¥0-9]") & (letters * 2 > F.length(raw))),
        ("invalid_pay", "raw pay is inflated", "raw_salary", (F.regexp_count(raw, F.lit(",")) >= 2) & (whole > 1_000_000)),
        ("bad_link", "source is a generic board", "source_url", generic(low["source_url"])),
        ("bad_link", "application is at a generic board", "apply_url", generic(low["apply_url"])),
        ("bad_link", "careers page without a posting", "source_url", F.contains(low["source_url"], F.lit("bamboohr.com/careers")) & (job["external_id"] == "") & ~low["source_url"].rlike("/careers/?[0-9]+")),
        ("bad_link", "application form as source", "source_url", workday(low["source_url"])),
        ("bad_link", "application form as address", "apply_url", workday(low["apply_url"])),
        ("description", "raw html", "description", said.rlike("(?i)viewBox|<svg|<span[> ]|<div[> ]|<style")),
        ("description", "several roles", "description", _hits(low["description"], SEVERAL_ROLES) >= 3),
        ("description", "starts with another section", "description", _starts(low["description"], OTHER_SECTIONS) & (F.length(said) > 150) & (_hits(low["description"], ROLE_PHRASES) == 0)),
        ("structure", "one paragraph", "description", (F.length(said) > 500) & ~F.contains(said, F.lit("\n"))),
        ("structure", "bullets within lines", "description", (F.length(said) >= 200) & said.rlike("[•●○]") & said.rlike(bullets) & said.rlike(r"[^\n \t][ \t]*[•●○]\s")),
        ("title_location", "unbalanced parentheses", "title", F.regexp_count(job["title"], F.lit("[(]")) != F.regexp_count(job["title"], F.lit("[)]"))),
        ("title_location", "title is a workplace", "title", low["title"].isin(*MODES)),
    ]


def findings(df: DataFrame, id_: str) -> DataFrame:
    """id, check, issue and field of each finding in ``df``; columns that it lacks find nothing, nor do nulls."""
    job = quality.of(df)
    used = ("title", "location", "workplace_type", "description", "source_url", "apply_url", "status", "salary", "raw_salary", "external_id", "published", "manual_pay_approved")
    whole = F.col("description").cast("string") if "description" in df.columns else F.lit("")
    # Fields are columns of their own, made once, however many cases read them.
    step = df.select(F.col(id_).alias("id_"), F.coalesce(whole, F.lit("")).alias("whole_"), *[job[x].alias(f"{x}_") for x in used])
    step = step.withColumns({f"low_{x}": F.lower(f"{x}_") for x in LOWERED})
    made = quality.Fields({x: F.col(f"{x}_") for x in used} | {f"low_{x}": F.col(f"low_{x}") for x in LOWERED})
    told = [F.when(c, F.struct(F.lit(check).alias("check"), F.lit(issue).alias("issue"), F.lit(field).alias("field"))) for check, issue, field, c in cases(made, F.col("whole_"))]
    return step.select(F.col("id_").alias(id_), F.explode(F.array_compact(F.array(*told))).alias("f")).select(id_, "f.*")


def routed(found: DataFrame, id_: str) -> DataFrame:
    """Where each record with findings goes: repair if all its checks can be mended, else review; with its checks."""
    mendable = F.col("check").isin(*REPAIRABLE)
    return found.groupBy(id_).agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.array_join(F.array_sort(F.collect_set("check")), ",").alias("checks"),
        F.when(F.bool_and(mendable), "repair").otherwise("review").alias("route"),
    )
