"""Canonical records: raw postings to one row of clean fields each, and one row for each identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.functions import fields, money, pay, quality, taxonomy, text, url
from sievery.functions.values import first_value

# What says that a posting is closed, and how a field may be called.
CLOSED = (
    r"(?i)\b(?:applications? closed|no longer accepting applications|closed for applications|new applications are no longer being accepted)\b",
    r"(?i)\b(?:position has been filled|this role has been filled|job is no longer available|(?:position|role) (?:is |has been )?closed)\b",
    r"(?i)404\b|\bpage not found\b|\bthe page you are looking for does not exist\b|\bpage may have moved\b|\bnot found\b",
)
ALIASES = {
    "external_id": ("external_id", "externalId", "requisition_id"),
    "organization": ("organization", "company", "employer"),
    "description": ("description", "descriptionPlain", "content", "summary"),
    "workplace_type": ("workplace_type", "workplaceType"),
    "job_type": ("job_type", "jobType", "employment_type"),
    "apply_url": ("apply_url", "applyUrl", "original_url"),
    "source_url": ("source_url", "sourceUrl", "original_url"),
    "salary": ("salary", "pay", "compensation"),
    "date_posted": ("date_posted", "datePosted", "published_at"),
}
# Fields of work, in this order.
SPECIALIZATIONS = (
    ("PR / Press", r"\b(?:pr|public relations|press|press secretary|media relations|press officer|press manager|press lead)\b"),
    ("Policy", r"\b(?:policy|public affairs|government affairs|external affairs|regulatory affairs|advocacy)\b"),
    ("Communications", r"\b(?:communications|communication|comms|internal communications|external communications)\b"),
    ("Video", r"\b(?:video|videographer|video editor|video producer|multimedia producer|motion designer|motion graphics|youtube|documentary|short-form video|short form video|digital video|social video|creative producer|content producer|film producer|creator lead|creator network|vertical video|digital producer)\b"),
    ("Social Media", r"\b(?:social media|social strategy|community manager|community lead|tiktok|instagram|linkedin content|bluesky|rapid response clips)\b"),
    ("Content", r"\b(?:content|editorial|copywriter|copywriting|storytelling|writer|newsletter|content design)\b"),
    ("Art / Creative", r"\b(?:creative|art director|artistic|illustration|visual storytelling|brand studio)\b"),
    ("Design", r"\b(?:design|designer|graphic design|visual design|product design|ux|ui)\b"),
    ("Product", r"\b(?:product manager|product owner|product lead|product strategy)\b"),
    ("Strategy", r"\b(?:strategy|strategist|strategic|planning|planning director)\b"),
    ("Engineering", r"\b(?:firmware|platform engineer|software engineer|engineer|engineering|developer|backend|back-end|frontend|front-end|full stack|full-stack|devops|sre|site reliability|technical architect)\b"),
    ("Web", r"\b(?:web|website|webmaster|wordpress)\b"),
    ("Operations", r"\b(?:operations|operator|operations coordinator|operations specialist|supervisor|scada|field operations|customer operations|mobilization|implementation|logistics|supply chain)\b"),
    ("Programs", r"\b(?:program manager|programme manager|program director|program coordinator|program lead)\b"),
    ("Admin", r"\b(?:executive assistant|administrative assistant|admin|administrator|office manager)\b"),
    ("Sales", r"\b(?:sales|account executive|account manager|business development|partnerships|customer success|consultant|revenue)\b"),
    ("Digital", r"\b(?:digital|digital marketing|digital campaigns|growth marketing|crm|email marketing|seo|sem)\b"),
    ("Data", r"\b(?:data|analytics|analyst|business intelligence|bi analyst|insights)\b"),
    ("Research", r"\b(?:research|researcher|research associate|user research|market research)\b"),
    ("Campaigns", r"\b(?:campaign|campaigns|campaigner|field organizing|organizing)\b"),
)


def raw_fields(df: DataFrame) -> quality.Fields:
    """Fields of raw rows: the first alias that has a value."""
    known, out = set(df.columns), quality.of(df)
    for name, aliases in ALIASES.items():
        present = [F.col(a).cast("string") for a in aliases if a in known]
        if present:
            out[name] = F.coalesce(first_value(*present), F.lit(""))
    return out


def exclusion(job: quality.Fields, blocked: tuple[str, ...] = ()) -> Column:
    """closed_application, blocked_organization or the empty text."""
    said = F.concat_ws(" ", *[job[x] for x in ("title", "description", "raw_description", "notes", "apply_url", "source_url")])
    named = F.lower(job["organization"])
    hit = F.exists(F.array(*map(F.lit, blocked)), lambda b: F.contains(named, b)) if blocked else F.lit(False)
    return F.when(fields.any_of(said, CLOSED), "closed_application").when(hit, "blocked_organization").otherwise("")


def specialization(explicit: Column, job: quality.Fields) -> Column:
    """A struct of ``label`` and ``confidence``: an explicit field by the rules or as it is, else the first text that a rule matches."""
    matched = taxonomy.first_match(explicit, SPECIALIZATIONS)
    told = F.when(explicit != "", F.struct(F.coalesce(matched, explicit).alias("label"), F.when(matched.isNotNull(), "high").otherwise("medium").alias("confidence")))
    found = taxonomy.classify([(job["title"], "high"), (job["function"], "medium"), (job["tags"], "medium"), (job["description"], "low"), (job["raw_description"], "low")], SPECIALIZATIONS, "")
    return F.coalesce(told, found)


def canonical(df: DataFrame, today: Column, blocked: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """One clean row for each raw row that isn't excluded; ``keep`` names columns to carry along.

    Rows keep their order numbers and ids only by ``keep``. Null fields count as empty, an unknown date is ``today``, and
    an empty table gives an empty table. All is column expressions: one pass, no shuffle.
    """
    job = raw_fields(df)
    step = df.select(*keep, exclusion(job, blocked).alias("excluded"), *[job[x].alias(f"raw_{x}") for x in _READ]).where("excluded = ''").drop("excluded")
    raw = quality.Fields({x: F.col(f"raw_{x}") for x in _READ})
    plain = text.strip_html(raw["description"])
    parts = fields.title_parts(fields.cut(raw["title"], fields.TITLE_CUTS))
    step = step.withColumns({"organization": fields.clean_organization(raw["organization"]), "plain": plain, "behind": parts})
    step = step.withColumn("title", fields.clean_title(raw["title"], F.col("organization")))
    said = F.concat_ws(" ", raw["location"], raw["title"], F.col("plain"))
    step = step.withColumn("workplace_type", fields.workplace(F.coalesce(first_value(raw["workplace_type"], F.col("behind.workplace")), F.lit("")), said, raw["location"]))
    location = F.coalesce(first_value(raw["location"], F.col("behind.place")), F.lit(""))
    step = step.withColumns({
        "location": fields.clean_location(location, F.col("workplace_type"), F.col("title")),
        "paid": pay.extracted([("ats_field", raw["salary"])], raw["description"]),
        "quality": fields.title_quality(F.col("title")),
    })
    step = step.withColumn("range", money.parse_range(F.col("paid.text"), F.col("location")))
    step = step.withColumn("refused", pay.rejection(F.col("paid.text"), F.col("range.low"), F.col("range.high"), F.col("plain")))
    believed = (F.col("refused") == "") & F.col("range.visible")
    made = quality.Fields({"title": F.col("title"), "function": raw["function"], "tags": raw["tags"], "description": F.col("plain")})
    field = specialization(raw["specialization"], made)
    shown = money.display(F.col("range.low"), F.col("range.high"), F.col("range.currency"), F.col("range.period"))
    return step.select(
        *keep,
        F.col("raw_external_id").alias("external_id"),
        "title",
        F.col("quality.confidence").alias("title_confidence"),
        F.array_join("quality.warnings", ",").alias("title_warnings"),
        "organization",
        "location",
        "workplace_type",
        fields.employment_type(raw["job_type"]).alias("job_type"),
        fields.sector(raw["sector"]).alias("sector"),
        field["label"].alias("specialization"),
        field["confidence"].alias("specialization_confidence"),
        F.col("plain").alias("description"),
        text.snippet(F.col("plain")).alias("description_snippet"),
        F.col("raw_description"),
        F.col("paid.text").alias("raw_salary"),
        F.when(believed, shown).otherwise("").alias("salary"),
        F.when(believed, F.col("range.low")).alias("salary_min"),
        F.when(believed, F.col("range.high")).alias("salary_max"),
        F.col("range.currency").alias("salary_currency"),
        F.col("range.period").alias("salary_period"),
        F.col("paid.source").alias("pay_parse_source"),
        F.coalesce(F.nullif(money.malformed(F.col("paid.text")), F.lit("")), F.col("refused")).alias("pay_parse_warning"),
        url.normalize_url(raw["apply_url"]).alias("apply_url"),
        url.normalize_url(raw["source_url"]).alias("source_url"),
        F.coalesce(F.try_to_date(F.substring(raw["date_posted"], 1, 10), "yyyy-MM-dd"), today).alias("date_posted"),
        F.col("raw_source").alias("source"),
        F.col("raw_tags").alias("tags"),
    )


_READ = ("external_id", "title", "organization", "location", "workplace_type", "job_type", "sector", "specialization", "function", "tags", "description", "salary", "apply_url", "source_url", "date_posted", "source")


def identity(job: quality.Fields) -> Column:
    """What tells records apart: the external id, else the address to apply at, else source, title and organisation."""
    low = lambda x: F.lower(job[x])
    return F.when(job["external_id"] != "", F.concat(F.lit("external::"), low("external_id"))).when(job["apply_url"] != "", F.concat(F.lit("apply::"), low("apply_url"))).otherwise(F.concat(F.lit("identity::"), F.concat_ws("::", low("source"), low("title"), low("organization"))))


def merged(df: DataFrame, key: Column, at: str, order: str, tags: str) -> DataFrame:
    """One row for each key: the latest row, the last in ``order`` of equally late ones, with the distinct tags of all in their first order.

    Rows without a time are the earliest. The number of tags of a key is the number of distinct ones; rows are never gathered.
    """
    keyed = df.withColumn("key", key)
    latest = keyed.groupBy("key").agg(F.max_by(F.struct(*df.columns), F.struct(F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(1 << 62))), F.col(order))).alias("row"))
    each = keyed.select("key", order, F.posexplode(tags).alias("place", "tag")).where("tag <> ''")
    first = each.groupBy("key", "tag").agg(F.min(F.struct(order, "place")).alias("place"))
    joined = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda t: t["tag"]).alias("all_tags"))
    rest = [c for c in df.columns if c != tags]
    return latest.join(joined, "key", "left").select("key", *[F.col(f"row.{c}").alias(c) for c in rest], F.coalesce("all_tags", F.array().cast("array<string>")).alias(tags))
