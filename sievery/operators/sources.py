"""Sources of records: what kind they are, which of them a sync reads, and whose posting a record of a board is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.functions import fields, text, url

# Providers that are read directly.
DIRECT = ("greenhouse", "lever", "ashby", "bamboohr", "recruitee", "smartrecruiters", "workable", "careerpuck", "trakstar", "taleo")
# What no employer is called, and how titles name one.
NO_EMPLOYER = r"(?i)\b(?:job|jobs|career|careers|apply|application|details?|opportunity|opening|position|role|remote|hybrid|full[- ]?time|part[- ]?time|engineer|manager|director|analyst|coordinator|developer|designer|specialist|officer|associate|lead)\b"
EMPLOYER = r"^[A-Za-z0-9&+.'()/ -]{2,80}$"
SEPARATORS = (" — ", " – ", " - ", " | ", " @ ", ", ")
EMPLOYER_KEYS = ("company", "company_name", "companyName", "organization_name", "organizationName", "org_name", "orgName", "employer", "employer_name", "hiring_organization", "hiringOrganization", "team_name", "brand")
FLAGS = ("trusted", "auto_publish", "manual_review_required", "community_submission", "temporarily_disabled")
ON = ("enabled", "parser_enabled", "sync_enabled", "custom_sync_enabled")
TEXTS = ("id", "organization", "name", "type", "provider", "source_classification", "source_confidence_tier")


def normalized(df: DataFrame, manual: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``source``, a struct of what a source is: organization, type, provider, enabled, sync_enabled, custom_sync_enabled, manual_review_required, classification, confidence, direct and discovery.

    Flags that are absent or null count as off, but for enabled, parser_enabled, sync_enabled and custom_sync_enabled, which count as on. ``manual``
    names organisations that editors read by hand, by words that a name contains; their sources and submissions of the community aren't synced.
    ``direct``: the sync reads the provider itself; ``discovery``: it looks for postings on the source's pages. Columns that ``df`` lacks are empty.
    """
    has = set(df.columns)
    said = {x: F.trim(F.coalesce(F.col(x).cast("string"), F.lit(""))) if x in has else F.lit("") for x in TEXTS}
    on = {x: F.coalesce(F.col(x), F.lit(x in ON)) if x in has else F.lit(x in ON) for x in (*FLAGS, *ON)}
    name = F.coalesce(*[F.nullif(said[x], F.lit("")) for x in ("organization", "name", "id")], F.lit(""))
    token = text.identity_token(name)
    by_hand = F.lit(False)
    for one in manual:
        by_hand = by_hand | F.contains(token, text.identity_token(F.lit(one)))
    kind, provider = F.lower(said["type"]), F.lower(said["provider"])
    direct = provider.isin(*DIRECT)
    classified = (
        F.when(said["source_classification"] != "", said["source_classification"])
        .when(on["community_submission"], "community_submission_source")
        .when(by_hand | on["manual_review_required"], "tracked_manual_org")
        .when(on["enabled"] & on["trusted"] & on["auto_publish"] & (kind == "ats") & direct, "trusted_ats_auto_sync")
        .when(on["enabled"] & on["parser_enabled"] & (on["trusted"] | kind.isin("ats", "custom")), "trusted_nonprofit_pending_review")
        .when(on["enabled"] & on["parser_enabled"] & (kind == "generic"), "manual_review_community")
        .otherwise("low_confidence_experimental")
    )
    step = df.withColumns({"_class": classified, "_hand": by_hand})
    level = F.when(F.col("_class") == "trusted_ats_auto_sync", "high").when(F.col("_class").isin("trusted_nonprofit_pending_review", "manual_review_community"), "medium").otherwise("low")
    syncs = on["sync_enabled"] & ~F.col("_hand") & ~on["community_submission"]
    reads = (kind == "ats") & direct
    parts = {
        "organization": name,
        "type": kind,
        "provider": provider,
        "enabled": on["enabled"],
        "sync_enabled": syncs,
        "custom_sync_enabled": on["custom_sync_enabled"],
        "manual_review_required": on["manual_review_required"] | F.col("_hand"),
        "classification": F.col("_class"),
        "confidence": F.when(said["source_confidence_tier"] != "", F.lower(said["source_confidence_tier"])).otherwise(level),
        "direct": syncs & reads,
        "discovery": on["enabled"] & on["custom_sync_enabled"] & ~reads,
    }
    return step.select(*df.columns, F.struct(*[c.alias(n) for n, c in parts.items()]).alias("source"))


def preserved(status: Column, published: Column, overrides: Column, protected: Column, notes: Column) -> Column:
    """Whether a record that isn't public stays in the store: it is archived or rejected, or somebody has worked on it."""
    worked = (F.coalesce(F.size(overrides), F.lit(0)) > 0) | (F.coalesce(F.size(protected), F.lit(0)) > 0) | F.coalesce(F.trim(notes) != "", F.lit(False))
    return ~F.coalesce(published, F.lit(False)) & (F.coalesce(F.lower(status).isin("archived", "rejected"), F.lit(False)) | worked)


def employer(x: Column, boards: tuple[str, ...] = ()) -> Column:
    """Whether a text may name an employer: short, of plain characters, no role and none of the ``boards``, which are lower-case names."""
    known = F.lower(F.trim(x)).isin(*boards) if boards else F.lit(False)
    return x.rlike(EMPLOYER) & ~x.rlike(NO_EMPLOYER) & ~known & ~x.rlike("(?i)^https?://")


def attributed(df: DataFrame, title: Column, payload: Column, address: Column, description: Column, boards: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``attribution``: ``organization``, ``confidence`` and ``origin`` of the best candidate, and ``others``, the candidates that lost.

    Candidates come from the end of the title, fields of the payload (a variant), the address and the head of the description, in this order.
    The first of high confidence is best, else the first; where there is none, the organisation is unknown with low confidence. The others stay, in
    the order of their standing, for audits. A candidate that another origin has found too is listed for both.
    """
    step = df.withColumns({"_title": text.normalize_whitespace(F.coalesce(title, F.lit(""))), "_said": text.normalize_whitespace(F.coalesce(description, F.lit(""))), "_payload": payload})
    at_end = F.lit(None).cast("string")
    for mark in SEPARATORS:
        end = F.trim(F.element_at(F.split(F.col("_title"), F.regexp_replace(F.lit(mark), "[|]", "\\\\|")), -1))
        at_end = F.coalesce(at_end, F.when(F.contains("_title", F.lit(mark)) & (end != "") & employer(end, boards), end))
    embedded = [F.trim(F.try_variant_get("_payload", f"$.{k}", "string")) for k in EMPLOYER_KEYS]
    field = F.coalesce(*[F.when(employer(v, boards), F.struct(v.alias("name"), F.lit(f"embedded_field:{k}").alias("origin"))) for k, v in zip(EMPLOYER_KEYS, embedded, strict=True)])
    by_address = url.organization(address)
    head = F.regexp_extract("_said", r"(?:https?://\S+\s+)?\b\d{4,12}\b\s+([A-Z][A-Za-z0-9&+.'()/-]*(?:\s+[A-Z][A-Za-z0-9&+.'()/-]*){0,4})\s+(?:(?i:series[_ ][a-z_]+|seed|pre[_ -]?seed|ipo|public|private|nonprofit|other)\b|https?://)", 1)
    step = step.withColumns({"_end": at_end, "_field": field, "_address": by_address, "_head": F.when((head != "") & employer(head, boards), head)})
    found = [("_end", F.col("_end"), F.lit("high"), F.lit("title_suffix")), ("_field", F.col("_field.name"), F.lit("high"), F.col("_field.origin")), ("_address", F.when(employer(F.col("_address.name"), boards), F.col("_address.name")), F.col("_address.confidence"), F.lit("address")), ("_head", F.col("_head"), F.lit("high"), F.lit("description_metadata"))]
    listed = [F.when(name.isNotNull(), F.struct((level != "high").alias("lower"), F.lit(i).alias("turn"), name.alias("organization"), level.alias("confidence"), origin.alias("origin"))) for i, (_, name, level, origin) in enumerate(found)]
    step = step.withColumn("_listed", F.array_sort(F.array_compact(F.array(*listed))))
    shown = F.transform("_listed", lambda c: F.struct(c["organization"].alias("organization"), c["confidence"].alias("confidence"), c["origin"].alias("origin")))
    best = F.get(shown, F.lit(0))
    parts = [F.coalesce(best[k], F.lit(v)).alias(k) for k, v in (("organization", "Unknown organization"), ("confidence", "low"), ("origin", "none"))]
    return step.select(*df.columns, F.struct(*parts, F.when(F.size("_listed") > 1, F.slice(shown, F.lit(2), F.size("_listed"))).otherwise(F.slice(shown, 1, 0)).alias("others")).alias("attribution"))
