"""New observations merged into existing state, and guards on what a merge may change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.functions.values import changed_fields, has_value, prefer
from sievery.operators.audit import counted


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``existing`` whose key is not among them."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def merge_health(previous: DataFrame, current: DataFrame) -> DataFrame:
    """A health row for each source in either (source_id, failures, last_success, last_checked).

    Failures add up until a check without any resets them; the last success is only moved by one. Sources that were not
    checked keep their row.
    """
    a, b = previous.alias("a"), current.alias("b")
    met = a.join(b, F.col("a.source_id") == F.col("b.source_id"), "full_outer")
    checked, failed = F.col("b.source_id").isNotNull(), F.coalesce(F.col("b.failures"), F.lit(0)) > 0
    failures = F.when(~checked, F.col("a.failures")).when(failed, F.coalesce(F.col("a.failures"), F.lit(0)) + F.col("b.failures")).otherwise(0)
    success = F.when(failed, F.coalesce(F.col("a.last_success"), F.col("b.last_success"))).otherwise(F.coalesce(F.col("b.last_success"), F.col("a.last_success")))
    return met.select(
        F.coalesce(F.col("b.source_id"), F.col("a.source_id")).alias("source_id"),
        failures.cast("long").alias("failures"),
        success.alias("last_success"),
        F.coalesce(F.col("b.last_checked"), F.col("a.last_checked")).alias("last_checked"),
    )


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in one only, and in which."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    only = lambda x, y, side: x.join(y, key, "left_anti").withColumn("only_in", F.lit(side))
    return only(left, right, "a").unionByName(only(right, left, "b"))


def unexplained_drops(existing: DataFrame, proposed: DataFrame, explained: DataFrame, key: str) -> DataFrame:
    """Keys that would vanish without being explained."""
    return existing.select(key).distinct().join(proposed.select(key), key, "left_anti").join(explained.select(key), key, "left_anti")


def compare_snapshots(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of both, with ``status`` (added, removed, changed, same) and the fields that differ."""
    a = old.select(key, *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("_old"))
    b = new.select(key, *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("_new"))
    met = a.join(b, key, "full_outer")
    fields_changed = F.when(F.col("_old") & F.col("_new"), changed_fields(met, fields, "old_", "new_")).otherwise(F.array().cast("array<string>"))
    marked = met.withColumn("changed", fields_changed)
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.size("changed") > 0, "changed").otherwise("same")
    return marked.withColumn("status", status).drop("_old", "_new")


def compare_versions(versions: dict[str, DataFrame], key: str, fields: list[str]) -> DataFrame:
    """Rows of any of the versions by key: ``present`` (their names) and ``differences``, the fields on which they do not all agree.

    A difference has the field, its ``pattern`` and ``blanked``. The pattern has a letter for each version in order, that
    of the first version with the same value, and ``-`` where the row is missing: of three, AAC was changed by the last,
    ABA taken back, and A-C missed one. ``blanked`` says that the last version present has no value where an earlier one has. One union and
    one aggregate, whatever the number of versions; of rows of a version that repeat a key the largest counts.
    """
    names, tagged = list(versions), None
    for i, df in enumerate(versions.values()):
        part = df.select(key, F.lit(i).alias("_version"), F.struct(*fields).alias("_values"))
        tagged = part if tagged is None else tagged.unionByName(part)
    met = tagged.groupBy(key).agg(*[F.max(F.when(F.col("_version") == i, F.col("_values"))).alias(f"_{i}") for i in range(len(names))])
    there = [F.col(f"_{i}").isNotNull() for i in range(len(names))]

    def letter(f: str, i: int) -> Column:
        out = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"[i])
        for j in reversed(range(i)):
            out = F.when(there[j] & F.col(f"_{j}.{f}").eqNullSafe(F.col(f"_{i}.{f}")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[j]).otherwise(out)
        return F.when(there[i], out).otherwise("-")

    def difference(f: str) -> Column:
        values = [F.col(f"_{i}.{f}") for i in range(len(names))]
        last = F.coalesce(*[F.when(there[i], F.coalesce(has_value(values[i]), F.lit(False))) for i in reversed(range(len(names)))])
        some = F.lit(False)
        for i, v in enumerate(values):
            some = some | (there[i] & has_value(v))
        pattern = F.concat(*[letter(f, i) for i in range(len(names))])
        several = F.size(F.array_distinct(F.filter(F.split(pattern, ""), lambda c: ~c.isin("-", "")))) > 1
        return F.when(several, F.struct(F.lit(f).alias("field"), pattern.alias("pattern"), (some & ~last).alias("blanked")))

    present = F.array_compact(F.array(*[F.when(there[i], F.lit(n)) for i, n in enumerate(names)]))
    return met.select(key, present.alias("present"), F.array_compact(F.array(*[difference(f) for f in fields])).alias("differences"))


def count_differences(compared: DataFrame, key: str) -> DataFrame:
    """Differences of ``compare_versions`` by field and pattern: ``n``, how many of them blanked a value, and a few examples."""
    rows = compared.select(key, F.explode("differences").alias("d")).select(key, "d.*")
    return counted(rows, ["field", "pattern"], key, blanked=F.col("blanked").cast("long"))


def safe_merge(current: DataFrame, proposed: DataFrame, key: str, fields: list[str], risky: dict[str, Column]) -> DataFrame:
    """Current rows with the proposed values, but for blanks and what ``risky`` (over old_ and new_ columns) forbids, listed in ``kept``."""
    a = current.select(key, *[F.col(f).alias(f"old_{f}") for f in fields])
    b = proposed.select(key, *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("_found"))
    met = a.join(b, key, "left")
    held = {f: F.coalesce(risky.get(f, F.lit(False)), F.lit(False)) for f in fields}
    merged = [F.when(held[f], F.col(f"old_{f}")).otherwise(prefer(F.col(f"new_{f}"), F.col(f"old_{f}"))).alias(f) for f in fields]
    kept = F.array_compact(F.array(*[F.when(F.col("_found") & held[f], F.lit(f)) for f in fields]))
    return met.select(key, *merged, kept.alias("kept"))


def provenance_merge(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field by field, with where the value is from.

    ``existing`` has the fields, a map ``manual`` (field to the time of a manual edit) and ``updated_at``; ``incoming``
    the fields and ``seen_at``. A manual value newer than what comes in stays, and a different incoming one is a conflict.
    """
    a = existing.select(key, "manual", *[F.col(f).alias(f"old_{f}") for f in fields])
    b = incoming.select(key, "seen_at", *[F.col(f).alias(f"new_{f}") for f in fields])
    met = a.join(b, key, "full_outer")
    out, origin, conflicts = [], [], []
    for f in fields:
        old, new = F.col(f"old_{f}"), F.col(f"new_{f}")
        manual = F.coalesce(F.try_element_at("manual", F.lit(f)) >= F.col("seen_at"), F.lit(False))
        taken = ~manual & F.coalesce(F.trim(new.cast("string")) != "", F.lit(False))
        out.append(F.when(taken, new).otherwise(old).alias(f))
        origin.append(F.when(manual, "manual").when(taken, "source").when(old.isNotNull(), "previous").otherwise("none"))
        conflicts.append(F.when(manual & new.isNotNull() & ~old.eqNullSafe(new), F.lit(f)))
    meta = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*origin))
    return met.select(key, *out, meta.alias("origin"), F.array_compact(F.array(*conflicts)).alias("conflicts"))
