"""Column builders for values, alternatives and differences."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def has_value(x: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(x.cast("string")) != "", F.lit(False))


def first_value(*options: Column) -> Column:
    """The first alternative with a value, or null."""
    return F.coalesce(*[F.when(has_value(o), o) for o in options])


def prefer(new: Column, old: Column) -> Column:
    """The new value if it is one, else the old."""
    return F.coalesce(F.when(has_value(new), new), old)


def merge_maps(old: Column, new: Column) -> Column:
    """Maps of texts, key by key: the new value where it is one."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, a, b: F.coalesce(F.when(has_value(b), b), a))


def as_list(x: Column) -> Column:
    """Parts of a comma-separated text, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def reasons(*cases: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in cases])))


def changed_fields(df: DataFrame, fields: list[str], old: str, new: str) -> Column:
    """Names of the fields whose prefixed columns differ, null and null being equal."""
    return F.array_compact(F.array(*[F.when(~df[old + f].eqNullSafe(df[new + f]), F.lit(f)) for f in fields]))


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    """Half-up rounded and within bounds; null and NaN count as zero."""
    safe = F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))  # x is named once, as what it stands for may be long
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(safe + 0.5))).cast("long")


def rate(part: Column, whole: Column, empty: int = 100) -> Column:
    """Percentage, half-up; of nothing it is ``empty``."""
    return F.when(whole == 0, F.lit(empty)).otherwise(F.floor(part * 100.0 / whole + 0.5)).cast("long")


def confidence(score: Column) -> Column:
    return F.when(score >= 85, "high").when(score >= 70, "medium").otherwise("low")


def by_name(x: Column) -> Column:
    """A key that sorts names as people do: accents and case count last."""
    return F.collate(x, "UNICODE")


#: Keys of an object that come first where it is made a text: fixed values.
FIRST_KEYS = ("name", "title", "value", "label", "text", "summary", "location", "department", "team", "description", "descriptionPlain", "content", "html", "url")


def flat_text(x: Column) -> Column:
    """All texts and numbers in a JSON value, those of the keys that matter first, joined by spaces; other text as it is.

    Nesting has no bound, hence a vectorised UDF.
    """

    @F.arrow_udf("string")
    def flatten(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def walk(v) -> Iterator[str]:
            if isinstance(v, dict):
                for k in sorted(v, key=lambda k: FIRST_KEYS.index(k) if k in FIRST_KEYS else len(FIRST_KEYS)):
                    yield from walk(v[k])
            elif isinstance(v, list):
                for each in v:
                    yield from walk(each)
            elif isinstance(v, str):
                yield v
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                yield str(v)

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return " ".join(walk(json.loads(text)))
            except ValueError:
                return text

        for batch in batches:
            yield pa.array([one(t) for t in batch.to_pylist()], pa.string())

    return flatten(x)
