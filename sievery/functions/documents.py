"""JSON documents of any shape as rows, level by level, with Spark's VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievery.storage import Workspace

# The fields that stand for an object where a text is wanted, by priority.
TEXT_KEYS = ("name", "title", "value", "label", "text", "summary", "location", "department", "team", "description", "descriptionPlain", "content", "html", "url")


def nodes(df: DataFrame, row: str, json: str, work: Workspace) -> list[DataFrame]:
    """The values of JSON documents, a frame for each level: row, path, key, kind and text.

    ``path`` is the places from the root down, each of eight digits, so that it sorts as the document goes; ``key`` is the name in an object, else
    null. ``kind`` is object, array, string, number, boolean or null, and ``text`` what a scalar says. Documents that are null or no JSON have no
    rows. Fields of an object stand in the order of their names, as VARIANT keeps them. Each level is one pass over the values of the one above.
    """
    session = df.sparkSession
    level = df.select(F.col(row).alias("row"), F.lit("").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json(json).alias("value")).where(F.col("value").isNotNull())
    found = []
    while True:
        shape = F.schema_of_variant("value")
        kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").otherwise("number")
        level = work.table(level.withColumns({"kind": kind, "text": F.when(kind.isin("string", "number", "boolean"), F.try_variant_get("value", "$", "string"))}), f"level-{len(found)}")
        found.append(level.drop("value"))
        inner = level.where(F.col("kind").isin("object", "array"))
        if inner.isEmpty():
            return found
        each = inner.select("row", "path", "value").lateralJoin(session.tvf.variant_explode(F.col("value").outer()).toDF("at", "name", "item"))
        level = each.select("row", F.concat("path", F.lpad(F.col("at").cast("string"), 8, "0")).alias("path"), F.col("name").alias("key"), F.col("item").alias("value")).where(F.col("value").isNotNull())


def safe_text(df: DataFrame, row: str, json: str, work: Workspace) -> DataFrame:
    """``row`` and ``text`` of JSON documents: what a value says, for an object its first field by ``TEXT_KEYS`` that says something, for an array all that do.

    Texts that a careless writer has left of objects say nothing. Documents that are null or no JSON have no row, and those that say nothing an
    empty text. The levels are folded from the deepest up; what is gathered at a time is one array or object of one document.
    """
    levels = nodes(df, row, json, work)
    said = None
    for level in reversed(levels):
        own = F.when(F.contains("text", F.lit("[object Object]")), "").otherwise(F.coalesce("text", F.lit("")))
        if said is None:
            told = level.select("row", "path", "key", own.alias("said"))
        else:
            turn = F.array_position(F.array(*map(F.lit, TEXT_KEYS)), F.col("key"))
            up = said.where("said <> ''").groupBy("row", F.expr("left(path, length(path) - 8)").alias("path")).agg(
                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "said"))), lambda x: x["said"]), ", ").alias("all"),
                F.min_by("said", F.when(turn > 0, turn)).alias("first"),
            )
            met = level.join(up, ["row", "path"], "left")
            told = met.select("row", "path", "key", F.when(F.col("kind") == "array", F.coalesce("all", F.lit(""))).when(F.col("kind") == "object", F.coalesce("first", F.lit(""))).otherwise(own).alias("said"))
        said = work.table(told, "said")
    return said.select(F.col("row").alias(row), F.col("said").alias("text"))
