"""Secret scans with multipart credential linking.

Strong patterns (assignments, access keys, long hex) are reported wherever they match. Weak candidates (identifiers,
random-looking strings, endpoints) are common in clean text, so they are reported only where complementary parts of one
credential lie in the same scope: an interval join over the candidates of a document, cell by cell, as a semi-join.

Everything is DataFrame functions. Positions come from the pieces between matches: ``split`` and ``regexp_extract_all``
see the same leftmost matches, and a running sum over the lengths of both gives each match its place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievery.storage import Workspace

#: Code points between the parts of one credential.
SCOPE = 400


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Group whose length has to be at least ``least`` for the match to count.
    group: int = 0
    least: int = 0
    strong: bool = False
    #: Part of a credential that it can be.
    part: str = ""
    #: Patterns that a match has to contain to count.
    holds: tuple[str, ...] = ()


KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, "secret"),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, True, "identifier"),
    # A maximal run is found whole or not at all, so the least length can be part of the pattern.
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, True, "secret"),
    Kind("identifier", r"""(?i)\b(?:access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", 1, 3, False, "identifier"),
    Kind("key", r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])", 0, 32, False, "secret", ("[0-9]", "[A-Z]", "[a-z]")),
    Kind("endpoint", r"""(?i)\b(?:https?|s3|redis|amqp|mysql|mongodb|postgres(?:ql)?|jdbc:[a-z]{2,})://[^\s"'<>]{3,}""", 0, 6, False, "endpoint"),
)
#: Parts that have to be in scope of a weak candidate, by the part that it is itself.
NEEDS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}
_MATCHES = "array<struct<gap:int,len:int,ok:boolean>>"


def _matches(text: Column, kind: Kind) -> Column:
    """Of each match: code points since the last one, its length, and whether it counts."""
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    lengths, held = F.transform(whole, F.length), F.transform(whole, lambda m: reduce(lambda a, p: a & m.rlike(p), kind.holds, F.lit(True)))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)), F.length)
    zipped = F.transform(F.arrays_zip(gaps.alias("gap"), lengths.alias("len"), sizes.alias("size"), held.alias("held")), lambda m: F.struct(m["gap"].alias("gap"), m["len"].alias("len"), ((m["size"] >= kind.least) & m["held"]).alias("ok")))
    return F.when(text.rlike(kind.pattern), F.filter(zipped, lambda m: m["len"].isNotNull())).otherwise(F.array().cast(_MATCHES))


def _reach(start: Column, end: Column) -> Column:
    """Cells of the scopes that code points ``start`` to ``end`` touch."""
    return F.sequence(F.floor(F.greatest(start, F.lit(0)) / SCOPE), F.floor(F.greatest(end - 1, F.lit(0)) / SCOPE))


def _linked(spans: DataFrame) -> DataFrame:
    """Weak candidates whose complementary parts are in scope."""
    parts = spans.select(F.col("row").alias("r"), F.col("part").alias("p"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(_reach(F.col("start"), F.col("end"))).alias("c"))
    weak = spans.where(~F.col("strong"))
    cells = weak.withColumn("cell", F.explode(_reach(F.col("start"), F.col("end"))))
    base = spans.where("strong").select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(_reach(F.col("start"), F.col("end"))).alias("c"))
    within = cells.join(base, (F.col("row") == F.col("r")) & (F.col("cell") == F.col("c")) & (F.col("start") < F.col("e")) & (F.col("end") > F.col("s")), "left_semi")
    free = weak.join(within.select("row", "kind", "start").distinct(), ["row", "kind", "start"], "left_anti")
    linked = []
    for part, needs in NEEDS.items():
        found = free.where(F.col("part") == part)
        for need in needs:
            near = found.withColumn("cell", F.explode(_reach(F.col("start") - SCOPE, F.col("end") + SCOPE)))
            close = (F.col("s") <= F.col("end") + SCOPE) & (F.col("e") >= F.col("start") - SCOPE) & ((F.col("s") >= F.col("end")) | (F.col("e") <= F.col("start")))
            hit = near.join(parts.where(F.col("p") == need), (F.col("row") == F.col("r")) & (F.col("cell") == F.col("c")) & close, "left_semi")
            found = hit.drop("cell").distinct()
        linked.append(found)
    return linked[0].unionByName(linked[1]).unionByName(linked[2])


def scan(docs: DataFrame, work: Workspace) -> DataFrame:
    """Spans of each row of ``docs`` (doc_id, text): doc_id and spans, an array of (start, order, kind, end, strong).

    Places are code points of the whole text, ends exclusive; ``order`` is that of ``KINDS``. Weak candidates that
    overlap a strong span are part of it. Null and empty texts have no spans; each row is scanned for itself, also
    where doc_id is null or repeated.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *[_matches(text, k).alias(k.name) for k in KINDS])
    found = work.table(found, "matches")
    listed = None
    for order, k in enumerate(KINDS):
        one = found.select("row", F.lit(order).alias("order"), F.lit(k.name).alias("kind"), F.lit(k.part).alias("part"), F.lit(k.strong).alias("strong"), F.posexplode(k.name).alias("at", "m"))
        listed = one if listed is None else listed.unionByName(one)
    so_far = Window.partitionBy("row", "order").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(so_far)
    spans = listed.withColumn("end", end).where("m.ok").withColumn("start", F.col("end") - F.col("m.len")).drop("m", "at")
    spans = work.table(spans, "spans")
    kept = spans.where("strong").unionByName(_linked(spans))
    by_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "order", "kind", "end", "strong"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint,strong:boolean>>")
    return found.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
