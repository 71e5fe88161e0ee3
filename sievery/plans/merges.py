"""Merges of state with observations, and drift between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievery.operators import audit, merge
from sievery.plans.registry import Registry, Tables

plan = Registry()
QUERIES, SQL = plan.queries, plan.sql

_SPLIT = "2024-01-16"


def _health(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("user_id").alias("source_id")).agg(
        F.count_if(F.col("event_type") == "error").alias("failures"),
        F.max(F.when(F.col("event_type") != "error", F.col("event_id"))).alias("last_success"),
        F.max("event_id").alias("last_checked"),
    )


_HEALTH = "SELECT user_id AS source_id, count(*) FILTER (event_type = 'error') AS failures, max(event_id) FILTER (event_type <> 'error') AS last_success, max(event_id) AS last_checked FROM events WHERE {} GROUP BY user_id"


@plan.query(f"""
WITH a AS ({_HEALTH.format("ts < TIMESTAMP '2024-01-16' AND user_id % 10 <> 0")}), b AS ({_HEALTH.format("ts >= TIMESTAMP '2024-01-29' AND user_id % 10 <> 1")})
SELECT coalesce(b.source_id, a.source_id) AS source_id,
    CAST(CASE WHEN b.source_id IS NULL THEN a.failures WHEN b.failures > 0 THEN coalesce(a.failures, 0) + b.failures ELSE 0 END AS BIGINT) AS failures,
    CASE WHEN coalesce(b.failures, 0) > 0 THEN coalesce(a.last_success, b.last_success) ELSE coalesce(b.last_success, a.last_success) END AS last_success,
    coalesce(b.last_checked, a.last_checked) AS last_checked
FROM a FULL JOIN b ON a.source_id = b.source_id
""")
def health_full_outer(t: Tables) -> DataFrame:
    ntz = lambda d: F.lit(d).cast("timestamp_ntz")
    old = t.events.where((F.col("ts") < ntz(_SPLIT)) & (F.col("user_id") % 10 != 0))
    new = t.events.where((F.col("ts") >= ntz("2024-01-29")) & (F.col("user_id") % 10 != 1))
    return merge.merge_health(_health(old), _health(new))


@plan.query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'X', o_totalprice + 1 FROM orders WHERE o_orderkey % 5 = 0")
def upsert_reports(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 5 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})
    return merge.upsert(o, new, "o_orderkey")


@plan.query("""
WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01')
SELECT id, 'a' AS only_in FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'b' FROM b WHERE id NOT IN (SELECT id FROM a)
""")
def count_audit(t: Tables) -> DataFrame:
    o = t.orders.withColumnRenamed("o_custkey", "id")
    ntz = lambda d: F.lit(d).cast("timestamp_ntz")
    return merge.symmetric_difference(o.where(F.col("o_orderdate") < ntz("1995-06-01")), o.where(F.col("o_orderdate") >= ntz("1998-06-01")), "id")


@plan.query("SELECT doc_id FROM documents WHERE NOT (n_chars > 300) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def explained_drop(t: Tables) -> DataFrame:
    return merge.unexplained_drops(t.documents, t.documents.where("n_chars > 300"), t.labels.where("quality = 0"), "doc_id")


@plan.query("""
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderpriority AS priority FROM orders WHERE o_orderkey % 17 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.status IS DISTINCT FROM b.status OR a.price IS DISTINCT FROM b.price OR a.priority IS DISTINCT FROM b.priority THEN 'changed' ELSE 'same' END AS status,
    CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END, CASE WHEN a.price IS DISTINCT FROM b.price THEN 'price' END, CASE WHEN a.priority IS DISTINCT FROM b.priority THEN 'priority' END], lambda x: x IS NOT NULL), ',') END AS changed
FROM a FULL JOIN b ON a.k = b.k
""")
def snapshot_drift(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    new = o.where("k % 17 <> 0").withColumns({"status": F.when(F.col("k") % 7 == 0, "Z").otherwise(F.col("status")), "price": F.when(F.col("k") % 13 != 0, F.col("price"))})
    found = merge.compare_snapshots(o.where("k % 11 <> 0"), new, "k", ["status", "price", "priority"])
    return found.select("k", "status", F.array_join("changed", ",").alias("changed"))


@plan.query("""
SELECT a.o_orderkey, CASE WHEN b.k IS NOT NULL AND b.price < a.o_totalprice / 2 THEN a.o_totalprice ELSE coalesce(b.price, a.o_totalprice) END AS price,
    CASE WHEN b.status IS NOT NULL AND trim(b.status) <> '' THEN b.status ELSE a.o_orderstatus END AS status,
    CASE WHEN b.k IS NOT NULL AND b.price < a.o_totalprice / 2 THEN 'price' ELSE '' END AS kept
FROM orders a LEFT JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 10 ELSE o_totalprice * 2 END AS price, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'N' END AS status FROM orders WHERE o_orderkey % 2 = 0) b ON a.o_orderkey = b.k
""")
def safe_merge(t: Tables) -> DataFrame:
    current = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    proposed = current.where("o_orderkey % 2 = 0").withColumns({"price": F.when(F.col("o_orderkey") % 4 == 0, F.col("price") / 10).otherwise(F.col("price") * 2), "status": F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise("N")})
    merged = merge.safe_merge(current, proposed, "o_orderkey", ["price", "status"], {"price": F.col("new_price") < F.col("old_price") / 2})
    return merged.withColumn("kept", F.array_join("kept", ","))


@plan.query("""
WITH a AS (SELECT p_partkey, p_name AS name, p_brand AS brand, p_partkey % 20 AS edited FROM part WHERE p_partkey % 6 <> 0),
b AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE upper(p_name) END AS name, p_brand AS brand, 10 AS seen FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey,
    CASE WHEN NOT coalesce(a.edited >= b.seen, false) AND b.name <> '' THEN b.name ELSE a.name END AS name,
    CASE WHEN coalesce(b.brand, '') <> '' THEN b.brand ELSE a.brand END AS brand,
    CASE WHEN coalesce(a.edited >= b.seen, false) THEN 'manual' WHEN b.name <> '' THEN 'source' WHEN a.name IS NOT NULL THEN 'previous' ELSE 'none' END AS name_origin,
    CASE WHEN coalesce(a.edited >= b.seen, false) AND b.name IS DISTINCT FROM a.name THEN 'name' ELSE '' END AS conflicts
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey
""")
def provenance_merge(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    existing = p.where("p_partkey % 6 <> 0").withColumn("manual", F.create_map(F.lit("name"), F.col("p_partkey") % 20))
    incoming = p.where("p_partkey % 5 <> 0").withColumns({"name": F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.upper("name")), "seen_at": F.lit(10).cast("long")})
    merged = merge.provenance_merge(existing, incoming, "p_partkey", ["name", "brand"])
    return merged.select("p_partkey", "name", "brand", F.element_at("origin", "name").alias("name_origin"), F.array_join("conflicts", ",").alias("conflicts"))


@plan.query("""
WITH m AS (SELECT event_type AS metric, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS "before", count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS "after" FROM events GROUP BY event_type)
SELECT metric, "before", "after", ("after" - "before") * 1.0 / "before" AS change, abs(("after" - "before") * 1.0 / "before") > 0.02 AS alert FROM m
""")
def metric_drift(t: Tables) -> DataFrame:
    early = F.col("ts") < F.lit(_SPLIT).cast("timestamp_ntz")
    counts = lambda df: df.groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return audit.drift(counts(t.events.where(early)), counts(t.events.where(~early)), 0.02)


@plan.query("""
SELECT o_orderkey, src FROM (
    SELECT o_orderkey, src, row_number() OVER (PARTITION BY o_orderkey ORDER BY turn) AS n FROM (
        SELECT o_orderkey, 'a' AS src, 1 AS turn FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'b', 2 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'c', 3 FROM orders WHERE o_orderkey % 5 = 0))
WHERE n = 1
""")
def union_first_wins(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey")
    lists = [o.where(f"o_orderkey % {m} = 0").withColumns({"src": F.lit(s), "turn": F.lit(i)}) for i, (m, s) in enumerate(((2, "a"), (3, "b"), (5, "c")))]
    every = lists[0].unionByName(lists[1]).unionByName(lists[2])
    return every.groupBy("o_orderkey").agg(F.min_by("src", "turn").alias("src"))
