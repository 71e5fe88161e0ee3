"""Joins over one and over several keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievery.functions.text import identity_token
from sievery.operators import keys
from sievery.plans.registry import Registry, Tables

plan = Registry()
QUERIES, SQL = plan.queries, plan.sql

_TOKEN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@plan.query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def public_semi(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@plan.query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01')")
def missing_at_source(t: Tables) -> DataFrame:
    recent = t.orders.where(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(recent, "c_custkey", "left_anti")


_PART_KEYS = f"""[CASE WHEN p_partkey % 3 = 0 THEN 'id:' || CAST(p_partkey % 400 AS VARCHAR) END, CASE WHEN p_size > 10 THEN 'tb:' || {_TOKEN.format('p_name')} || ':' || p_brand END, 'pr:' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)]"""


def _part_keys(df: DataFrame) -> DataFrame:
    listed = keys.tagged(
        ("id", F.when(F.col("p_partkey") % 3 == 0, (F.col("p_partkey") % 400).cast("string"))),
        ("tb", F.when(F.col("p_size") > 10, F.concat_ws(":", identity_token(F.col("p_name")), "p_brand"))),
        ("pr", F.floor("p_retailprice").cast("string")),
    )
    return df.withColumn("keys", listed)


@plan.query(f"""
WITH k AS (SELECT p_partkey, p_type, unnest(list_filter({_PART_KEYS}, lambda x: x IS NOT NULL)) AS key FROM part)
SELECT a.p_partkey, array_to_string(list_sort(list(DISTINCT split_part(a.key, ':', 1))), ',') AS matched FROM k a WHERE a.p_type <> 'ECONOMY' AND a.key IN (SELECT key FROM k WHERE p_type = 'ECONOMY') GROUP BY a.p_partkey
""")
def overlap_methods(t: Tables) -> DataFrame:
    p = _part_keys(t.part)
    found = keys.any_key(p.where("p_type <> 'ECONOMY'"), p.where("p_type = 'ECONOMY'"), "p_partkey")
    return found.select("p_partkey", F.array_join("matched", ",").alias("matched"))


@plan.query(f"""
WITH k AS (SELECT p_partkey, p_type, unnest(list_filter({_PART_KEYS}, lambda x: x IS NOT NULL)) AS key FROM part)
SELECT p_partkey, p_name FROM part WHERE p_type <> 'ECONOMY' AND p_partkey NOT IN (SELECT a.p_partkey FROM k a JOIN k b USING (key) WHERE a.p_type <> 'ECONOMY' AND b.p_type = 'ECONOMY')
""")
def unmatched_by_any_key(t: Tables) -> DataFrame:
    p = _part_keys(t.part)
    return keys.matched(p.where("p_type <> 'ECONOMY'"), p.where("p_type = 'ECONOMY'"), "p_partkey", "left_anti").select("p_partkey", "p_name")


@plan.query(f"""
WITH k AS (SELECT p_partkey, p_type, unnest(list_filter({_PART_KEYS}, lambda x: x IS NOT NULL)) AS key FROM part), s AS (SELECT * FROM k WHERE split_part(key, ':', 1) <> 'tb')
SELECT a.p_partkey, min(b.p_partkey) AS archived, array_to_string(list_sort(list(DISTINCT split_part(a.key, ':', 1))), ',') AS matched
FROM s a JOIN s b ON a.key = b.key WHERE a.p_type <> 'LARGE' AND b.p_type = 'LARGE' GROUP BY a.p_partkey
""")
def archive_guard(t: Tables) -> DataFrame:
    p = _part_keys(t.part)
    archive = p.where("p_type = 'LARGE'").select(F.col("p_partkey").alias("archived"), "keys")
    found = keys.guard(p.where("p_type <> 'LARGE'"), archive, "p_partkey", "archived", weak=("tb",))
    return found.select("p_partkey", "archived", F.array_join("matched", ",").alias("matched"))


@plan.query("""
WITH c AS (SELECT s_suppkey, s_nationkey, floor(s_acctbal / 100) AS band FROM supplier),
m AS (SELECT s.s_suppkey, 0 AS p, c_custkey, 'id' AS method FROM c s JOIN customer ON c_custkey = s.s_suppkey * 50
      UNION ALL SELECT s.s_suppkey, 1, c_custkey, 'nation' FROM c s JOIN customer ON c_nationkey = s.s_nationkey AND floor(c_acctbal / 100) = s.band)
SELECT s_suppkey, c_custkey, method FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY p, c_custkey) AS n FROM m) WHERE n = 1
""")
def priority_key_lookup(t: Tables) -> DataFrame:
    band = lambda c: F.floor(F.col(c) / 100).cast("string")
    left = t.supplier.withColumn("keys", keys.tagged(("id", F.col("s_suppkey") * 50), ("nation", F.concat_ws("/", F.col("s_nationkey").cast("string"), band("s_acctbal")))))
    right = t.customer.withColumn("keys", keys.tagged(("id", F.col("c_custkey")), ("nation", F.concat_ws("/", F.col("c_nationkey").cast("string"), band("c_acctbal")))))
    return keys.first_by_priority(left, right, "s_suppkey", "c_custkey")


@plan.query("""
SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, CAST(abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) AS INTEGER) AS days
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 3
""")
def near_duplicate_band(t: Tables) -> DataFrame:
    return keys.near_pairs(t.orders, "o_orderkey", ["o_custkey"], "o_orderdate", 3)


@plan.query("""
WITH g AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER w, CAST(o_orderdate AS DATE)) <= 30 THEN 0 ELSE 1 END AS fresh FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS chain FROM g)
SELECT o_custkey, o_orderkey, chain, first_value(o_orderkey) OVER (PARTITION BY o_custkey, chain ORDER BY o_orderdate, o_orderkey) AS first_row FROM c
""")
def near_duplicate_chains(t: Tables) -> DataFrame:
    return keys.chains(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey", 30).select("o_custkey", "o_orderkey", "chain", "first_row")


@plan.query(f"""
WITH k AS (SELECT p_partkey, unnest(list_filter({_PART_KEYS}, lambda x: x IS NOT NULL)) AS key FROM part)
SELECT key, count(DISTINCT p_partkey) AS members, min(p_partkey) AS first FROM k GROUP BY key HAVING count(DISTINCT p_partkey) >= 2
""")
def canonical_identity_groups(t: Tables) -> DataFrame:
    return keys.groups_of_duplicates(_part_keys(t.part), "p_partkey")


@plan.query("""
SELECT o.o_orderkey, coalesce(c.c_name, n.n_name) AS source, CASE WHEN c.c_custkey IS NOT NULL THEN 'id' WHEN n.n_nationkey IS NOT NULL THEN 'nation' ELSE 'none' END AS method
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON o.o_custkey % 30 = n.n_nationkey
""")
def source_dimension_join(t: Tables) -> DataFrame:
    c = t.customer.where("c_acctbal > 0").select("c_custkey", "c_name")
    o = t.orders.join(c, t.orders["o_custkey"] == c["c_custkey"], "left").join(t.nation, F.col("o_custkey") % 30 == F.col("n_nationkey"), "left")
    method = F.when(F.col("c_custkey").isNotNull(), "id").when(F.col("n_nationkey").isNotNull(), "nation").otherwise("none")
    return o.select("o_orderkey", F.coalesce("c_name", "n_name").alias("source"), method.alias("method"))


@plan.query("""
WITH s AS (SELECT n_nationkey, lower(n_name) AS key FROM nation), c AS (SELECT c_nationkey % 20 AS k, count(*) AS n_customers FROM customer GROUP BY 1), p AS (SELECT s_nationkey + 5 AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1)
SELECT coalesce(s.n_nationkey, c.k, p.k) AS nation, s.key, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers,
    CASE WHEN s.key IS NULL THEN 'unknown' WHEN n_customers IS NULL AND n_suppliers IS NULL THEN 'unused' ELSE 'covered' END AS action
FROM s FULL JOIN c ON s.n_nationkey = c.k FULL JOIN p ON coalesce(s.n_nationkey, c.k) = p.k
""")
def source_coverage(t: Tables) -> DataFrame:
    s = t.nation.select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("key"))
    c = t.customer.groupBy((F.col("c_nationkey") % 20).alias("k")).agg(F.count(F.lit(1)).alias("n_customers"))
    p = t.supplier.groupBy((F.col("s_nationkey") + 5).alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    met = s.join(c, "k", "full_outer").join(p, "k", "full_outer")
    action = F.when(F.col("key").isNull(), "unknown").when(F.col("n_customers").isNull() & F.col("n_suppliers").isNull(), "unused").otherwise("covered")
    return met.select(F.col("k").alias("nation"), "key", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"), action.alias("action"))
