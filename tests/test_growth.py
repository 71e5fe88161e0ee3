"""Steps whose rows must not grow with the square of what shares a key: the most rows that a step of the plan makes."""

import os
import time

from pyspark.sql import functions as F

from sievery.functions import article, description, quality, values
from sievery.operators import components, keys, rules
from sievery.plans import curation, validation
from sievery.plans.registry import Tables
from sievery.storage import Workspace


def most_rows(df):
    """Rows of ``df``, and the most that one of its joins makes."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        rows, todo, most = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            made = node.metrics().get("numOutputRows")
            if "Join" in node.nodeName() and made.isDefined():
                most = max(most, made.get().value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return rows, most
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def shared(spark, n, name, first=0):
    """``n`` rows with one key in common and one of their own."""
    return spark.range(first, first + n).select(F.col("id").alias(name), F.array(F.lit("pr:1"), F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("keys"))


def test_guard_makes_no_pairs_of_a_shared_key(spark):
    found, most = most_rows(keys.guard(shared(spark, 300, "row"), shared(spark, 200, "old", 100), "row", "old"))
    assert {r.row: (r.old, r.matched) for r in found} == {i: (100, ["id", "pr"] if i >= 100 else ["pr"]) for i in range(300)}
    assert most <= 600


def test_lookup_makes_no_pairs_of_a_shared_key(spark):
    found, most = most_rows(keys.first_by_priority(shared(spark, 300, "row"), shared(spark, 200, "other", 100), "row", "other"))
    assert {r.row: (r.other, r.method) for r in found} == {i: (100, "pr") for i in range(300)}
    assert most <= 600


def test_rules_with_one_term_are_counted_without_pairs(spark):
    texts = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "Blue Ring").otherwise("hot bolt").alias("text"))
    texts = texts.unionByName(spark.createDataFrame([(500, None), (501, "green"), (502, "ring"), (502, "bolt")], "id long, text string"))
    many = spark.range(1000, 1300).select(F.col("id").alias("rule"), F.lit("RING").alias("term"))
    few = spark.createDataFrame([(1000, "blue"), (7, "bolt"), (7, "hot"), (8, ""), (9, None), (None, "ring"), (6, "b")], "rule long, term string")
    known = many.unionByName(few)
    found, most = most_rows(rules.counted(texts, "id", F.col("text"), known, Workspace(spark)))
    pairs = rules.contains_any(texts, "id", F.col("text"), known.where("rule IS NOT NULL"), Workspace(spark)).groupBy("id").agg(F.count("rule").alias("rules"), F.min("rule").alias("first"))
    assert sorted(map(tuple, found)) == sorted(map(tuple, pairs.collect()))
    assert {r.id: (r.rules, r.first) for r in found if r.id in (0, 1, 502)} == {0: (301, 6), 1: (2, 6), 502: (302, 6)}
    assert most <= 1000
    assert rules.counted(texts, "id", F.col("text"), known.limit(0), Workspace(spark)).count() == 0


def test_readiness_names_each_field_once():
    """What a field stands for is evaluated wherever it is named, and a field may stand for much."""
    for score in (quality.readiness, quality.parser_confidence, quality.content_quality):
        said = str(score(quality.Fields({x: F.col(f"given_{x}") for x in quality.SCORED})))
        assert all(said.count(f"given_{x} ") + said.count(f"given_{x},") + said.count(f"given_{x})") <= 1 for x in quality.SCORED)
        assert "given_description" in said


def test_clamp_names_its_value_once(spark):
    assert str(values.clamp(F.col("given"))).count("given") == 1
    rows = spark.sql("SELECT explode(array(null, double('NaN'), -1D, 2.5D, 100.4D, 1e300D)) AS x").select(values.clamp(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [0, 0, 0, 3, 100, 100]


def test_postings_are_spread_over_all_cores(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert curation._postings(t)._jdf.rdd().getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_rows_that_share_no_key_take_no_part_in_rounds(spark):
    """Lone rows were written in each round, with keys as long texts."""
    work = Workspace(spark)
    alone = spark.range(20_000).select(F.col("id").alias("row"), F.concat(F.lit("a key of some length "), F.md5(F.col("id").cast("string").cast("binary"))).alias("key"))
    few = spark.createDataFrame([(5, "x"), (7, "x"), (7, "y"), (9, "y"), (9, "y"), (None, "x"), (11, None)], "row long, key string")
    found = {r.row: r.component for r in components.components(alone.unionByName(few), work).collect()}
    assert found == {i: 5 if i in (7, 9) else i for i in range(20_000)}
    assert sum(os.path.getsize(os.path.join(folder, f)) for folder, _, files in os.walk(work.path.removeprefix("file://")) for f in files) < 200_000


def test_drift_reads_texts_once(spark):
    """Two reports of the same findings looked at every text twice."""
    plan = validation.validation_drift(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and "text#" not in plan


def test_last_sentence_of_a_long_text_without_end(spark):
    texts = ["One. Two! Three?! rest", "...", "... a. ", "", "no end", "a\nb. c\nd.. e", "ä😀. 😀ö!", "a" * 400_000, "One. " + "b " * 200_000]
    told = [" Three?!", None, " a.", None, None, " c\nd..", " 😀ö!", None, "One."]
    start = time.monotonic()
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, x string").select("id", article.last_sentence(F.col("x")).alias("last")).collect()
    assert [r["last"] for r in sorted(rows)] == [(t if t is not None else x).strip(" ") for t, x in zip(told, texts, strict=True)]
    assert time.monotonic() - start < 20


def test_role_section_of_many_paragraphs(spark):
    assert [description.literals(p) for p in (r"(?i)reports?\s+to", r"(?i)DEI\b|equal\s+way", r"(?i)(?:view|see)\s+all\b", r"(?i)(?:a\d|b)\s", r"(?i)e-?verify\b", "x")] == [("report",), ("dei", "equal"), ("view", "see"), (), ("verify",), ()]
    found = ["short", "What a role of Thirty letters in it, or so", "BENEFITS", "KEY RESPONSIBILITIES\nall", "x", "See All Jobs", "Summary", *["Data"] * 100_000]
    start = time.monotonic()
    rows = spark.createDataFrame([(found,), ([],), (None,)], "found array<string>").select(description.role_section(F.col("found")).alias("s")).select("s.*").collect()
    kept = [found[1], found[3], "x", "Summary", *["Data"] * 100_000]
    assert [tuple(r) for r in rows] == [("\n\n".join(kept), "KEY RESPONSIBILITIES"), ("", ""), (None, None)]
    assert time.monotonic() - start < 20
