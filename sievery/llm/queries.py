"""The queries ``opN_<name>`` over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievery.llm import collocations, merkle, topk
from sievery.storage import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievery.llm import mixing

    work = Workspace(spark)
    return mixing.mix(mixing.document_sizes(_table(spark, sf_dir, "documents"), work), work)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievery.llm import licenses

    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievery.llm import jaccard

    return jaccard.components(_table(spark, sf_dir, "documents"), Workspace(spark))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievery.llm import language

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id")))
    profiles = language.learn(docs.where(~F.col("held_out")))
    told = docs.select("doc_id", "held_out", language.predicted(spark, F.col("text"), profiles).alias("p"))
    return told.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievery.llm import sharding

    placed = sharding.shard(_table(spark, sf_dir, "documents"), Workspace(spark))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sievery.llm import tokens

    folder = Workspace(spark).folder("tokens")
    return tokens.read(spark, tokens.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json")))


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievery.llm import ppm

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return ppm.score(_table(spark, sf_dir, "documents").withColumn("held_out", held_out), Workspace(spark))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievery.llm import decontamination

    found = decontamination.search(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), "containment", (F.size("items") > 0).alias("contaminated"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievery.llm import secrets

    found = secrets.scan(_table(spark, sf_dir, "documents"), Workspace(spark))
    base = F.filter("spans", lambda s: s["strong"])
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.verified(_table(spark, sf_dir, "documents"), Workspace(spark), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), Workspace(spark))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievery.llm import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", toxicity.held_out(F.col("doc_id")).alias("held_out"))
    model = toxicity.learn(docs.where(~F.col("held_out")), _table(spark, sf_dir, "labels"), Workspace(spark))
    spans = F.transform("blamed", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"), F.array_join(spans, ",").alias("blamed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_search": op1_search,
    "op2_mix": op2_mix,
    "op3_licenses": op3_licenses,
    "op4_jaccard": op4_jaccard,
    "op5_language": op5_language,
    "op6_shard": op6_shard,
    "op7_tokens": op7_tokens,
    "op8_ppm": op8_ppm,
    "op9_decontaminate": op9_decontaminate,
    "op10_secrets": op10_secrets,
    "op11_merkle": op11_merkle,
    "op12_collocations": op12_collocations,
    "op13_toxicity": op13_toxicity,
}
SQL: dict[str, str] = {"op1_search": topk.SQL, "op11_merkle": merkle.SQL, "op12_collocations": collocations.SQL}
