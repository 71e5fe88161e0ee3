"""A corpus from raw documents to token files, a stage at a time.

Each stage takes all that its predecessor kept. Its result has to be written before the next stage starts, as ``run``
does: tables that a stage needed on the way are deleted then.

For all stages: an empty table stays empty; further columns are kept, whatever their names; texts of any length are read
whole; null ids and sources are values like others, and rows that repeat an id are judged by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievery.llm import decontamination, jaccard, language, mixing, tokens
from sievery.llm.words import small_batches
from sievery.storage import Workspace, broadcast_if_small

#: Ids that a broadcast table may hold (16 bytes each).
IDS_BROADCAST = 1_000_000

_last: list[Workspace] = []


def _workspace(spark: SparkSession) -> Workspace:
    """A new workspace; the last stage's, whose result is written by now, is deleted."""
    while _last:
        _last.pop().release()
    _last.append(Workspace(spark))
    return _last[-1]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the languages learned from the labelled documents, which also set the least score.

    Null and empty texts, and those without letters, are in none and go. Without labelled documents, none is kept.
    """
    work = _workspace(spark)
    with small_batches(spark):
        profiles = language.learn(docs)
        told = work.table(docs.select(F.struct("*").alias("row"), "lang", language.predicted(spark, F.col("text"), profiles).alias("told")), "told")
    least = language.least_score(told.select("lang", "told.scores"), sorted(profiles))
    return told.where((F.col("told.lang") != language.UNKNOWN) & (F.col("told.score") >= least)).select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first row of each component of near copies, by id, rows without id last, and every row without words.

    Rows are told apart by a number of their own, so repeated and missing ids decide nothing but the order.
    """
    work = _workspace(spark)
    rows = work.table(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "rows")
    with small_batches(spark):
        found = jaccard.components(rows.select(F.col("number").alias("doc_id"), "row.text"), work).where("n_shingles > 0")
    order = rows.select("number", F.struct(F.col("row.doc_id").isNull().alias("none"), "row.doc_id", F.xxhash64("row").alias("hash"), "number").alias("place"))
    found = work.table(found.select(F.col("doc_id").alias("number"), "component_id"), "components")
    # Only components of several rows have copies.
    several = found.where("number <> component_id")
    several = several.unionByName(several.select(F.col("component_id").alias("number"), "component_id").distinct())
    placed = work.table(several.join(order, "number"), "placed")
    first = work.table(placed.groupBy("component_id").agg(F.min("place").alias("first")), "first")
    copies = work.table(placed.join(broadcast_if_small(first, IDS_BROADCAST), "component_id").where(F.col("number") != F.col("first.number")).select("number"), "copies")
    return rows.join(broadcast_if_small(copies, IDS_BROADCAST), "number", "left_anti").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain an item of the benchmark. Null and empty texts contain none; an empty benchmark drops nothing."""
    work = _workspace(spark)
    rows = docs.select(F.struct("*").alias("row"), "text")
    found = decontamination.search(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    with small_batches(spark):
        return work.table(found.where(F.size("items") == 0).select("row.*"), "kept")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times. Texts without words are never taken."""
    work = _workspace(spark)
    plan = work.table(mixing.mix(mixing.document_sizes(docs, work), work), "plan").select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("source").alias("_source"), "copies")
    sized = docs.select(F.struct("*").alias("row"), "doc_id", "source", mixing.word_count(F.col("text")).alias("n"))
    key = ["_id", "_size", "_source"]
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("n") == F.col("_size")) & F.col("source").eqNullSafe(F.col("_source"))
    if not plan.groupBy(*key).count().where("count > 1").isEmpty():
        # Rows that share id, size and source are the same to the mix; a turn tells them apart.
        plan = plan.withColumn("_turn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("copies"))))
        sized = sized.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "n", "source").orderBy("row.text")))
        same = same & (F.col("place") == F.col("_turn"))
    met = sized.join(broadcast_if_small(plan.where("copies > 0"), IDS_BROADCAST), same)
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents; a row for each with its place in the stream, read from the files. A null or empty text has the end id alone."""
    import public_tokenizers

    folder = _workspace(spark).folder("tokens")
    with small_batches(spark):
        files = tokens.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), keep=False)
    return tokens.read(spark, files)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: Language profiles, the pivotal rounding and the tokenizer have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark)
    for name, stage in STAGES:
        docs = kept.table(stage(spark, docs, sf_dir), name)
    return docs

