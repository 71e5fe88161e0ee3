"""Tables of JSON records, read leniently and written with care."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


class RefusedWrite(ValueError):
    """A write that would lose rows without a reason."""


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of JSON arrays or lines with a schema; a path that does not exist is an empty table."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def sanitized(df: DataFrame, blocked: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Without rows of blocked sources; texts that are no more than a stringified object are blank."""
    if blocked is not None and key is not None:
        df = df.join(F.broadcast(blocked.select(key)) if blocked.limit(100_001).count() <= 100_000 else blocked.select(key), key, "left_anti")
    blank = lambda c: F.when(F.col(c).contains("[object Object]"), "").otherwise(F.col(c)).alias(c)
    return df.select(*[blank(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def content_hash(df: DataFrame) -> str:
    """A hash of the rows, whatever their order; repeated rows count."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    sums = [F.sum(F.pmod(F.xxhash64(row, F.lit(i)), F.lit(1 << 31))) for i in range(3)]
    return ":".join(str(x) for x in df.agg(F.count(F.lit(1)), *sums).first())


def _renamed(fs, source, target) -> bool:
    """Whether the file system has renamed a folder; some raise where others say no."""
    try:
        return bool(fs.rename(source, target))
    except Py4JJavaError:
        return False


def replace_table(df: DataFrame, path: str, form: str) -> None:
    """Write beside the path, then swap: ``df`` may read the path, and a job that fails midway leaves the old table in place.

    If the new table cannot take the old one's place, the old one goes back to its path and the error is raised; the old table is deleted
    last, when the new one is there.
    """
    spark, new, old = df.sparkSession, f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    df.write.format(form).save(new)
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = fs.exists(to_path(path))
    if before and not _renamed(fs, to_path(path), to_path(old)):
        fs.delete(to_path(new), True)
        raise OSError(f"{path} could not be moved aside and stays as it was")
    if not _renamed(fs, to_path(new), to_path(path)):
        if before and not _renamed(fs, to_path(old), to_path(path)):
            raise OSError(f"{new} could not take the place of {path}, whose old table is at {old}")
        fs.delete(to_path(new), True)
        raise OSError(f"{path} could not be replaced and stays as it was")
    if before:
        fs.delete(to_path(old), True)


def write_if_changed(df: DataFrame, path: str, schema: StructType) -> bool:
    """Write JSON unless the rows at the path are these already."""
    before = read_json(df.sparkSession, path, schema)
    if content_hash(before) == content_hash(df.select(*before.columns)) and not before.isEmpty():
        return False
    replace_table(df, path, "json")
    return True


def guarded_overwrite(df: DataFrame, current: DataFrame, path: str, key: str, explained: DataFrame | None = None, most: float = 0.2, allow_empty: bool = False) -> None:
    """Write Parquet, but refuse to empty a table, or to drop more than a share of it without each being explained."""
    before, after = current.count(), df.count()
    if before and not after and not allow_empty:
        raise RefusedWrite("the table has rows and would have none")
    if before and after < before * (1 - most):
        from sievery.operators.merge import unexplained_drops

        known = explained if explained is not None else current.limit(0)
        lost = unexplained_drops(current, df, known, key).count()
        if lost:
            raise RefusedWrite(f"{lost} rows would go without being explained")
    replace_table(df, path, "parquet")


def bytes_by_source(df: DataFrame, source: str) -> DataFrame:
    """Serialised size by source, the largest first."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).orderBy(F.desc("bytes"), source)


def write_limited(df: DataFrame, path: str, source: str, most: int) -> None:
    """Write JSON unless it would be larger than ``most`` bytes; then say which sources are the largest."""
    sizes = bytes_by_source(df, source)
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    if total > most:
        worst = ", ".join(f"{r[source]} {r['bytes']}" for r in sizes.limit(5).collect())
        raise RefusedWrite(f"{total} bytes of at most {most}; largest: {worst}")
    replace_table(df, path, "json")


def page_manifest(pages: DataFrame, previous: DataFrame, key: str, inputs: list[Column]) -> DataFrame:
    """What to do with each page: write, skip (same inputs) or delete; with the hash of its inputs."""
    now = pages.select(key, F.substring(F.sha2(F.to_json(F.struct(*inputs)), 256), 1, 12).alias("hash"))
    met = now.join(previous.select(key, F.col("hash").alias("_old")), key, "full_outer")
    action = F.when(F.col("hash").isNull(), "delete").when(F.col("hash").eqNullSafe(F.col("_old")), "skip").otherwise("write")
    return met.select(key, F.coalesce("hash", "_old").alias("hash"), action.alias("action"))
