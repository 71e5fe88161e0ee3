"""Intermediate tables in the folder that all executors share.

A table that several later steps read is written once, as Parquet, below ``spark.checkpoint.dir``: lineage is cut, a
lost executor costs a re-read and not a recomputation, and the optimizer knows the size of what it joins.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType

#: Bytes of text and nested values that a broadcast table may hold.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and Spark runs on this machine alone (tests), a temporary folder.

    On a cluster the executors would not see each other's temporary folders, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master or 'the cluster'} share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """Tables of one computation; ``release`` deletes them, after which frames that read them are void."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/sievery-{uuid.uuid4().hex}"

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written and read back."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and at most ``size`` bytes of text and nested values.

    To tell takes a pass over ``df``. Beyond either bound it is returned as it is, to be shuffled.
    """
    held = F.lit(0).cast("long")
    for field in df.schema.fields:
        if not isinstance(field.dataType, (NumericType, BooleanType, DatetimeType)):
            held = held + F.coalesce(F.octet_length(F.col(f"`{field.name}`").cast("string")), F.lit(0))
    found = df.select(held.alias("held")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("held").alias("held")).first()
    return F.broadcast(df) if found.n <= rows and (found.held or 0) <= size else df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by some of its columns over several tasks for each core.

    For rows that are thin but dear: a file with a million of them may be read by one task, which others cannot help.
    """
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
