"""Incremental sync of sources into a table that is published by versions."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


class VersionedTable:
    """A Parquet table at a path, of which readers see the last published version.

    A version is written beside the others and then published by a file with the next number, which a file system creates once: of two
    writers one fails, and a writer that dies before leaves a folder that nobody reads. Each version names the batch it came from, so a
    batch that is run again is known. The last ``keep`` versions stay for readers that began with them.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def versions(self) -> list[dict]:
        """What is known of the versions that are kept, the current one last."""
        log = self._at("_versions")
        if not self._fs.exists(log):
            return []
        found = []
        for file in self._fs.listStatus(log):
            if file.getPath().getName().endswith(".json"):
                stream = self._fs.open(file.getPath())
                try:
                    found.append(json.loads(bytes(stream.readAllBytes())))
                finally:
                    stream.close()
        return sorted(found, key=lambda v: v["version"])

    def read(self) -> DataFrame | None:
        known = self.versions()
        return self.spark.read.parquet(f"{self.path}/{known[-1]['folder']}") if known else None

    def publish(self, df: DataFrame, batch: str) -> bool:
        """Make ``df``, which may read this table, the current version, unless ``batch`` has been published; whether it was."""
        known = self.versions()
        if any(batch in v["batches"] for v in known[-1:]):
            return False
        number = known[-1]["version"] + 1 if known else 0
        folder = f"{number:08}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{folder}")
        # Batches are remembered from version to version, one for each stream.
        stream = batch.rpartition("/")[0]
        batches = [b for b in (known[-1]["batches"] if known else []) if b.rpartition("/")[0] != stream] + [batch]
        self._create(f"_versions/{number:08}.json", json.dumps({"version": number, "folder": folder, "batches": batches}))
        for old in known[: max(0, len(known) + 1 - self.keep)]:
            self._fs.delete(self._at(f"_versions/{old['version']:08}.json"), False)
            self._fs.delete(self._at(old["folder"]), True)
        return True

    def _create(self, name: str, said: str) -> None:
        """A file that was not there, whole or not at all: written under another name, then renamed, which never replaces one."""
        made, target = self._at(f"{name}.{uuid.uuid4().hex[:8]}"), self._at(name)
        out = self._fs.create(made, False)
        out.write(bytearray(said.encode()))
        out.close()
        try:
            done = not self._fs.exists(target) and self._fs.rename(made, target)
        except Py4JJavaError:
            done = False
        if not done:
            self._fs.delete(made, False)
            raise OSError(f"{name} of {self.path} was published by another writer")


def synced(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The table after a batch of what sources brought: source, id, first_seen, last_seen and the batch's other columns.

    ``batch`` has source, id, at, ok and others. A source that succeeded has the rows that it brought now and no others, those that it had
    before with their first_seen; with a null id it says that it has none. A source of which any row is not ok has failed and keeps its rows,
    as do sources that the batch lacks. Of rows that repeat source and id, the last by ``at`` counts.
    """
    done = batch.groupBy("source").agg(F.min(F.coalesce("ok", F.lit(False))).alias("ok")).where("ok").select("source")
    others = [c for c in batch.columns if c not in ("source", "id", "at", "ok")]
    latest = batch.where(F.col("id").isNotNull()).join(done, "source", "left_semi").groupBy("source", "id").agg(F.max("at").alias("last_seen"), *[F.max_by(c, F.struct("at", F.xxhash64(*others))).alias(c) for c in others])
    if current is None:
        return latest.withColumn("first_seen", F.col("last_seen")).select("source", "id", "first_seen", "last_seen", *others)
    before = current.select("source", "id", F.col("first_seen").alias("_before"))
    fresh = latest.join(before, ["source", "id"], "left").withColumn("first_seen", F.coalesce("_before", "last_seen"))
    kept = current.join(done, "source", "left_anti")
    return kept.unionByName(fresh.select(*kept.columns))


def sync_stream(observations: DataFrame, table: VersionedTable, name: str) -> DataStreamWriter:
    """A writer that syncs a stream of ``observations`` into ``table``, a version for each micro-batch.

    A micro-batch that is run again after a failure finds its own version and does nothing, or publishes it for the first time. ``name``
    stands for the stream's checkpoint: a stream that starts anew, without its checkpoint, needs another one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table.publish(synced(table.read(), batch), f"{name}/{number}")

    return observations.writeStream.foreachBatch(merge)
