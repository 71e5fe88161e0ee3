"""Streaming twins of the batch windows: state by key, kept from one micro-batch to the next."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_decisions(events: DataFrame, precedence: dict[str, int], path: str) -> object:
    """A writer that keeps the latest decision of each user at ``path``: later time, then precedence, then id."""
    rank = F.create_map(*[F.lit(x) for pair in precedence.items() for x in pair])

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("user_id", F.struct("ts", F.coalesce(rank[F.col("event_type")], F.lit(1)).alias("rank"), "event_id", "event_type").alias("d"))
        if number:
            old = spark.read.parquet(f"{path}/{number - 1}").select("user_id", F.struct("ts", "rank", "event_id", "event_type").alias("d"))
            fresh = fresh.unionByName(old)
        fresh.groupBy("user_id").agg(F.max("d").alias("d")).select("user_id", "d.*").write.mode("overwrite").parquet(f"{path}/{number}")

    return events.writeStream.foreachBatch(merge).outputMode("update")


def failure_streaks(events: DataFrame, failure: str) -> DataFrame:
    """Failures of each user since the last success, a row for each user and micro-batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            streak = streak + 1 if kind == failure else 0
        state.update((streak,))
        yield pd.DataFrame({"user_id": [key[0]], "streak": [streak]})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, streak long", "streak long", "update", GroupStateTimeout.NoTimeout)
