"""The grace period of absent records as a stream: the twin of ``state.replay_missing``, with state by key, timers and expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sievery.operators.state import CONFIRMATIONS, GRACE_DAYS

#: State store that the processor's state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = 86_400_000_000
OUTPUT = "row long, confirmations long, status string"


class Grace(StatefulProcessor):
    """Observations wait in state until the watermark has passed them, and are then told in order of time and row.

    So what arrives late, but within the watermark, is told as a batch would tell it. A record's state goes when it has not changed for
    ``keep`` milliseconds of processing time, where that is given.
    """

    def __init__(self, required: int = CONFIRMATIONS, grace_days: int = GRACE_DAYS, keep: int | None = None):
        self.required, self.grace, self.keep = required, grace_days * _DAY, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, row long, missing boolean", self.keep)
        self.absent = handle.getValueState("absent", "confirmations long, since long", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timers = set(self.handle.listTimers())
        for some in rows:
            for micros, row, missing in zip(some["micros"].tolist(), some["row"].tolist(), some["missing"].tolist(), strict=True):
                self.waiting.appendValue((micros, row, missing))
                # A timer counts as passed when the watermark, in whole milliseconds, is not before it.
                if (at := -(-micros // 1000)) not in timers:
                    timers.add(at)
                    self.handle.registerTimer(at)
        yield pd.DataFrame({"row": pd.Series([], dtype="int64"), "confirmations": pd.Series([], dtype="int64"), "status": pd.Series([], dtype="str")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        every = sorted((micros, row, missing) for micros, row, missing in self.waiting.get())
        due = [x for x in every if x[0] <= passed]
        if due:
            confirmations, since = self.absent.get() if self.absent.exists() else (0, 0)
            told = []
            for micros, row, missing in due:
                confirmations, since = (confirmations + 1, since if confirmations else micros) if missing else (0, 0)
                over = confirmations >= self.required and micros >= since + self.grace
                told.append((row, confirmations, "live" if not confirmations else "archived" if over else "grace"))
            self.absent.update((confirmations, since))
            if len(due) == len(every):
                self.waiting.clear()
            else:
                self.waiting.put(every[len(due) :])
            yield pd.DataFrame(told, columns=["row", "confirmations", "status"])

    def close(self) -> None:
        pass


def missing_stream(observations: DataFrame, by: str, at: str, row: str, missing: str, delay: str, required: int = CONFIRMATIONS, grace_days: int = GRACE_DAYS, keep: int | None = None) -> DataFrame:
    """row, confirmations and status of each of a stream of ``observations``, told once the watermark, ``delay`` behind the latest one, has passed it.

    Observations behind the watermark are dropped, as by any operator with one. The session's state store has to be ``PROVIDER``.
    """
    given = observations.select(by, F.col(at).cast("timestamp").alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("micros"), F.col(row).alias("row"), F.col(missing).alias("missing"))
    grouped = given.withWatermark("at", delay).groupBy(by)
    return grouped.transformWithStateInPandas(Grace(required, grace_days, keep), OUTPUT, "Append", "EventTime")
