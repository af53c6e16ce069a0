"""Visibility timeouts: a received job that nobody answers comes back, and at last gives up.

Keyed by job, with event-time timers. A receive starts a flight; while it lasts further
receives of the job don't count. Unanswered, the job is received again after ``timeout``;
after ``limit`` receives it goes to the dead letters. An acknowledgement ends the flight.
Whatever is due at an event's time is settled before the event, so results don't depend on
how rows fall into micro-batches; timers settle what no later event of the job would.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperfold.session import use_state_store
from paperfold.streaming.jobs import MAX_RECEIVES

VISIBILITY_TIMEOUT = 45 * 60
NO_FLIGHT = -1


class Visibility(StatefulProcessor):
    """State: when the flight began (microseconds) and the receives so far."""

    OUTPUT = (T.StructType().add("job_id", T.StringType()).add("event", T.StringType())
              .add("receives", T.LongType()).add("at_us", T.LongType()))

    def __init__(self, timeout: int = VISIBILITY_TIMEOUT, limit: int = MAX_RECEIVES) -> None:
        self.timeout, self.limit = timeout * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flight = handle.getValueState("flight", "began bigint, receives bigint")

    def due(self, began: int, receives: int, now: int, out: list) -> tuple[int, int]:
        """Settle all timeouts up to ``now``."""
        while began != NO_FLIGHT and began + receives * self.timeout <= now:
            at = began + receives * self.timeout
            if receives == self.limit:
                out.append(("dead_letter", receives, at))
                began, receives = NO_FLIGHT, 0
            else:
                receives += 1
                out.append(("received", receives, at))
        return began, receives

    def keep(self, began: int, receives: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if began == NO_FLIGHT:
            self.flight.clear()
        else:
            self.flight.update((began, receives))
            self.handle.registerTimer(-(-(began + receives * self.timeout) // 1000))

    def rows(self, key, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=self.OUTPUT.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        began, receives = self.flight.get() if self.flight.exists() else (NO_FLIGHT, 0)
        out: list = []
        ordered = pd.concat([batch[["at_us", "seq", "ok"]] for batch in rows]).sort_values(["at_us", "seq"])
        for at, ok in zip(ordered["at_us"].tolist(), ordered["ok"].tolist()):
            began, receives = self.due(began, receives, at, out)
            if began == NO_FLIGHT and not ok:
                began, receives = at, 1
                out.append(("received", 1, at))
            elif began != NO_FLIGHT and ok:
                out.append(("acked", receives, at))
                began, receives = NO_FLIGHT, 0
        self.keep(began, receives)
        yield from self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        began, receives = self.flight.get() if self.flight.exists() else (NO_FLIGHT, 0)
        out: list = []
        began, receives = self.due(began, receives, timerValues.getCurrentWatermarkInMs() * 1000, out)
        self.keep(began, receives)
        yield from self.rows(key, out)

    def close(self) -> None:
        pass


def flights(receipts: DataFrame, late: str = "10 minutes", timeout: int = VISIBILITY_TIMEOUT, limit: int = MAX_RECEIVES) -> DataFrame:
    """(job_id, event, receives, at_us): every receive, acknowledgement and dead letter.

    receipts: job_id, ts, seq (order of equal times), ok (an acknowledgement).
    """
    use_state_store(receipts.sparkSession)
    keyed = receipts.withWatermark("ts", late).select("job_id", "ts", "seq", "ok", F.unix_micros("ts").alias("at_us"))
    return keyed.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=Visibility(timeout, limit), outputStructType=Visibility.OUTPUT, outputMode="Append", timeMode="EventTime")
