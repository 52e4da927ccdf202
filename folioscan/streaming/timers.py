"""Delivery of backup events as keyed state with timers: the events table is the state that a stream begins with.

Each task's state is its event (status, tries). A failed upload sets a timer for the time its next try is due; when it
fires, the task is put out again as due. Tasks that end, or that no event is known for, keep no timer; an ended task's
state expires after a time without deliveries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioscan.operators.lifecycle import MOST_RETRIES

OUT = "task_id string, seq long, outcome string, retry_count int"
#: The state store that typed state and timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: How long a task's state stays after it was last written.
KEPT_MS = 7 * 24 * 3600 * 1000


class Delivery(StatefulProcessor):
    """missing without an event; skipped once it is confirmed or dead; confirmed if the upload works; else retried while
    tries are left, then dead. A retry's delay is 2 ** (tries + 1) seconds."""

    def __init__(self, kept_ms: int = KEPT_MS):
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", "status string, tries int", self.kept_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for status, tries in zip(initialState["status"], initialState["retry_count"]):
            self.event.update((status, int(tries)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values("seq")
        held = self.event.get() if self.event.exists() else None
        status, tries = held if held is not None else (None, 0)
        out = []
        for seq, ok in zip(given["seq"], given["upload_ok"]):
            if status is None:
                outcome = "missing"
            elif status in ("CONFIRMED", "DEAD") or tries > MOST_RETRIES:
                outcome = "skipped"
            elif ok:
                status, outcome = "CONFIRMED", "confirmed"
            elif tries == MOST_RETRIES:
                status, outcome = "DEAD", "dead"
            else:
                tries, outcome = tries + 1, "retried"
            out.append((key[0], int(seq), outcome, tries))
        if held is not None and (status, tries) != tuple(held):
            self.event.update((status, tries))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if status not in ("CONFIRMED", "DEAD"):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * 2 ** (tries + 1))
        yield pd.DataFrame(out, columns=["task_id", "seq", "outcome", "retry_count"]).astype({"retry_count": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.event.exists():
            status, tries = self.event.get()
            if status not in ("CONFIRMED", "DEAD"):
                yield pd.DataFrame([(key[0], -1, "due", tries)], columns=["task_id", "seq", "outcome", "retry_count"]).astype({"retry_count": "int32"})

    def close(self) -> None:
        pass


def deliver(deliveries: DataFrame, events: DataFrame, kept_ms: int = KEPT_MS) -> DataFrame:
    """(task_id, seq, outcome, retry_count) of a stream of deliveries (task_id, seq, upload_ok), on events (task_id,
    status, retry_count); also a row (seq -1, outcome due) when a failed task's delay is over. Within a batch deliveries
    are taken in the order of seq. The session needs the state store PROVIDER."""
    start = events.select("task_id", "status", F.col("retry_count").cast("int").alias("retry_count")).groupBy("task_id")
    return deliveries.groupBy("task_id").transformWithStateInPandas(Delivery(kept_ms), OUT, "append", "processingTime", start)
