"""Streams of import attempts and of deliveries: state is kept for each key, and each batch is written whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscan.operators.lifecycle import MOST_RETRIES

DECIDED = "uid string, seq long, sha string, crashed boolean, decision string"


def _decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first, done = state.get if state.exists else (None, False)
    rows = pd.concat(list(parts)).sort_values("seq")
    out = []
    for seq, sha, crashed in zip(rows.seq, rows.sha, rows.crashed):
        decision = "NEW" if first is None else "CONFLICT" if sha != first else "DUPLICATE" if done else "RESUME"
        first = sha if first is None else first
        done = done or (sha == first and not crashed)
        out.append((key[0], seq, sha, crashed, decision))
    state.update((first, done))
    yield pd.DataFrame(out, columns=["uid", "seq", "sha", "crashed", "decision"])


def import_decisions(attempts: DataFrame) -> DataFrame:
    """Decisions of a stream (uid, seq, sha, crashed); within a batch attempts are taken in the order of seq. Two values
    are kept for each uid."""
    return attempts.groupBy("uid").applyInPandasWithState(_decide, DECIDED, "first string, done boolean", "append", GroupStateTimeout.NoTimeout)


CONSUMED = "task_id string, seq long, outcome string"


def _consume(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, tries = state.get if state.exists else ("PUBLISHED", 0)
    rows = pd.concat(list(parts)).sort_values("seq")
    out = []
    for seq, ok in zip(rows.seq, rows.upload_ok):
        if status != "PUBLISHED":
            outcome = "skipped"
        elif ok:
            status, outcome = "CONFIRMED", "confirmed"
        elif tries >= MOST_RETRIES:
            status, outcome = "DEAD", "dead"
        else:
            tries, outcome = tries + 1, "retried"
        out.append((key[0], seq, outcome))
    state.update((status, tries))
    yield pd.DataFrame(out, columns=["task_id", "seq", "outcome"])


def consume(deliveries: DataFrame) -> DataFrame:
    """Outcomes of a stream (task_id, seq, upload_ok): at-least-once delivery, effectively-once result."""
    return deliveries.groupBy("task_id").applyInPandasWithState(_consume, CONSUMED, "status string, tries int", "append", GroupStateTimeout.NoTimeout)


def first_deliveries(deliveries: DataFrame, ts: str, delay: str) -> DataFrame:
    """Each task once, among deliveries no further apart than `delay`; state is dropped after that."""
    return deliveries.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["task_id"])


def windowed_counts(events: DataFrame, ts: str, width: str, delay: str, by: str) -> DataFrame:
    """Events in tumbling windows; rows later than `delay` are dropped."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))


def publish(messages: DataFrame, folder: str, checkpoint: str):
    """A stream of JSON messages into text files, once through what is there."""
    coded = messages.select(F.to_json(F.struct("task_id", "instance_id")).alias("value"))
    return coded.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
