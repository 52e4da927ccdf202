"""Streams whose every batch is one version of several tables: the archive's imports, and the dispatcher's rounds.

A batch is published with its query's name and number in the version's marker. A batch that comes again, because its
query broke off after the version was published, is known by that number and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan import archive
from folioscan.operators import lifecycle
from folioscan.sources import store

#: Fixed value: how often the dispatcher looks for events that are due.
EVERY = "3 seconds"
#: Tables that a batch of imports reads and writes anew, and the events, to which it adds.
STATE = ("patients", "studies", "series", "instances")


def once(folder: str, name: str, tables: Callable[[DataFrame, Callable[[str], DataFrame | None]], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: publishes tables(batch, before) as one version, unless that batch or a later one of
    this query is there already; before(table) is the table in the latest version, or nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = store.published_as(spark, folder, name)
        if done and done[1] >= number:
            return
        latest = store.versions(spark, folder)
        before = lambda table: store.load(spark, folder, table, latest[-1]) if latest else None
        store.publish(spark, folder, tables(batch, before), token=f"{name}:{number}")

    return write


def import_batches(folder: str, name: str = "imports", crashed: Column | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over image files (path, file_size, sha256, meta): each batch is imported on what the archive
    holds. Instances and their events are in one version, so both are seen or neither."""

    def tables(batch: DataFrame, before: Callable[[str], DataFrame | None]) -> dict[str, DataFrame]:
        held = {t: before(t) for t in STATE}
        out = archive.import_batch(batch, {t: df for t, df in held.items() if df is not None}, crashed)
        events = before("backup_events")
        return out if events is None else out | {"backup_events": events.unionByName(out["backup_events"])}

    return once(folder, name, tables)


def import_stream(files: DataFrame, folder: str, checkpoint: str, crashed: Column | None = None) -> StreamingQuery:
    """Imports a stream of image files until what is there is done."""
    return files.writeStream.foreachBatch(import_batches(folder, crashed=crashed)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dispatch_rounds(folder: str, send: Callable[[DataFrame], DataFrame], now: Column | None = None, rows: int | None = lifecycle.SCAN_ROWS, name: str = "dispatcher") -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a clock: each tick is one round over the table events in folder. send gets the messages
    (id, value) and returns the ids that the broker confirmed; only these are published, the rest is sent again by a
    later round. What breaks off after sending and before its version is there is sent again too: at least once."""

    def tables(_: DataFrame, before: Callable[[str], DataFrame | None]) -> dict[str, DataFrame]:
        events, at = before("events"), F.current_timestamp() if now is None else now
        messages, _ = lifecycle.dispatch(events, events.select("id").limit(0), at, rows)
        confirmed = send(messages)
        return {"events": lifecycle.dispatch(events, confirmed, at, rows)[1]}

    return once(folder, name, tables)


def dispatcher(spark, folder: str, send: Callable[[DataFrame], DataFrame], checkpoint: str, every: str = EVERY, rows: int | None = lifecycle.SCAN_ROWS) -> StreamingQuery:
    """The dispatcher as a running query: a round every few seconds until it is stopped."""
    clock = spark.readStream.format("rate").load()
    return clock.writeStream.foreachBatch(dispatch_rounds(folder, send, rows=rows)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
