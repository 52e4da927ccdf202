"""Import decisions, the outbox of backup events, delivery with retries, and the scans around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tries of an event, seconds before a pending event counts as stuck, rows of a scan.
MOST_RETRIES, GRACE_SECONDS, SCAN_ROWS = 5, 5, 32


def import_decisions(attempts: DataFrame, uid: str = "uid", sha: str = "sha", crashed: str = "crashed", order: Sequence[str] = ("ts",), existing: DataFrame | None = None) -> DataFrame:
    """attempts with decision: NEW for a uid's first; CONFLICT where the content differs from the first; DUPLICATE once
    an attempt of the same content has completed; RESUME otherwise. existing (uid, sha, status) is what is archived
    already, one row a uid: it comes before all attempts, completed if its status is ARCHIVED.

    The content hash of an instance is written once, so the sequential machine is a function of the attempts before.
    The attempts of one uid are taken in order and meet in one task.
    """
    rows = attempts.withColumn("_old", F.lit(1))
    if existing is not None:
        held = existing.select(F.col(uid).alias(uid), F.col(sha).alias(sha), (F.col("status") != "ARCHIVED").alias(crashed), F.lit(0).alias("_old"))
        rows = rows.unionByName(held.join(attempts.select(F.col(uid)).distinct(), uid, "left_semi").select(*held.columns), allowMissingColumns=True)
    by = Window.partitionBy(uid).orderBy("_old", *order)
    first = F.first(sha).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.col("_first").eqNullSafe(F.col(sha))
    done = F.max((same & ~F.col(crashed)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("_first", first).withColumn("_n", F.row_number().over(by)).withColumn("_done", done)
    decision = F.when(F.col("_n") == 1, "NEW").when(~same, "CONFLICT").when(F.col("_done") == 1, "DUPLICATE").otherwise("RESUME")
    return out.withColumn("decision", decision).where("_old = 1").drop("_first", "_n", "_done", "_old")


def states_after(decided: DataFrame, existing: DataFrame | None = None, uid: str = "uid", sha: str = "sha", crashed: str = "crashed") -> DataFrame:
    """(uid, sha, status) after a batch of decisions: ARCHIVED once an import completed; else CONFLICT if other content
    was ever offered meanwhile; else PARSED. What was archived stays; the content hash is that of the first attempt."""
    completed = F.col("decision").isin("NEW", "RESUME") & ~F.col(crashed)
    now = decided.select(F.col(uid), F.when(F.col("decision") != "CONFLICT", F.col(sha)).alias(sha), F.when(completed, 2).when(F.col("decision") == "CONFLICT", 1).otherwise(0).alias("rank"))
    if existing is not None:
        now = now.unionByName(existing.select(F.col(uid), F.col(sha), F.when(F.col("status") == "ARCHIVED", 2).when(F.col("status") == "CONFLICT", 1).otherwise(0).alias("rank")))
    after = now.groupBy(uid).agg(F.max(sha).alias(sha), F.max("rank").alias("rank"))
    return after.select(uid, sha, F.element_at(F.array(F.lit("PARSED"), F.lit("CONFLICT"), F.lit("ARCHIVED")), F.col("rank") + 1).alias("status"))


def http_status(decision: Column, parsed: Column) -> Column:
    """Reply to an import: 400 if it cannot be parsed, 409 for a conflict, 200 for a duplicate, 201 otherwise."""
    return F.when(~parsed, 400).when(decision == "CONFLICT", 409).when(decision == "DUPLICATE", 200).otherwise(201)


def outbox(decided: DataFrame, uid: str = "uid", crashed: str = "crashed", order: Sequence[str] = ("ts",)) -> DataFrame:
    """(task_id, uid, status, retry_count): one pending event for each import that completed."""
    some = decided.where(F.col("decision").isin("NEW", "RESUME") & ~F.col(crashed))
    return some.select(F.sha2(F.concat_ws("|", uid, *order), 256).alias("task_id"), F.col(uid).alias("uid"), F.lit("PENDING").alias("status"), F.lit(0).alias("retry_count"))


def retry_delay(tries: Column, offset: int = 1) -> Column:
    """Seconds until try number `tries` is repeated: 2 ** (tries + offset)."""
    return F.pow(F.lit(2.0), tries + offset).cast("long")


def retry_schedule(failures: DataFrame, task: str, ts: str, order: Sequence[str], most: int = MOST_RETRIES) -> DataFrame:
    """failures with retry_count, status and next_retry_at: PUBLISHED with a growing delay, DEAD from `most` tries on."""
    n = F.row_number().over(Window.partitionBy(task).orderBy(*order))
    out = failures.withColumn("retry_count", n)
    live = F.col("retry_count") <= most
    return out.withColumn("status", F.when(live, "PUBLISHED").otherwise("DEAD")).withColumn("next_retry_at", F.when(live, F.timestamp_add("SECOND", retry_delay(F.col("retry_count")).cast("int"), F.col(ts))))


def compensation_scan(events: DataFrame, now: Column, rows: int | None = SCAN_ROWS) -> DataFrame:
    """Events to publish again: pending beyond the grace period, or published and due with tries left; oldest id first.
    rows is the scan's page; None returns all."""
    late = (F.col("status") == "PENDING") & (F.col("created_at") < F.timestamp_add("SECOND", F.lit(-GRACE_SECONDS), now))
    due = (F.col("status") == "PUBLISHED") & (F.col("next_retry_at") <= now) & (F.col("retry_count") < MOST_RETRIES)
    found = events.where(late | due)
    return found if rows is None else found.orderBy("id").limit(rows)


def stuck_events(events: DataFrame, now: Column) -> DataFrame:
    """Published, due and out of tries: the scan passes them over, so only a redelivery would end them."""
    return events.where((F.col("status") == "PUBLISHED") & (F.col("next_retry_at") <= now) & (F.col("retry_count") >= MOST_RETRIES))


def dispatch(events: DataFrame, confirmed: DataFrame, now: Column, rows: int | None = SCAN_ROWS) -> tuple[DataFrame, DataFrame]:
    """(messages, events): what a round of the dispatcher sends, and the events after it. confirmed (id) are the sends
    that the broker confirmed: only these move from PENDING to PUBLISHED; an event that was published already stays so.
    Without a confirmation an event is sent again by a later round."""
    due = compensation_scan(events, now, rows)
    messages = due.select("id", F.to_json(F.struct(F.col("task_id"), F.col("instance_id"))).alias("value"))
    sent = due.select("id").join(confirmed.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("_sent"))
    after = events.join(sent, F.col("id") == F.col("_sent"), "left")
    return messages, published(after, F.col("_sent").isNotNull()).drop("_sent")


def event_paths(events: DataFrame, instances: DataFrame, event_key: str = "instance_id", key: str = "id") -> DataFrame:
    """events with the storage_path of their instance; null where there is none, which a consumer treats as a failed
    upload."""
    known = instances.select(F.col(key).alias("_key"), "storage_path")
    return events.join(known, F.col(event_key) == F.col("_key"), "left").drop("_key")


def published(events: DataFrame, confirmed: Column) -> DataFrame:
    """events after a dispatch: only those still pending and confirmed by the broker move on."""
    return events.withColumn("status", F.when((F.col("status") == "PENDING") & confirmed, "PUBLISHED").otherwise(F.col("status")))


MESSAGE = "task_id string, instance_id long"


def messages(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(messages, poison): payloads with both fields, and those without."""
    parsed = raw.withColumn("_m", F.from_json(F.col(value), MESSAGE))
    whole = F.col("_m.task_id").isNotNull() & F.col("_m.instance_id").isNotNull()
    return parsed.where(whole).select("_m.*", *[c for c in raw.columns if c != value]), parsed.where(~F.coalesce(whole, F.lit(False))).drop("_m")


def consumed(deliveries: DataFrame, events: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Outcome of each delivery (task_id, upload_ok, ...) against events (task_id, status, retry_count).

    missing without an event; skipped if the event is confirmed or dead, or an earlier delivery here was confirmed;
    confirmed if the upload works; else retried while tries are left, then dead.
    """
    by = Window.partitionBy("task_id").orderBy(*order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    known = events.select("task_id", F.col("status").alias("_status"), F.col("retry_count").alias("_tries"))
    x = deliveries.join(known, "task_id", "left").withColumn("_ok", F.max(F.col("upload_ok").cast("int")).over(before)).withColumn("_failed", F.coalesce(F.sum((~F.col("upload_ok")).cast("int")).over(before), F.lit(0)))
    tries = F.col("_tries") + F.col("_failed")
    outcome = F.when(F.col("_status").isNull(), "missing").when(F.col("_status").isin("CONFIRMED", "DEAD") | (F.col("_ok") == 1), "skipped").when(F.col("upload_ok"), F.when(tries > MOST_RETRIES, "skipped").otherwise("confirmed")).when(tries > MOST_RETRIES, "skipped").when(tries == MOST_RETRIES, "dead").otherwise("retried")
    return x.withColumn("outcome", outcome).drop("_status", "_tries", "_ok", "_failed")


def outcome_counts(decided: DataFrame, column: str) -> DataFrame:
    return decided.groupBy(column).agg(F.count("*").alias("n"))
