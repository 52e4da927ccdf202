"""Versions of two writers at once, batches that come again, the dispatcher as a running query, and state with timers."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from folioscan.operators import lifecycle
from folioscan.sources import images, store
from folioscan.streaming import commits, timers
from tests.test_sources import image


def test_two_writers_at_once(spark, tmp_path):
    folder, got = str(tmp_path / "i"), []
    work = lambda k: got.append(store.publish(spark, folder, {"t": spark.range(k + 1)}, token=f"w{k}:0"))
    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(100)
    assert sorted(got) == [1, 2, 3, 4] == store.versions(spark, folder)
    assert sorted(store.load(spark, folder, "t", v).count() for v in got) == [1, 2, 3, 4]
    assert {store.token(spark, folder, v): store.load(spark, folder, "t", v).count() for v in got} == {f"w{k}:0": k + 1 for k in range(4)}
    assert store._taken(spark, folder + "/x") and not store._taken(spark, folder + "/x")
    assert store.published_as(spark, folder, "w2")[1] == 0 and store.published_as(spark, folder, "none") is None


def _counts(spark, folder):
    return {t: store.load(spark, folder, t).count() for t in (*commits.STATE, "backup_events")}


def test_a_batch_that_comes_again(spark, tmp_path):
    """The query breaks off after its second version is published and before it is committed; it is started anew."""
    files, folder, checkpoint = tmp_path / "in", str(tmp_path / "archive"), str(tmp_path / "c")
    files.mkdir()
    read = lambda: spark.read.format("binaryFile").load(str(files))
    schema = None
    for k, number in enumerate((b"1", b"2", b"3")):
        (files / f"{k}.dcm").write_bytes(image(number=number).replace(b"1.2.3\0", b"1.2.%d\0" % (3 + k % 2)))
        meta = read().select("path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"), images.metadata(F.col("content")).alias("meta"))
        meta.where(F.col("path").endswith(f"/{k}.dcm")).coalesce(1).write.mode("append").parquet(str(tmp_path / "stream"))
        schema = meta.schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "stream"))
    write, calls = commits.import_batches(folder), []

    def breaks_off(batch, number):
        write(batch, number)
        calls.append(number)
        if number == 1:
            raise RuntimeError("made to fail")

    query = stream().writeStream.foreachBatch(breaks_off).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="made to fail"):
        query.awaitTermination(100)
    assert calls == [0, 1] and store.versions(spark, folder) == [1, 2]
    before = _counts(spark, folder)
    write(stream_batch := spark.read.schema(schema).parquet(str(tmp_path / "stream")), 1)
    assert store.versions(spark, folder) == [1, 2] and _counts(spark, folder) == before and stream_batch.count() == 3
    assert commits.import_stream(stream(), folder, checkpoint).awaitTermination(100)
    assert store.versions(spark, folder) == [1, 2, 3] and store.published_as(spark, folder, "imports") == (3, 2)
    after = _counts(spark, folder)
    assert after["instances"] == 2 and after["backup_events"] == 2 and after["patients"] == after["studies"] == after["series"] == 1


def test_dispatcher_runs(spark, tmp_path):
    """Pending events end as published, though the broker confirms only every other one at first."""
    folder, sent = str(tmp_path / "e"), []
    rows = [(i, f"t{i}", 10 * i, "PENDING", 0, "2024-01-01 00:00:00") for i in range(6)] + [(9, "t9", 90, "CONFIRMED", 0, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "id long, task_id string, instance_id long, status string, retry_count int, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("next_retry_at", F.lit(None).cast("timestamp"))
    store.publish(spark, folder, {"events": events})

    def send(messages):
        ids = [r.id for r in messages.collect()]
        sent.append(ids)
        return spark.createDataFrame([(i,) for i in ids if len(sent) > 1 or i % 2], "id long")

    query = commits.dispatcher(spark, folder, send, str(tmp_path / "c"), every="1 second")
    try:
        until = time.monotonic() + 90
        while time.monotonic() < until and store.load(spark, folder, "events").where("status = 'PENDING'").count():
            time.sleep(0.5)
    finally:
        query.stop()
    status = {r.id: r.status for r in store.load(spark, folder, "events").collect()}
    assert status == {**dict.fromkeys(range(6), "PUBLISHED"), 9: "CONFIRMED"}
    assert sent[0] == [0, 1, 2, 3, 4, 5] and sent[1] == [0, 2, 4]


def test_delivery_equals_the_batch(spark, tmp_path):
    """Starting tries, ended events and missing ones come from the events table; a failed task becomes due again."""
    spark.conf.set(*timers.PROVIDER)
    try:
        r = random.Random(3)
        events = spark.createDataFrame([(f"t{k}", ["PUBLISHED", "PUBLISHED", "CONFIRMED", "DEAD"][k % 4], k % 7) for k in range(20)] + [("late", "PUBLISHED", 0)], "task_id string, status string, retry_count int")
        rows = [(f"t{r.randrange(24)}", seq, r.random() < 0.25) for seq in range(160)] + [("late", 160, False)]
        schema = "task_id string, seq long, upload_ok boolean"
        given = spark.createDataFrame(rows, schema)
        for part in range(3):
            given.where(F.floor(F.col("seq") / 54) == part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        out = timers.deliver(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), events)
        query = out.writeStream.format("memory").queryName("delivered").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
        try:
            until = time.monotonic() + 60
            while time.monotonic() < until:
                got = spark.table("delivered").collect()
                if sum(x.outcome != "due" for x in got) == len(rows) and any(x.outcome == "due" for x in got):
                    break
                time.sleep(1)
        finally:
            query.stop()
        want = {(x.task_id, x.seq, x.outcome) for x in lifecycle.consumed(given, events, ["seq"]).collect()}
        assert {(x.task_id, x.seq, x.outcome) for x in got if x.outcome != "due"} == want
        assert {x[2] for x in want} == {"missing", "skipped", "confirmed", "retried", "dead"}
        due = [x for x in got if x.outcome == "due"]
        assert due and all(x.seq == -1 for x in due) and ("late", 1) in {(x.task_id, x.retry_count) for x in due} and {x.task_id for x in due} <= {t for t, _, o in want if o == "retried"}
    finally:
        spark.conf.unset(timers.PROVIDER[0])
