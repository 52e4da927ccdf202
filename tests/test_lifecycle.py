"""Window forms of the state machines against sequential simulations, and streams against both."""

import random

from pyspark.sql import functions as F

from folioscan.operators import hierarchy, lifecycle
from folioscan.streaming import lifecycle as streams


def simulate(attempts):
    """Decisions one attempt at a time; a crash leaves the row that began unfinished."""
    state, out = {}, []
    for uid, seq, sha, crashed in attempts:
        first, done = state.get(uid, (None, False))
        decision = "NEW" if first is None else ("CONFLICT" if sha != first else "DUPLICATE" if done else "RESUME")
        if decision in ("NEW", "RESUME"):
            state[uid] = (sha, done or not crashed)
        out.append((uid, seq, decision))
    return out


def made(n=3000, seed=1):
    r = random.Random(seed)
    return [(f"u{r.randrange(n // 6)}", i, r.choice("aab"), r.random() < 0.4) for i in range(n)]


def test_import_decisions(spark):
    attempts = made()
    df = spark.createDataFrame(attempts, "uid string, seq long, sha string, crashed boolean")
    got = lifecycle.import_decisions(df, order=("seq",))
    assert sorted((r.uid, r.seq, r.decision) for r in got.collect()) == sorted(simulate(attempts))
    box = lifecycle.outbox(got, order=("seq",))
    assert box.count() == box.select("uid").distinct().count()  # an instance completes once


def _stream(spark, tmp_path, rows, schema, f, name):
    folder = tmp_path / name
    for k in range(3):
        spark.createDataFrame(rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3], schema).coalesce(1).write.mode("append").json(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(folder))
    q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streamed_decisions(spark, tmp_path):
    attempts = made(300, 2)
    got = _stream(spark, tmp_path, attempts, "uid string, seq long, sha string, crashed boolean", streams.import_decisions, "decided")
    assert sorted((r.uid, r.seq, r.decision) for r in got) == sorted(simulate(attempts))


def test_consumed_batch_equals_stream(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"t{r.randrange(12)}", i, r.random() < 0.08) for i in range(240)]
    schema = "task_id string, seq long, upload_ok boolean"
    got = _stream(spark, tmp_path, rows, schema, streams.consume, "consumed")
    events = spark.createDataFrame([(f"t{i}", "PUBLISHED", 0) for i in range(12)], "task_id string, status string, retry_count int")
    batch = lifecycle.consumed(spark.createDataFrame(rows, schema), events, ["seq"])
    assert sorted((x.task_id, x.seq, x.outcome) for x in got) == sorted((x.task_id, x.seq, x.outcome) for x in batch.collect())
    assert {x.outcome for x in got} == {"confirmed", "retried", "dead", "skipped"}


def test_first_deliveries_and_publish(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:05", 1), ("b", "2024-01-01 00:00:06", 2)]
    schema = "task_id string, ts timestamp, instance_id long"
    spark.createDataFrame([(a, b, c) for a, b, c in rows], "task_id string, ts string, instance_id long").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    streams.publish(streams.first_deliveries(stream, "ts", "1 minute"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    sent, poison = lifecycle.messages(spark.read.text(str(tmp_path / "out")))
    assert sorted(r.task_id for r in sent.collect()) == ["a", "b"] and poison.count() == 0
    counts = streams.windowed_counts(spark.readStream.schema(schema).json(str(tmp_path / "in")), "ts", "1 minute", "1 minute", "task_id")
    assert counts.isStreaming


def test_retries(spark):
    df = spark.createDataFrame([("t", i, "2024-01-01 00:00:00") for i in range(7)], "task string, seq int, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = lifecycle.retry_schedule(df, "task", "at", ["seq"]).orderBy("seq").select("status", (F.col("next_retry_at").cast("long") - F.col("at").cast("long")).alias("s")).collect()
    assert [r.s for r in got] == [4, 8, 16, 32, 64, None, None] and [r.status for r in got][5:] == ["DEAD", "DEAD"]


def test_scan_guards(spark):
    at = F.lit("2024-01-01 00:01:00").cast("timestamp")
    rows = [(1, "PENDING", 0, "2024-01-01 00:00:58", None), (2, "PENDING", 0, "2024-01-01 00:00:00", None), (3, "PUBLISHED", 4, "2024-01-01 00:00:00", "2024-01-01 00:01:00"), (4, "PUBLISHED", 5, "2024-01-01 00:00:00", "2024-01-01 00:00:00"), (5, "CONFIRMED", 0, "2024-01-01 00:00:00", None)]
    e = spark.createDataFrame(rows, "id int, status string, retry_count int, created_at string, next_retry_at string").withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "next_retry_at")})
    assert [r.id for r in lifecycle.compensation_scan(e, at).collect()] == [2, 3]
    assert [r.id for r in lifecycle.stuck_events(e, at).collect()] == [4]
    assert [r.status for r in lifecycle.published(e, F.lit(True)).orderBy("id").collect()] == ["PUBLISHED"] * 4 + ["CONFIRMED"]


def test_upserts(spark):
    rows = [("P", "", "Old", "M", 1), ("P", "", None, "F", 2), ("Q", "x", "New", "O", 3)]
    got = hierarchy.upsert_patients(None, spark.createDataFrame(rows, "patient_id string, issuer string, patient_name string, sex string, seq int"), ["seq"])
    assert {(r.patient_id, r.issuer): (r.patient_name, r.sex) for r in got.collect()} == {("P", ""): (None, "M"), ("Q", "x"): ("New", "O")}
    again = hierarchy.upsert_patients(got, spark.createDataFrame([("P", "", "Newest", "X", 9)], "patient_id string, issuer string, patient_name string, sex string, seq int"), ["seq"])
    assert {r.patient_id: (r.patient_name, r.sex) for r in again.collect()} == {"P": ("Newest", "M"), "Q": ("New", "O")}
    series = hierarchy.upsert_series(None, spark.createDataFrame([("1", "CT", 2), ("1", "MR", 1)], "series_instance_uid string, modality string, seq int"), ["seq"])
    assert [tuple(r) for r in series.collect()] == [("1", "MR")]
    dated = hierarchy.upsert_studies(None, spark.createDataFrame([("s", "2024", 1), ("s", None, 2)], "study_instance_uid string, study_date string, seq int"), ["seq"])
    assert dated.first().study_date is None


def test_policy_and_checks(spark):
    asked = spark.createDataFrame([("admin", "x"), ("radiologist", "studies:read"), ("radiologist", "x"), (None, "x")], "role string, action string")
    assert [r.allowed for r in hierarchy.allowed(asked).collect()] == [True, True, False, False]
    df = spark.createDataFrame([(1, "M", "A"), (2, "X", None), (3, None, "B")], "id int, sex string, status string")
    bad = hierarchy.violations(df, "id", {"sex": ["M", "F", "O"], "status": ["A"]}, nullable=["sex"])
    assert {(r.id, r.column, r.value) for r in bad.collect()} == {(2, "sex", "X"), (2, "status", None), (3, "status", "B")}


def test_streamed_frames(spark, tmp_path):
    import base64

    from folioscan.sources import frames
    from folioscan.streaming import frames as stream

    whole = frames.encode(1, "肺".encode()) + frames.encode(2, b"xy")
    pieces = [("a", i, base64.b64encode(whole[i : i + 3]).decode()) for i in range(0, len(whole), 3)] + [("b", 0, base64.b64encode(frames.encode(0x99, b"")).decode()), ("b", 9, base64.b64encode(whole).decode())]
    pieces.sort(key=lambda p: p[1])
    rows = _stream(spark, tmp_path, pieces, "conn string, seq long, data string", lambda s: stream.decode(s.withColumn("data", F.unbase64("data"))), "framed")
    assert sorted((r.conn, r.n, r.status, bytes(r.payload or b"")) for r in rows) == [("a", 0, "OK", "肺".encode()), ("a", 1, "OK", b"xy"), ("b", 0, "BAD_TYPE", b"")]
