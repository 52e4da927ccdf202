"""The archive on the relational tables: duplicates, hierarchy, imports, the outbox, retries and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import dedup, hierarchy, index, lifecycle
from folioscan.plans.common import stored, table
from folioscan.sources import frames

#: Fixed points of the queries: a customer, a page size, the time that scans take for now.
CUSTOMER, PAGE, NOW = 42, 200, "2024-06-15 00:00:00"


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each row; votes of rows that share an id add up as they are."""
    return index.row_frequencies(table(spark, sf_dir, "documents"), "text")


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return dedup.first_wins(docs, ["sha"], ["doc_id"])


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("file_size"))


def simhash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.simhash(_tf(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fp"))


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(stored(spark, dedup.simhash(_tf(spark, sf_dir))))


def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.classes(stored(spark, dedup.simhash(_tf(spark, sf_dir))))


def simhash_jenkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.simhash_jenkins(_tf(spark, sf_dir)).select("doc_id", F.conv(F.hex("fp"), 16, 10).alias("fp"))


def list_parents_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of newest orders with their customers and numbers of items, as studies are listed with their patients."""
    orders = table(spark, sf_dir, "orders")
    page = hierarchy.list_top(orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders.o_custkey == F.col("c_custkey")), [F.desc("o_orderdate"), F.desc("o_orderkey")], PAGE)
    counted = hierarchy.with_child_count(page, table(spark, sf_dir, "lineitem").select("l_orderkey"), "o_orderkey", "l_orderkey", "n_items", page=True)
    return counted.select("o_orderkey", "c_name", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), "n_items")


def list_of_one_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders, narrowed by status only because the customer is given."""
    orders = hierarchy.filtered(table(spark, sf_dir, "orders"), ("o_custkey", CUSTOMER), ("o_orderstatus", "O"))
    return hierarchy.list_top(orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], PAGE).select("o_orderkey", "o_orderstatus", F.coalesce("o_orderpriority", F.lit("")).alias("priority"))


def list_children_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every order with how many lines the order has; lines without a number would come first."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return hierarchy.with_child_count(lines, lines.select(F.col("l_orderkey").alias("k")), "l_orderkey", "k", "n_lines")


def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders counted at each level of region, nation and customer segment."""
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    customers = table(spark, sf_dir, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name", "c_mktsegment").agg(F.sum("n").alias("n_orders"), F.count("*").alias("n_customers"))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")


def upsert_latest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of a user's last event beside the value of the first, as a patient's name is refreshed and the rest is not."""
    return hierarchy.upsert(None, _arrivals(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["event_type"])


def upsert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.upsert(None, _arrivals(spark, sf_dir), ["user_id"], ["ts", "event_id"], [])


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.point_lookup(table(spark, sf_dir, "orders"), "o_orderkey", CUSTOMER, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])


def missing_children_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("uid"), F.col("event_type").alias("sha"), (F.col("event_id") % 3 == 0).alias("crashed"))
    return lifecycle.import_decisions(attempts, order=("ts", "event_id"))


def import_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("event_id", "uid", "decision", lifecycle.http_status(F.col("decision"), F.lit(True)).alias("status"))


def import_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.outcome_counts(_decided(spark, sf_dir), "decision")


def outbox_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.outbox(_decided(spark, sf_dir), order=("event_id",))


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    return lifecycle.retry_schedule(failures, "user_id", "ts", ["ts", "event_id"])


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, ("PENDING", "PUBLISHED", "CONFIRMED", "DEAD"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), status.alias("status"), (F.col("event_id") % 7).cast("int").alias("retry_count"), F.col("ts").alias("created_at"), F.timestamp_add("SECOND", F.lit(64), F.col("ts")).alias("next_retry_at"))


def compensation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.compensation_scan(_outbox(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("id", "status", "retry_count")


def compensation_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.compensation_scan(_outbox(spark, sf_dir), F.lit(NOW).cast("timestamp"), rows=None).groupBy("status").agg(F.count("*").alias("n"))


def stuck_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.stuck_events(_outbox(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("id", "retry_count")


def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.list_top(_outbox(spark, sf_dir), [F.desc("id")], 50).select("id", "status", "retry_count")


def consumer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    deliveries = e.select("event_id", "ts", F.concat(F.lit("t"), F.col("user_id") * 5 + F.col("event_id") % 5).alias("task_id"), (F.col("event_type") == "purchase").alias("upload_ok"))
    tasks = deliveries.select("task_id").distinct().where(~F.col("task_id").endswith("3")).withColumn("status", F.when(F.col("task_id").endswith("7"), "CONFIRMED").otherwise("PUBLISHED")).withColumn("retry_count", F.lit(0))
    return lifecycle.consumed(deliveries, tasks, ["ts", "event_id"]).select("event_id", "task_id", "outcome")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of which some lack a field and some are cut short."""
    e = table(spark, sf_dir, "events")
    whole = F.concat(F.lit('{"task_id":"t'), F.col("event_id"), F.lit('","instance_id":'), F.col("user_id"), F.lit("}"))
    value = F.when(F.col("event_id") % 11 == 0, F.lit('{"task_id":"x"}')).when(F.col("event_id") % 13 == 0, F.substring(whole, 1, 9)).otherwise(whole)
    return e.select("event_id", value.alias("value"))


def valid_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.messages(_messages(spark, sf_dir))[0]


def poison_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.messages(_messages(spark, sf_dir))[1]


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.violations(table(spark, sf_dir, "events"), "event_id", {"event_type": ["signup", "purchase", "view", "click"]})


def rbac_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ("admin", "radiologist", "guest"))), (F.col("event_id") % 3 + 1).cast("int"))
    action = F.element_at(F.array(*map(F.lit, ("images:import", "studies:read", "admin:backup"))), (F.floor(F.col("event_id") / 3) % 3 + 1).cast("int"))
    return hierarchy.allowed(table(spark, sf_dir, "events").select("event_id", role.alias("role"), action.alias("action")))


def page_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the reason for which a parser of required parts would turn them down, in the order of its checks."""
    pages, has = table(spark, sf_dir, "pages"), lambda tag: F.contains(F.lower("html"), F.lit(f"<{tag}"))
    reason = F.when(~has("html"), "no html").when(~has("title"), "no title").when(~has("body"), "no body").when(~has("p"), "no paragraph").otherwise("accepted")
    return pages.select("page_id", reason.alias("reason"))


def tlv_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as frames of one byte string, read back; of four, one has a bad frame at its end, one is
    cut short, and one ends in a frame that is too long."""
    turns = table(spark, sf_dir, "conversations").withColumn("frame", frames.encoded(F.when(F.col("role") == "user", 1).otherwise(0x11), F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    joined = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "frame"))).alias("x")).select("conv_id", F.unhex(F.array_join(F.transform("x.frame", lambda f: F.hex(f)), "")).alias("data"))
    kind, data = F.col("conv_id") % 4, F.col("data")
    joined = joined.withColumn("data", F.when(kind == 1, F.concat(data, F.unhex(F.lit("990000000000")))).when(kind == 2, F.substring(data, F.lit(1), F.octet_length(data) - 3)).when(kind == 3, F.concat(data, F.unhex(F.lit("010000100001")))).otherwise(data))
    return frames.decoded(joined).select("conv_id", "seq", "status", "type", F.octet_length("payload").alias("bytes"))


QUERIES = [
    dedup_first_wins, content_hash, simhash64, near_duplicate_pairs, near_duplicate_classes, simhash_jenkins, list_parents_with_counts, list_of_one_parent, list_children_with_counts, hierarchy_rollup, upsert_latest_name, upsert_first_wins,
    point_lookup, missing_children_anti_join, import_decisions, import_outcome_counts, outbox_rows, retry_schedule, compensation_scan, compensation_backlog, stuck_events, recent_events, consumer_outcomes, valid_messages, poison_messages,
    constraint_violations, rbac_decisions, page_rejects, tlv_frames,
]

_FP = r"""
w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE strlen(term) > 1 GROUP BY ALL),
h AS (SELECT doc_id, tf, ('0x' || substr(md5(term), 1, 16))::UBIGINT AS h FROM tf),
b AS (SELECT doc_id, j, sum(CASE WHEN (h >> j) & 1 = 1 THEN tf ELSE -tf END) AS v FROM h, range(64) AS r(j) GROUP BY ALL),
fp AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN (1::HUGEINT << j::INT) ELSE 0 END)::UBIGINT AS fp FROM b GROUP BY doc_id)
"""
_DECIDED = """
a AS (SELECT event_id, ts, user_id AS uid, event_type AS sha, event_id % 3 = 0 AS crashed FROM events),
f AS (SELECT *, first_value(sha) OVER w AS sha0, row_number() OVER w AS rn FROM a WINDOW w AS (PARTITION BY uid ORDER BY ts, event_id)),
g AS (SELECT *, max((sha = sha0 AND NOT crashed)::INT) OVER (PARTITION BY uid ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM f),
d AS (SELECT *, CASE WHEN rn = 1 THEN 'NEW' WHEN sha <> sha0 THEN 'CONFLICT' WHEN done = 1 THEN 'DUPLICATE' ELSE 'RESUME' END AS decision FROM g)
"""
_OUTBOX = """o AS (SELECT event_id AS id, ['PENDING', 'PUBLISHED', 'CONFIRMED', 'DEAD'][event_id % 4 + 1] AS status, (event_id % 7)::INT AS retry_count, ts AS created_at, ts + INTERVAL 64 SECOND AS next_retry_at FROM events)"""
_SCAN = f"((status = 'PENDING' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 5 SECOND) OR (status = 'PUBLISHED' AND next_retry_at <= TIMESTAMP '{NOW}' AND retry_count < 5))"
_MESSAGE = """m AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '{"task_id":"x"}' WHEN event_id % 13 = 0 THEN substr(v, 1, 9) ELSE v END AS value, user_id FROM (SELECT *, '{"task_id":"t' || event_id || '","instance_id":' || user_id || '}' AS v FROM events))"""
_UPSERT = "SELECT user_id, {0}(event_type, (ts, event_id)) AS event_type, arg_min(value, (ts, event_id)) AS value FROM (SELECT user_id, event_type, value, ts, event_id FROM events) GROUP BY user_id"

SQL = {
    "dedup_first_wins": "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, sha256(text) AS sha FROM documents GROUP BY sha256(text)",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS file_size FROM documents",
    "simhash64": f"WITH {_FP} SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fp FROM fp",
    "near_duplicate_pairs": f"WITH {_FP}, r AS (SELECT fp, min(doc_id) AS id FROM fp GROUP BY fp) SELECT a.id AS a, b.id AS b, bit_count(xor(a.fp, b.fp))::INT AS distance FROM r AS a, r AS b WHERE a.id < b.id AND bit_count(xor(a.fp, b.fp)) <= 3",
    "near_duplicate_classes": f"WITH {_FP} SELECT doc_id, min(doc_id) OVER (PARTITION BY fp) AS representative FROM fp",
    "list_parents_with_counts": f"""SELECT o_orderkey, c_name, strftime(o_orderdate, '%Y-%m-%d') AS order_date, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_items
FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT {PAGE}""",
    "list_of_one_parent": f"SELECT o_orderkey, o_orderstatus, coalesce(o_orderpriority, '') AS priority FROM orders WHERE o_custkey = {CUSTOMER} AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT {PAGE}",
    "list_children_with_counts": "SELECT l_orderkey, l_linenumber, l_quantity, count(*) OVER (PARTITION BY l_orderkey) AS n_lines FROM lineitem",
    "hierarchy_rollup": """SELECT r_name, n_name, c_mktsegment, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""",
    "upsert_latest_name": _UPSERT.format("arg_max"),
    "upsert_first_wins": _UPSERT.format("arg_min"),
    "point_lookup": f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = {CUSTOMER}",
    "missing_children_anti_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "import_decisions": f"WITH {_DECIDED} SELECT event_id, uid, decision, CASE decision WHEN 'CONFLICT' THEN 409 WHEN 'DUPLICATE' THEN 200 ELSE 201 END AS status FROM d",
    "import_outcome_counts": f"WITH {_DECIDED} SELECT decision, count(*) AS n FROM d GROUP BY decision",
    "outbox_rows": f"WITH {_DECIDED} SELECT sha256(uid || '|' || event_id) AS task_id, uid, 'PENDING' AS status, 0 AS retry_count FROM d WHERE decision IN ('NEW', 'RESUME') AND NOT crashed",
    "retry_schedule": """WITH r AS (SELECT event_id, user_id, ts, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS retry_count FROM events WHERE event_type = 'error')
SELECT *, CASE WHEN retry_count <= 5 THEN 'PUBLISHED' ELSE 'DEAD' END AS status, CASE WHEN retry_count <= 5 THEN ts + to_seconds(pow(2, retry_count + 1)) END AS next_retry_at FROM r""",
    "compensation_scan": f"WITH {_OUTBOX} SELECT id, status, retry_count FROM o WHERE {_SCAN} ORDER BY id LIMIT 32",
    "compensation_backlog": f"WITH {_OUTBOX} SELECT status, count(*) AS n FROM o WHERE {_SCAN} GROUP BY status",
    "stuck_events": f"WITH {_OUTBOX} SELECT id, retry_count FROM o WHERE status = 'PUBLISHED' AND next_retry_at <= TIMESTAMP '{NOW}' AND retry_count >= 5",
    "recent_events": f"WITH {_OUTBOX} SELECT id, status, retry_count FROM o ORDER BY id DESC LIMIT 50",
    "consumer_outcomes": """WITH d AS (SELECT event_id, ts, 't' || (user_id * 5 + event_id % 5) AS task_id, event_type = 'purchase' AS ok FROM events),
x AS (SELECT *, max(ok::INT) OVER w AS had, coalesce(sum((NOT ok)::INT) OVER w, 0) AS failed FROM d WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, task_id, CASE WHEN task_id LIKE '%3' THEN 'missing' WHEN task_id LIKE '%7' OR had = 1 OR failed > 5 THEN 'skipped' WHEN ok THEN 'confirmed' WHEN failed = 5 THEN 'dead' ELSE 'retried' END AS outcome FROM x""",
    "valid_messages": f"WITH {_MESSAGE} SELECT event_id, 't' || event_id AS task_id, user_id AS instance_id FROM m WHERE event_id % 11 <> 0 AND event_id % 13 <> 0",
    "poison_messages": f"WITH {_MESSAGE} SELECT event_id, value FROM m WHERE event_id % 11 = 0 OR event_id % 13 = 0",
    "constraint_violations": "SELECT event_id, 'event_type' AS \"column\", event_type AS value FROM events WHERE event_type NOT IN ('signup', 'purchase', 'view', 'click')",
    "rbac_decisions": """SELECT *, role = 'admin' OR (role = 'radiologist' AND action IN ('images:import', 'studies:read')) AS allowed
FROM (SELECT event_id, ['admin', 'radiologist', 'guest'][event_id % 3 + 1] AS role, ['images:import', 'studies:read', 'admin:backup'][(event_id // 3) % 3 + 1] AS action FROM events)""",
    "page_rejects": "SELECT page_id, CASE WHEN NOT contains(lower(html), '<html') THEN 'no html' WHEN NOT contains(lower(html), '<title') THEN 'no title' WHEN NOT contains(lower(html), '<body') THEN 'no body' WHEN NOT contains(lower(html), '<p') THEN 'no paragraph' ELSE 'accepted' END AS reason FROM pages",
    "tlv_frames": """WITH f AS (SELECT conv_id, row_number() OVER w - 1 AS seq, CASE WHEN role = 'user' THEN 1 ELSE 17 END AS type, octet_length(encode(coalesce(text, ''))) AS bytes, conv_id % 4 = 2 AND row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS cut FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, seq::INT AS seq, CASE WHEN cut THEN 'PARTIAL' ELSE 'OK' END AS status, CASE WHEN NOT cut THEN type END AS type, (CASE WHEN cut THEN bytes + 3 ELSE bytes END)::INT AS bytes FROM f
UNION ALL SELECT conv_id, count(*)::INT, CASE conv_id % 4 WHEN 1 THEN 'BAD_TYPE' ELSE 'TOO_LONG' END, NULL, 6 FROM f WHERE conv_id % 4 IN (1, 3) GROUP BY conv_id""",
}
