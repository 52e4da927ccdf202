"""Extensions beyond the archive's own operators: windows of time, cubes, set operations, latest-before joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.operators import dedup, sequences
from folioscan.plans.common import table


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events that are less than thirty minutes apart."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the last click of its user before it: one pass over sorted rows, no pairs."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click"))
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(before)
    return e.withColumn("click_id", click).where("event_type = 'purchase'").select("event_id", "user_id", "click_id")


def users_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    of = lambda kind: e.where(F.col("event_type") == kind).select("user_id")
    return of("signup").intersect(of("purchase"))


def changes_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of another type than the one before."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return dedup.unique_adjacent(e, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


def merged_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return sequences.without(sequences.merged(customers, suppliers, "name"), "nation", 7)


QUERIES = [tumbling_counts, session_counts, order_cube, latest_before, users_in_both, changes_of_type, merged_without]

SQL = {
    "tumbling_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "session_counts": """WITH a AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s""",
    "order_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "latest_before": """WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id
FROM events WHERE event_type IN ('purchase', 'click')) SELECT event_id, user_id, click_id FROM e WHERE event_type = 'purchase'""",
    "users_in_both": "SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'",
    "changes_of_type": "SELECT event_id, user_id, event_type FROM events QUALIFY coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type, true)",
    "merged_without": "SELECT c_name AS name, c_nationkey AS nation FROM customer WHERE c_nationkey <> 7 UNION ALL SELECT s_name, s_nationkey FROM supplier WHERE s_nationkey <> 7",
}
