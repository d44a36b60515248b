"""Queries that run streams over tables to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlake.streaming import windows as st


def stream_event_windows(spark, folder):
    events = st.stream_table(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = st.drain(st.windowed_counts(events, "at", "event_type", "1 day", "1 hour"), "windows")
    return found.select(F.unix_seconds("begin").alias("begin_s"), "event_type", "n")


def stream_first_seen(spark, folder):
    events = st.stream_table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type")
    return st.drain(st.first_seen(events, ["user_id", "event_type"], "at", "400 days"), "first").select("user_id", "event_type")


def stream_politeness(spark, folder):
    return st.drain(st.polite_visits(st.stream_table(spark, folder, "events"), "user_id", "ts", 60_000), "polite")


QUERIES = {f.__name__: f for f in (stream_event_windows, stream_first_seen, stream_politeness)}

SQL = {
    "stream_event_windows": """
        SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000 AS begin_s, event_type, count(*) AS n FROM events
        WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
    "stream_politeness": """
        WITH v AS (SELECT user_id::varchar AS host, epoch_us(ts) // 1000 AS ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
        SELECT host, ts_ms, (60000 * k + max(ts_ms - 60000 * k) OVER (PARTITION BY host ORDER BY k))::bigint AS ready_at_ms FROM v""",
    "stream_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
}
