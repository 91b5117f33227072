"""Window and streaming queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.sources import files
from kgspark.streaming import ingest, windows
from kgspark.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return windows.timed(table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(_events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)]) AS s FROM events) GROUP BY 1")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return windows.sliding(_events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, (epoch_us(max(ts)) - epoch_us(min(ts)) + 21600000000)::BIGINT AS micros, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(_events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return windows.deduped(_events(spark, d).select("user_id", "event_type"), ["user_id", "event_type"])


@query("""WITH s AS (SELECT *, CASE message_type WHEN 'text_artifact' THEN 'waiting_for_artifact' WHEN 'search_query' THEN 'waiting_for_search' WHEN 'delete_query' THEN 'waiting_for_delete_query'
  WHEN 'action' THEN CASE WHEN contains(lower(message_text), 'добав') THEN 'waiting_for_artifact' WHEN contains(lower(message_text), 'поиск') THEN 'waiting_for_search' WHEN contains(lower(message_text), 'удал') THEN 'waiting_for_delete_query' ELSE 'idle' END END AS now FROM history_messages)
SELECT user_id, id, coalesce(last_value(now IGNORE NULLS) OVER w, 'idle') AS state, row_number() OVER w AS n_seen FROM s WINDOW w AS (PARTITION BY user_id ORDER BY message_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def dialog_states(spark: SparkSession, d: str) -> DataFrame:
    """Dialog state after every message, as a batch backfill."""
    return ingest.dialog_states_batch(table(spark, d, "history_messages"))


@query("SELECT section, key, value FROM (SELECT 'messages' AS section, message_type || '.n' AS key, count(*)::VARCHAR AS value FROM history_messages GROUP BY message_type)")
def message_report(spark: SparkSession, d: str) -> DataFrame:
    """Report rows of message counts per type."""
    n = table(spark, d, "history_messages", "message_type").groupBy("message_type").agg(F.count("*").alias("n"))
    return files.report_rows(n, "messages")
