"""Queries of streams whose state ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as T
from ..streaming import days as D
from ..streaming import monitor as M
from . import source_queries as S
from . import views as V


def probe_log(events: DataFrame) -> DataFrame:
    """Events as probes of the day they are on or of one of the two before."""
    day = F.date_sub(F.to_date("ts"), (F.col("event_id") % 3).cast("int"))
    return events.select(day.alias("target_date"), F.col("ts").alias("probe_time"), F.col("event_id").alias("probe_id"), (F.col("event_type") != "error").alias("is_complete"), F.floor(F.col("value")).cast("long").alias("raw_rows"))


def _last_complete(s: SparkSession, d: str) -> DataFrame:
    return M.drain(D.last_complete_stream(probe_log(M.event_stream(s, d))), T.shared_path(s, "last-complete"))


def _idle(s: SparkSession, d: str) -> DataFrame:
    return M.drain(M.completeness_stream(S._probes(M.event_stream(s, d)), 2, idle_days=2), T.shared_path(s, "completeness"))


def status_log(events: DataFrame) -> DataFrame:
    """Events as reports on the day they are on or one of the ten before: empty ones are common."""
    day = F.date_sub(F.to_date("ts"), (F.col("event_id") % 11).cast("int"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") < 10, "success").otherwise("empty")
    return events.where("user_id % 5 = 0").select(day.alias("day"), status.alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def _calendar(s: SparkSession, d: str) -> DataFrame:
    """The days of the events and of the month before, without Sundays."""
    e = V.table(s, d, "events").agg(F.date_sub(F.to_date(F.min("ts")), 30).alias("a"), F.date_add(F.to_date(F.max("ts")), 10).alias("z"))
    return e.select(F.explode(F.sequence("a", "z")).alias("day")).where("dayofweek(day) <> 1")


def _queue_at_end(s: SparkSession, d: str) -> DataFrame:
    found = D.reprocess_stream(status_log(M.event_stream(s, d)), _calendar(s, d), T.shared_path(s, "queue"))
    return found.join(F.broadcast(found.agg(F.max("batch").alias("batch"))), "batch").select("day", "priority")


QUERIES = {
    "t1_completeness_idle_stream": _idle,
    "t1_completeness_idle_batch": lambda s, d: M.completeness_batch(S._probes(V.table(s, d, "events")), 2, idle_days=2),
    "t4_reprocess_stream": _queue_at_end,
    "t4_reprocess_log": lambda s, d: D.reprocess_queue(status_log(V.table(s, d, "events")), _calendar(s, d)),
    "t7_last_complete_stream": _last_complete,
}

_IDLE = f"WITH {S._P}, gaps AS (SELECT *, coalesce((epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY key ORDER BY ts, probe_id) > 2 * 86400000)::INT, 0) AS gap FROM p), parts AS (SELECT *, sum(gap) OVER (PARTITION BY key ORDER BY ts, probe_id) AS part FROM gaps), h AS (SELECT *, NOT failed AND rows > 0 AS has, lag(NOT failed AND rows > 0) OVER w AS had, lag(mark) OVER w AS before FROM parts WINDOW w AS (PARTITION BY key, part ORDER BY ts, probe_id)), g AS (SELECT *, sum((NOT has OR NOT coalesce(had, false) OR before <> mark)::INT) OVER (PARTITION BY key, part ORDER BY ts, probe_id) AS run FROM h), c AS (SELECT *, (CASE WHEN has THEN row_number() OVER (PARTITION BY key, part, run ORDER BY ts, probe_id) ELSE 0 END)::INT AS stable FROM g), st AS (SELECT *, CASE WHEN failed THEN 'API_ERROR' WHEN NOT has THEN 'NO_DATA' WHEN stable >= 2 AND covered THEN 'COMPLETE' WHEN stable >= 2 THEN 'COVERAGE_TOO_LOW' WHEN stable > 1 THEN 'STABLE_WAITING' ELSE 'DATA_CHANGING' END AS status FROM c), d AS (SELECT *, coalesce(max((status = 'COMPLETE')::INT) OVER (PARTITION BY key, part ORDER BY ts, probe_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM st) SELECT key, probe_id, status, stable FROM d WHERE done = 0"
_QUEUE = """WITH log AS (SELECT ts::DATE - (event_id % 11)::INT AS day, CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 10 THEN 'success' ELSE 'empty' END AS status, ts AS seen, event_id AS seq FROM events WHERE user_id % 5 = 0),
  last AS (SELECT day, status FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY seen DESC, seq DESC) AS r FROM log) WHERE r = 1),
  expected AS (SELECT day::DATE AS day FROM (SELECT unnest(generate_series((SELECT min(ts)::DATE - 30 FROM events), (SELECT max(seen)::DATE FROM log), INTERVAL 1 DAY)) AS day) WHERE dayofweek(day) <> 0),
  late AS (SELECT day FROM expected ORDER BY day DESC LIMIT 5)
SELECT * FROM (SELECT e.day, CASE WHEN l.status = 'failed' THEN 0 WHEN l.status IS NULL THEN 1 WHEN l.status = 'empty' AND e.day IN (SELECT day FROM late) THEN 2 END AS priority FROM expected e LEFT JOIN last l USING (day)) WHERE priority IS NOT NULL"""
ORACLE_SQL = {
    "t1_completeness_idle_stream": _IDLE,
    "t1_completeness_idle_batch": _IDLE,
    "t4_reprocess_stream": _QUEUE,
    "t4_reprocess_log": _QUEUE,
    "t7_last_complete_stream": "WITH log AS (SELECT ts::DATE - (event_id % 3)::INT AS target_date, ts AS probe_time, event_id AS probe_id, event_type <> 'error' AS is_complete, floor(value)::BIGINT AS raw_rows FROM events) SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY target_date ORDER BY probe_time DESC, probe_id DESC) AS r FROM log WHERE is_complete) WHERE r = 1 AND target_date + 3 <= (SELECT max(target_date) FROM log)",
}
