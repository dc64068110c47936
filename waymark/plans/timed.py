"""Queries of streams whose results come by timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans.registry import query
from waymark.plans.staging import Stage
from waymark.streaming import events as streams
from waymark.streaming import timers

_RUN = """a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) run FROM a),
r AS (SELECT user_id, run, min(ts) AS start, max(ts) last_at, count(*) n, arg_max(event_id, (ts, event_id)) event_id, arg_max(event_type, (ts, event_id)) event_type FROM b GROUP BY 1, 2),
closed AS (SELECT * FROM r WHERE last_at + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)"""


def _run(spark: SparkSession, d: str, name: str, stream) -> DataFrame:
    folder = Stage(spark, name).folder
    with timers.timer_store(spark):
        return streams.run_to_table(stream(streams.event_stream(spark, d)), f"{folder}/out", f"{folder}/checkpoint")


@query(f"WITH {_RUN} SELECT user_id, event_id, event_type FROM closed")
def debounced_by_timer(spark: SparkSession, d: str) -> DataFrame:
    """What a debounced input lets through, each event when its timer is up."""
    return _run(spark, d, "debounced", timers.debounced_stream)


@query(f"WITH {_RUN} SELECT user_id, start, last_at, n FROM closed")
def runs_by_timer(spark: SparkSession, d: str) -> DataFrame:
    """Every user's closed runs of events."""
    r = _run(spark, d, "runs", timers.runs_stream)
    return r.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "n")
