"""Streams of events: an extension beside the batch operators, for usage events and clicks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds of usage event.
EVENT_KINDS = [
    "sign_select", "filter_category_toggle", "filter_toggle_all", "filter_mode_switch", "filter_signid_toggle", "filter_signid_bulk", "filter_signid_clear",
    "filter_signid_only", "filter_signid_hide", "filter_signid_unhide", "locale_switch", "theme_change", "info_open", "map_init_failed",
]


def event_stream(spark: SparkSession, path: str, glob: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream, with an event time that watermarks accept."""
    schema = spark.read.parquet(f"{path}/{glob}").schema
    return with_event_time(spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path))


def with_event_time(events: DataFrame) -> DataFrame:
    """``events`` with ``at``, the zone-free ``ts`` as a timestamp."""
    return events.withColumn("at", F.col("ts").cast("timestamp"))


def usage_events(events: DataFrame) -> DataFrame:
    """Events of a known kind with a place in time; others are dropped.  Batch or stream."""
    return events.where(F.col("event_type").isin(EVENT_KINDS) & F.col("at").isNotNull())


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value per kind and window; batch or stream."""
    timed = events.withWatermark("at", late) if events.isStreaming else events
    counts = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per overlapping window."""
    timed = events.withWatermark("at", late) if events.isStreaming else events
    counts = timed.groupBy(F.window("at", width, step).alias("w")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: start, last event and number of events."""
    timed = events.withWatermark("at", late) if events.isStreaming else events
    s = timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
    return s.select("user_id", F.col("w.start").alias("start"), "last_at", "n")


def debounced(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The last event of each user before a pause of ``gap``: what a debounced input lets through."""
    timed = events.withWatermark("at", late) if events.isStreaming else events
    last = F.max(F.struct("at", "event_id", "event_type")).alias("e")
    return timed.groupBy("user_id", F.session_window("at", gap)).agg(last).select("user_id", "e.event_id", "e.event_type", "e.at")


def click_cycle_stream(events: DataFrame, cycle: int = 3) -> DataFrame:
    """(event_id, user_id, cycle_index): clicks on one kind in a row step through ``cycle`` hits, kept per user across batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, index = state.get if state.exists else (None, -1)
        out = []
        rows = [r for frame in frames for r in frame[["at", "event_id", "event_type"]].itertuples(index=False, name=None)]
        for _, event_id, event_type in sorted(rows, key=lambda r: r[:2]):  # one user's clicks of one batch
            index = (index + 1) % cycle if event_type == last else 0
            last = event_type
            out.append((event_id, key[0], index))
        state.update((last, index))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "cycle_index"])

    return events.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, cycle_index int", "last string, i int", "append", "NoTimeout")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into Parquet and return the written rows."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
