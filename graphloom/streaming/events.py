"""Streams of events as state machines. This goes beyond batch reports: counts by window with late data, and transitions by user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(start, event_type, n): events by tumbling window; what is later than `late` is dropped."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return own.select(F.col("window.start").alias("start"), "event_type", "n")


def _moves(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else "*"
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    out = []
    for e in rows.itertuples():
        out.append((f"user{key[0]}", last, e.event_type, int(e.event_id)))
        last = e.event_type
    state.update((last,))
    yield pd.DataFrame(out, columns=["entity", "from_state", "to_state", "event_id"])


def transitions(events: DataFrame) -> DataFrame:
    """(entity, from_state, to_state, event_id): each user's successive event types; the last one is kept between batches."""
    return events.groupBy("user_id").applyInPandasWithState(_moves, "entity string, from_state string, to_state string, event_id long", "last string", "append", GroupStateTimeout.NoTimeout)
