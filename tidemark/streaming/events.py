"""Event-time aggregation, keep-last upserts and per-key folds on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.schemas import EVENTS
from ..sources.sinks import upsert_by_year
from ..sources.tables import ship


def read_events(spark: SparkSession, path: str, late: str = "2 hours", files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream of events with a watermark ``late`` behind the newest event time."""
    ship(spark)
    e = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_totals(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """Count and total per event type and window. State is dropped, and later rows with it, once the watermark passes a window."""
    return (
        events.groupBy(F.window("ts", length).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event id once; ids are remembered until the watermark passes them."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


_RUN_OUT = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("streak", T.LongType()), T.StructField("longest", T.LongType())])


#: A user whose last event is older than this, against the watermark, is forgotten.
IDLE_MS = 30 * 24 * 3600 * 1000


def _streaks(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    n, streak, longest, last = state.get if state.exists else (0, 0, 0, float("-inf"))
    newest = 0
    for b in batches:
        b = b.sort_values(["ts", "event_id"])
        v = np.r_[last, b["value"].to_numpy(float)]
        at = np.arange(1, len(v))
        fall = np.maximum.accumulate(np.where(v[1:] > v[:-1], -streak, at))  # the last row that did not rise; before any, the carried streak
        run = at - fall
        n, streak, longest, last = n + len(at), int(run[-1]), max(longest, int(run.max())), float(v[-1])
        newest = max(newest, int(b["ts"].max().timestamp() * 1000))
    state.update((n, streak, longest, last))
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + IDLE_MS)
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "streak": [streak], "longest": [longest]})


def rising_streaks(events: DataFrame) -> DataFrame:
    """Per user the present and the longest run of rising values, carried from batch to batch. Within a batch rows count in the order of time.
    The state of a user without events for ``IDLE_MS`` of event time is dropped."""
    return events.groupBy("user_id").applyInPandasWithState(
        _streaks, _RUN_OUT, "n long, streak long, longest long, last double", "update", GroupStateTimeout.EventTimeTimeout
    )


def upsert_bars(stream: DataFrame, path: str, checkpoint: str):
    """Writes a stream of bars as keep-last upserts. A batch that is repeated after a failure gives the same folder."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert_by_year(batch, path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
