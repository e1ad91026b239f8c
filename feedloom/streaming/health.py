"""Fetch health as state: failures in a row of each feed, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from feedloom.operators.entries import streaks

#: Failures in a row from which a domain backs off.
DOMAIN_AFTER = 3


def current(events: DataFrame, key: str, failed: Column) -> DataFrame:
    """Each key's failures in a row after its last event."""
    run = streaks(events, key, [F.asc("ts"), F.asc("event_id")], failed)
    last = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    now = run.withColumn("r", F.row_number().over(last)).where("r = 1")
    return now.select(key, "streak", (F.col("streak") >= DOMAIN_AFTER).alias("backing_off"))


def streaming(events: DataFrame) -> DataFrame:
    """The same as a stream over (user_id, ts, event_id, event_type): an updated row for each key of a micro-batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        for kind in pd.concat(list(batches)).sort_values(["ts", "event_id"]).event_type:
            streak = streak + 1 if kind == "error" else 0
        state.update((streak,))
        yield pd.DataFrame({"user_id": [key[0]], "streak": [streak], "backing_off": [streak >= DOMAIN_AFTER]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, streak long, backing_off boolean", "streak long", "update", GroupStateTimeout.NoTimeout)


def usage(events: DataFrame, width: str = "1 hour", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls in sliding windows, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "user_id").agg(F.count("*").alias("calls"))
