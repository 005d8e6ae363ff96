"""Streams of job events: states with timeouts, doubles, incoming files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import ITEM_MOVES


def once(events: DataFrame, key: str = "event_id", lateness: str = "10 minutes") -> DataFrame:
    """Each event once, by key, within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def per_window(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events and their mean value by type and window."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def item_states(events: DataFrame, timeout: str | None = "120 seconds") -> DataFrame:
    """(item_id, status, illegal, requeued): the state of each item after its events (item_id, ts, status).

    Illegal moves are counted and ignored. An item in work without an event
    until the timeout goes back to pending.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, illegal = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.update(("pending", illegal))
            yield pd.DataFrame([(key[0], "pending", illegal, True)], columns=["item_id", "status", "illegal", "requeued"])
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        for s in rows["status"]:
            if status is None or s == status or s in ITEM_MOVES.get(status, ()):
                status = s
            else:
                illegal += 1
        state.update((status, illegal))
        if status == "processing" and timeout:
            state.setTimeoutDuration(timeout)
        yield pd.DataFrame([(key[0], status, illegal, False)], columns=["item_id", "status", "illegal", "requeued"])

    return events.groupBy("item_id").applyInPandasWithState(
        update, "item_id long, status string, illegal long, requeued boolean", "status string, illegal long", "update", GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    )


def inbox(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def run_available(stream: DataFrame, sink: str, name: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there, then stop: an incremental batch."""
    query = stream.writeStream.format(sink).queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
