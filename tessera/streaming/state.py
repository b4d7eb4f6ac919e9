"""Stateful rules over event streams; each works on a stream and on a table alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_rollup(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day and type; on a stream, days close one watermark later."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ts.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def _decide(times: list[float], seconds: float, most: int, start: float | None, count: int):
    """Fixed windows that start at the first event: which events pass, and the state left."""
    out = []
    for t in times:
        if start is None or t - start >= seconds:
            start, count = t, 0
        count += 1
        out.append(count <= most)
    return out, start, count


def limited(events: DataFrame, keys: list[str], seconds: int, most: int, late: str = "1 hour") -> DataFrame:
    """Add `passed`: at most `most` events of a key in a window of `seconds` from its first event.

    With most = 1 this is first-wins de-duplication whose time to live isn't refreshed. A table is
    sorted by key and time and read as a stream of batches, so a hot key's events are never held at
    once. On a stream the state of a key goes when the watermark, `late` behind (and never before 1970),
    has passed its window; events that aren't after the watermark are late and dropped.
    """
    schema = StructType([*events.schema.fields, StructField("passed", BooleanType())])

    def table(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, count = None, None, 0
        for frame in frames:
            passed = []
            for key, t in zip(frame[keys].astype(object).where(frame[keys].notna(), None).itertuples(index=False, name=None), frame["ts"], strict=True):
                if key != last:
                    last, start, count = key, None, 0
                one, start, count = _decide([t.timestamp()], seconds, most, start, count)
                passed += one
            frame["passed"] = passed
            yield frame

    def stream(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        frame = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        frame["passed"], start, count = _decide([t.timestamp() for t in frame["ts"]], seconds, most, start, count)
        state.update((start, count))
        state.setTimeoutTimestamp(max(int((start + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield frame

    if events.isStreaming:
        return events.withWatermark("ts", late).groupBy(*keys).applyInPandasWithState(stream, schema, "start double, count long", "append", GroupStateTimeout.EventTimeTimeout)
    return events.repartition(*keys).sortWithinPartitions(*keys, "ts", "event_id").mapInPandas(table, schema)
