"""Alert lifecycle and idempotent delivery, on streams and on tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

STATE = "status string, expires double, alert long"


def _step(state: tuple, action: str, at: float, seconds: float) -> tuple[tuple, str]:
    """The state (status, expiry, number of the alert) after one action, and what it did.

    A raise makes an alert unless one is ACTIVE; an ACTIVE one is EXPIRED once its time has
    come; only an ACTIVE one is acknowledged, and any that isn't closed is resolved.
    """
    status, expires, number = state
    if status == "ACTIVE" and expires <= at:
        status = "EXPIRED"
    if action == "raise":
        if status == "ACTIVE":
            return (status, expires, number), "suppressed"
        return ("ACTIVE", at + seconds, number + 1), "created"
    if action == "ack" and status == "ACTIVE":
        return ("ACKNOWLEDGED", expires, number), "acknowledged"
    if action == "resolve" and status in ("ACTIVE", "ACKNOWLEDGED"):
        return ("RESOLVED", expires, number), "resolved"
    return (status, expires, number), "ignored"


NEW = ("NONE", 0.0, 0)


def _schema(events: DataFrame) -> StructType:
    return StructType([*events.schema.fields, StructField("outcome", StringType()), StructField("alert", LongType())])


class _Lifecycle(StatefulProcessor):
    """A key's alert as value state; a timer at its expiry closes it and reports it."""

    def __init__(self, seconds: float, columns: list[str], keys: list[str]):
        self.seconds, self.columns, self.keys = seconds, columns, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("alert", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        state = tuple(self.value.get()) if self.value.exists() else NEW
        out = []
        for action, ts in zip(frame["action"], frame["ts"], strict=True):
            state, outcome = _step(state, action, ts.timestamp(), self.seconds)
            out.append((outcome, state[2]))
        self.value.update(state)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state[0] == "ACTIVE":
            self.handle.registerTimer(max(int(state[1] * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        frame["outcome"], frame["alert"] = [o for o, _ in out], [n for _, n in out]
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, expires, number = self.value.get()
        if status != "ACTIVE" or int(expires * 1000) > expiredTimerInfo.getExpiryTimeInMs():
            return
        self.value.update(("EXPIRED", expires, number))
        row = dict.fromkeys(self.columns) | dict(zip(self.keys, key, strict=True)) | {"ts": pd.Timestamp(expires, unit="s"), "outcome": "expired", "alert": number}
        yield pd.DataFrame([row])

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, keys: list[str], seconds: float, late: str = "1 hour") -> DataFrame:
    """Add outcome (created, suppressed, acknowledged, resolved, ignored) and alert, the number of the key's alert that an event concerns.

    events: (keys, ts, event_id, action 'raise', 'ack' or 'resolve', ...). On a stream a timer
    closes an alert that is still active when the watermark, `late` behind, passes its
    expiry, and a row with outcome `expired` says so; the table's form has no such rows. A
    table is sorted by key and time and read as a stream of batches, so a hot key's events
    are never held at once.
    """
    schema = _schema(events)
    if events.isStreaming:
        processor = _Lifecycle(seconds, [f.name for f in schema], keys)
        return events.withWatermark("ts", late).groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventTime")

    def table(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, NEW
        for frame in frames:
            outcome, number = [], []
            for key, action, ts in zip(frame[keys].itertuples(index=False, name=None), frame["action"], frame["ts"], strict=True):
                if key != last:
                    last, state = key, NEW
                state, did = _step(state, action, ts.timestamp(), seconds)
                outcome.append(did)
                number.append(state[2])
            frame["outcome"], frame["alert"] = outcome, number
            yield frame

    return events.repartition(*keys).sortWithinPartitions(*keys, "ts", "event_id").mapInPandas(table, schema)


def once(events: DataFrame, keys: list[str], time_to_live: str = "24 hours") -> DataFrame:
    """Events whose key wasn't seen within the time to live: the first delivery of a notification on a channel.

    A stream keeps a key until the watermark, a time to live behind the greatest time, has
    passed its first event by the time to live, so for at least that; rows later than the
    watermark are dropped. A table keeps an event unless a kept one of its key is less than
    the time to live before it (the time to live of a kept event isn't refreshed).
    """
    if events.isStreaming:
        return events.withWatermark("ts", time_to_live).dropDuplicatesWithinWatermark(keys)
    from .state import limited

    seconds = int(pd.Timedelta(time_to_live).total_seconds())
    return limited(events, keys, seconds, 1).where("passed").drop("passed")
