"""Keyed state: exact sliding-window rate limit and task rows with a time to live, as stateful processors on RocksDB."""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT, WINDOW_SECONDS, TASK_TTL_SECONDS = 60, 60, 86_400
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT_ROWS = 50_000


def _processed(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    """``transformWithState`` needs the RocksDB store; the session's setting holds for the queries started after it."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return df.groupBy(key).transformWithStateInPandas(processor, schema, mode, "eventTime")


class RateLimiter(StatefulProcessor):
    """Accepted times of a client in a list state. A timer clears the state of a client that is idle for a window."""

    def __init__(self, limit: int, window: int):
        self.limit, self.span = limit, window * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # two numbers a request are held, to decide in order of time whatever the order of arrival
        us, ids = array("q"), array("q")
        for part in rows:
            us.frombytes(part["us"].to_numpy("int64").tobytes())
            ids.frombytes(part["request_id"].to_numpy("int64").tobytes())
        us, ids = np.frombuffer(us, np.int64), np.frombuffer(ids, np.int64)
        order = np.lexsort((ids, us))
        us, ids = us[order], ids[order]
        live = deque(sorted(t for (t,) in self.times.get()))
        for lo in range(0, len(us), _OUT_ROWS):
            part = us[lo:lo + _OUT_ROWS]
            allowed, left = np.zeros(len(part), bool), np.zeros(len(part), np.int32)
            for i, now in enumerate(part.tolist()):
                while live and live[0] <= now - self.span:
                    live.popleft()
                if len(live) < self.limit:
                    live.append(now)
                    allowed[i] = True
                left[i] = self.limit - len(live)
            yield pd.DataFrame({"client": key[0], "ts": pd.to_datetime(part, unit="us"), "request_id": ids[lo:lo + _OUT_ROWS], "allowed": allowed, "remaining": left})
        self.times.put([(t,) for t in live])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = int(us[-1]) if len(us) else 0
        self.handle.registerTimer(max((last + self.span) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit(requests: DataFrame, limit: int = LIMIT, window: int = WINDOW_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """(client, ts, request_id) to (client, ts, request_id, allowed, remaining).

    State per client is at most ``limit`` accepted times; rejected requests are not recorded.  The state of an idle client ends one window
    after its last request.  Of a client's requests in one batch a task holds two numbers each, never the rows.
    """
    src = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return _processed(src.select("client", "ts", "request_id", F.unix_micros("ts").alias("us")), "client", RateLimiter(limit, window),
                      "client long, ts timestamp, request_id long, allowed boolean, remaining int", "append")


class TaskRows(StatefulProcessor):
    """First and last update of a task in a value state; a timer, moved by every update, ends a task without updates."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "created bigint, updated bigint, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        created, updated, status = self.row.get() or (None, None, None)
        for part in rows:
            at = int(part["us"].to_numpy().argmax()) if updated is None or part["us"].max() >= updated else None
            created = int(part["us"].min()) if created is None else min(created, int(part["us"].min()))
            if at is not None:
                same = part.loc[part["us"] == part["us"].iloc[at], "status"]
                updated, status = int(part["us"].iloc[at]), same.iloc[-1]
        self.row.update((created, updated, status))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(updated // 1000 + self.ttl * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"task_id": [key[0]], "created": [created], "updated": [updated], "status": [status]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        created, updated, _ = self.row.get()
        self.row.clear()
        yield pd.DataFrame({"task_id": [key[0]], "created": [created], "updated": [updated], "status": ["expired"]})

    def close(self) -> None:
        pass


def task_rows(updates: DataFrame, ttl: int = TASK_TTL_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """(task_id, ts, status) updates to current rows; a task without updates for ``ttl`` is expired.  Rows are folded as they come."""
    src = updates.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return _processed(src.select("task_id", "ts", "status", F.unix_micros("ts").alias("us")), "task_id", TaskRows(ttl),
                      "task_id long, created long, updated long, status string", "update")
