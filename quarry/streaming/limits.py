"""Stateful operators with time: a request limiter, and a queue that hands failed hosts out again later.

Both need the RocksDB state store, which the functions here ask the session for.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.crawl import RETRY_MOST_MS, RETRY_STEP_MS
from ..functions import limiting
from ..functions.limiting import allowed
from ..workers import ship

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ready(spark: SparkSession) -> None:
    """Workers get the package as everywhere; the driver's own Python worker for these operators does not, so their code travels by value."""
    ship(spark)
    for module in (limiting, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class Limiter(StatefulProcessor):
    """Of a key the last ``limit`` allowed times are kept, and go when no request came for ``ttl_ms``."""

    def __init__(self, limit: int, window_ms: int, ttl_ms: int, columns: list[str]):
        self.limit, self.window_ms, self.ttl_ms, self.columns = limit, window_ms, ttl_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "at long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.array(sorted(r[0] for r in self.times.get()), np.int64)
        for part in rows:  # a chunk at a time, each in order of time
            part = part.sort_values(["at", "request"], kind="stable")
            now = np.maximum(part["at"].to_numpy(np.int64), times[-1] if len(times) else np.iinfo(np.int64).min)  # time does not go back
            ok, times = allowed(now, times, self.limit, self.window_ms)
            yield part[self.columns].assign(allowed=ok)
        self.times.put([(int(t),) for t in times])

    def close(self) -> None:
        pass


def limited(requests: DataFrame, limit: int, window_ms: int, ttl_ms: int | None = None) -> DataFrame:
    """A stream of requests (key, at, request) with ``allowed``, as ``rate_limited`` gives it for stored ones.

    Requests count in the order of micro-batches, and in order of time within one.  ``ttl_ms`` is
    how long a silent key is remembered by the machines' clock: 60 windows unless given, as
    a stream may lag behind the times of its requests.  Spark goes on with batches without
    data for that clock; a query that shall end when its input does needs spark.sql.streaming.noDataMicroBatches.enabled off.
    """
    if limit <= 0 or window_ms <= 0:
        from pyspark.sql import functions as F

        return requests.withColumn("allowed", F.lit(True))
    _ready(requests.sparkSession)
    from pyspark.sql.types import BooleanType, StructField, StructType

    return requests.groupBy("key").transformWithStateInPandas(
        Limiter(limit, window_ms, ttl_ms or 60 * window_ms, requests.columns), StructType([*requests.schema.fields, StructField("allowed", BooleanType())]), "append", "processingTime"
    )


class Backoff(StatefulProcessor):
    """Counts a host's failures in a row; each sets the one timer of the host anew, a success clears it."""

    def __init__(self, event_time: bool):
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.errors = handle.getValueState("errors", "errors int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.errors.get()
        errors = held[0] if held is not None else 0
        due, touched = None, False
        for part in rows:
            for at, ok in part.sort_values("at")[["at", "ok"]].itertuples(index=False):
                touched = True
                errors = 0 if ok else errors + 1
                now = int(at.timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
                due = None if ok else now + min(errors * RETRY_STEP_MS, RETRY_MOST_MS)
        if touched:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
            self.errors.update((errors,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.errors.get()
        yield pd.DataFrame({"host": [key[0]], "due_at": [expiredTimerInfo.getExpiryTimeInMs()], "errors": [held[0] if held is not None else 0]})

    def close(self) -> None:
        pass


def retries(results: DataFrame, event_time: bool = False) -> DataFrame:
    """A stream of reads (host, at timestamp, ok) to a stream of hosts that are due again (host, due_at, errors).

    A host that failed n times in a row comes back after n times RETRY_STEP_MS, RETRY_MOST_MS at
    most, once a failure; one that succeeded does not.  Time is the machines' clock, or
    with ``event_time`` the watermark of ``at``, which the stream must then have.
    """
    _ready(results.sparkSession)
    return results.groupBy("host").transformWithStateInPandas(Backoff(event_time), "host string, due_at long, errors int", "append", "eventTime" if event_time else "processingTime")
