"""The request limiter in batch and as a stream, and the queue with backoff, against plain folds."""

import random
from collections import deque
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import events as E
from quarry.streaming import limits

REQUESTS = "key string, at long, request long"


def plain(rows, limit, window):
    """The deque of every key, row by row."""
    out, kept = {}, {}
    for key, at, request in sorted(rows):
        times = kept.setdefault(key, deque())
        while times and times[0] <= at - window:
            times.popleft()
        out[request] = limit <= 0 or window <= 0 or len(times) < limit
        if out[request]:
            times.append(at)
    return out


def made(seed, n=900):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 3, 20, 20, 400, 2500])
        rows.append((rng.choice(["a", "a", "a", "b", "c"]), at, i))
    return rows


def test_skipping_finds_the_same():
    rng = np.random.default_rng(3)
    for limit, window, n in ((1, 7, 300), (2, 50, 400), (5, 1000, 300), (60, 40, 500)):
        at = np.sort(rng.integers(0, 2000, n))
        want = list(plain([("k", int(t), i) for i, t in enumerate(at)], limit, window).values())
        assert E.allowed(at, np.zeros(0, np.int64), limit, window)[0].tolist() == want
        got, times = [], np.zeros(0, np.int64)
        for part in np.array_split(at, 7):  # the same in parts
            ok, times = E.allowed(part, times, limit, window)
            got += ok.tolist()
        assert got == want and len(times) <= limit


@pytest.mark.parametrize("limit,window", [(1, 30), (3, 1000), (4, 2500), (0, 10), (2, 0)])
def test_limiter_in_batch(spark, limit, window):
    rows = made(limit + window)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = E.rate_limited(spark.createDataFrame(rows, REQUESTS).withColumn("other", F.lit("x")).repartition(3), limit, window).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["request"]: r["allowed"] for r in got} == plain(rows, limit, window) and got[0]["other"] == "x"


def test_limiter_edges(spark):
    df = spark.createDataFrame([(None, 1, 1), ("a", None, 2), ("a", 5, 3)], REQUESTS)
    assert {r["request"]: r["allowed"] for r in E.rate_limited(df, 3, 10).collect()} == {1: False, 2: False, 3: True}
    assert E.rate_limited(df.limit(0), 3, 10).count() == 0


def test_limiter_as_a_stream(spark, tmp_path):
    """Several micro-batches, and a query that starts again from its checkpoint: state goes on."""
    rows = sorted(made(9, 300), key=lambda r: (r[1], r[2]))
    want, got = plain(rows, 3, 1000), {}
    no_data = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(no_data, "false")
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = limits.limited(spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in")), 3, 1000)
        out = str(tmp_path / "out")
        query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        got = {r["request"]: r["allowed"] for r in spark.read.parquet(out).collect()}
    spark.conf.unset(no_data)
    assert got == want


def test_backoff(spark, tmp_path):
    """Event time as a clock that the test moves: a host comes back after 5 s, 10 s, ... 30 s, and not after a success."""
    start = datetime(2024, 1, 1, tzinfo=UTC)
    schema = "host string, at timestamp, ok boolean"

    def step(rows):
        spark.createDataFrame([(h, start + timedelta(seconds=s), ok) for h, s, ok in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = limits.retries(spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("at", "0 seconds"), event_time=True)
        query = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        out = spark.read.schema("host string, due_at long, errors int").parquet(str(tmp_path / "out")).collect()
        return sorted((r["host"], r["due_at"] // 1000 - int(start.timestamp()), r["errors"]) for r in out)

    assert step([("a", 0, False), ("b", 0, False), ("c", 0, False)]) == []
    assert step([("b", 2, True), ("x", 4, True)]) == []  # a and c are not due yet, b succeeded
    one = [("a", 5, 1), ("c", 5, 1)]
    assert step([("x", 6, True)]) == one
    assert step([("a", 7, False), ("x", 16, True)]) == one  # the second failure waits 10 s
    two = [*one, ("a", 17, 2)]
    assert step([("x", 18, True)]) == sorted(two)
    assert step([("a", 20 + k, False) for k in range(6)] + [("x", 54, True)]) == sorted(two)  # the eighth: 30 s from second 25
    assert step([("x", 56, True)]) == sorted([*two, ("a", 55, 8)])
