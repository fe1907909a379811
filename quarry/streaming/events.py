"""Interaction signals by Structured Streaming.

``applyInPandasWithState`` keeps for each video the clamped counters and the
event ids of the stream are deduplicated before (``dropDuplicates``; with a
watermark ``dropDuplicatesWithinWatermark`` bounds that state, at the price that
a repeat later than the watermark counts again).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import EVENT_DELTAS
from ..workers import ship

EVENTS = "event_id string, arrival long, event_type string, video_uuid string, instance_domain string"
SIGNALS = "video_uuid string, instance_domain string, likes_count long, undo_likes_count long, comments_count long, signal_score double, version long"
_STATE = "likes long, undone long, comments long, score double, seen long"
_DELTAS = dict(EVENT_DELTAS)


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = list(state.get) if state.exists else [0, 0, 0, 0.0, 0]
    rows = pd.concat(list(batches)).sort_values("arrival")  # a video's events of one micro-batch
    for kind in rows["event_type"]:
        deltas = _DELTAS[kind]
        for k, d in enumerate(deltas):
            now[k] = d if now[4] == 0 else max(0, now[k] + d)
        now[4] += 1
    state.update((int(now[0]), int(now[1]), int(now[2]), float(now[3]), int(now[4])))
    yield pd.DataFrame([(*key, int(now[0]), int(now[1]), int(now[2]), float(now[3]), int(now[4]))], columns=[c.split()[0] for c in SIGNALS.split(", ")])


def signals(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """A stream of valid events to a stream of each video's new signals; ``version`` counts its events."""
    one = events.withWatermark("published", watermark).dropDuplicatesWithinWatermark(["event_id"]) if watermark else events.dropDuplicates(["event_id"])
    return one.groupBy("video_uuid", "instance_domain").applyInPandasWithState(_fold, SIGNALS, _STATE, "update", GroupStateTimeout.NoTimeout)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the folder that driver and executors share; one of this machine only where the session runs on it alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared.rstrip('/') if shared else 'file://' + tempfile.mkdtemp(prefix='quarry-')}/{name}-{uuid.uuid4().hex}"


def _writer(folder: str):
    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def run(events: DataFrame, folder: str) -> DataFrame:
    """Run the stream until its input ends; the latest signals of every video."""
    spark = events.sparkSession
    ship(spark)
    query = signals(events).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query = query.foreachBatch(_writer(f"{folder}/out")).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    out = spark.read.parquet(f"{folder}/out")
    last = out.groupBy("video_uuid", "instance_domain").agg(F.max_by(F.struct("likes_count", "undo_likes_count", "comments_count", "signal_score"), "version").alias("s"))
    return last.select("video_uuid", "instance_domain", "s.*")


def replay(events: DataFrame) -> DataFrame:
    """Stored events as a stream, the earlier half of arrivals before the later: what batch and stream must agree on."""
    spark, folder = events.sparkSession, shared_folder(events.sparkSession, "stream")
    cut = events.agg(F.expr("percentile_approx(arrival, 0.5)")).first()[0] or 0
    columns = [c.split()[0] for c in EVENTS.split(", ")]
    out = None
    for late in (False, True):  # files of one half may come in any order: a micro-batch is sorted as a whole
        part = events.where(F.col("arrival") > cut if late else F.col("arrival") <= cut)
        part.select(*columns).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{folder}/in")
        out = run(stream, folder)
    return out
