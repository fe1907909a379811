"""Interaction events in batch: validation, idempotent dedup, clamped per-video signals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.limiting import allowed
from ..workers import ship

KEY = ["video_uuid", "instance_domain"]


def reject_reason() -> Column:
    blank = lambda c: S.clean_text(c).isNull()
    return (
        F.when(blank("event_id"), "no event_id").when(blank("event_type"), "no event_type").when(~F.col("event_type").isin(*S.EVENT_DELTAS), "unsupported event_type")
        .when(blank("video_uuid"), "no video_uuid").when(blank("instance_domain"), "no instance_domain")
    )


def normalised(payloads: DataFrame, now_ms: int) -> DataFrame:
    """Events of JSON payloads (payload, arrival): trimmed texts, the object's fields, and now for a time that is no whole number."""
    get = lambda path: S.clean_text(F.get_json_object("payload", path))
    raw = F.get_json_object("payload", "$.raw_payload")
    return payloads.select(
        get("$.event_id").alias("event_id"), "arrival", get("$.event_type").alias("event_type"), get("$.actor_id").alias("actor_id"), get("$.object.video_uuid").alias("video_uuid"),
        get("$.object.instance_domain").alias("instance_domain"), get("$.object.canonical_url").alias("canonical_url"), get("$.source_instance").alias("source_instance"),
        F.coalesce(get("$.published_at").try_cast("long"), F.lit(now_ms)).alias("published_at"), F.when(F.ltrim(raw).startswith("{"), raw).otherwise("{}").alias("raw_payload_json"),
    )


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejects with reason); a bad row never stops the others."""
    judged = events.withColumn("reason", reject_reason())
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def first_arrivals(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row for each event_id, the first to arrive, none that is stored.  Copies of one event are reduced before the shuffle.

    Of what is stored only ids are read, and first cut to those of the batch: a small batch is
    broadcast for that, for a large one Spark builds a Bloom filter of its ids that stored ids
    pass before they are shuffled.  So the anti join meets repeats only.
    """
    one = events.groupBy("event_id").agg(F.min_by(F.struct(*events.columns), "arrival").alias("_e")).select("_e.*")
    if stored is None:
        return one
    repeats = stored.select("event_id").join(one.select("event_id"), "event_id", "left_semi")
    return one.join(repeats, "event_id", "left_anti")


def latest(signals: DataFrame) -> DataFrame:
    """Of the rows of a video's counters the last written."""
    order = W.partitionBy(*KEY).orderBy(F.desc_nulls_last("version"), F.desc_nulls_last("updated_at"))
    return signals.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")


#: Arrival numbers that one slice of a video's events spans.
SLICE = 100_000
COUNTERS = ["likes_count", "undo_likes_count", "comments_count", "signal_score"]


def signals(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Counters of each video after its events in order of arrival, on top of stored ones.

    The first event of a video that has no counters sets them, below zero too; each
    later one adds and clamps at zero.  With running sums S on top of x the result
    is x + S_n - min(0, x + S_1, ..., x + S_n), without S_1 where it sets, so no row
    is folded one by one.  Sums and least running sums of slices of arrival numbers
    compose, so a video with very many events is dealt over its slices.
    """
    slices = W.partitionBy(*KEY, "_slice")
    df = events.withColumn("_slice", F.expr(f"cast(arrival as bigint) div {SLICE}L")).select(*KEY, "_slice", "arrival", *[S.event_delta("event_type", k).alias(c) for k, c in enumerate(COUNTERS)])
    order = slices.orderBy("arrival")
    df = df.withColumn("_n", F.row_number().over(order)).withColumns({f"_s{k}": F.sum(c).over(order) for k, c in enumerate(COUNTERS)})
    parts = df.groupBy(*KEY, "_slice").agg(
        F.max("arrival").alias("last_arrival"), *[F.sum(c).alias(f"t{k}") for k, c in enumerate(COUNTERS)],
        *[F.min(f"_s{k}").alias(f"m{k}") for k in range(4)], *[F.min(F.when(F.col("_n") > 1, F.col(f"_s{k}"))).alias(f"f{k}") for k in range(4)],
    )
    before = W.partitionBy(*KEY).orderBy("_slice")
    parts = parts.withColumn("_first", F.row_number().over(before) == 1)
    earlier = before.rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({f"b{k}": F.coalesce(F.sum(f"t{k}").over(earlier), F.lit(0)) for k in range(4)})
    done = parts.groupBy(*KEY).agg(
        F.max("last_arrival").alias("last_arrival"), *[F.sum(f"t{k}").alias(f"t{k}") for k in range(4)],
        *[F.min(F.col(f"b{k}") + F.col(f"m{k}")).alias(f"m{k}") for k in range(4)],
        *[F.min(F.col(f"b{k}") + F.when(F.col("_first"), F.col(f"f{k}")).otherwise(F.col(f"m{k}"))).alias(f"f{k}") for k in range(4)],
    )
    if stored is None:
        old = {c: F.lit(0) for c in COUNTERS}
        has = F.lit(False)
    else:
        done = done.join(stored.select(*KEY, *[F.col(c).alias(f"_old_{c}") for c in COUNTERS], F.lit(True).alias("_has")), KEY, "left")
        old = {c: F.coalesce(f"_old_{c}", F.lit(0)) for c in COUNTERS}
        has = F.coalesce("_has", F.lit(False))
    value = lambda k, c: old[c] + F.col(f"t{k}") - F.least(F.lit(0), F.coalesce(old[c] + F.when(has, F.col(f"m{k}")).otherwise(F.col(f"f{k}")), F.lit(0)))
    return done.select(*KEY, *[value(k, c).cast("double" if c == "signal_score" else "long").alias(c) for k, c in enumerate(COUNTERS)], "last_arrival")


def ingest(events: DataFrame, stored_events: DataFrame, stored_signals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new events, counters of the videos they touch, rejects): a batch with arrival numbers on top of what is stored."""
    good, bad = split(events)
    new = first_arrivals(good, stored_events)
    return new, signals(new, stored_signals), bad


def recent_likes(likes: DataFrame, limit: int, per: str = "user_id") -> DataFrame:
    """Each user's latest likes: one row a video, newest first, limit at most (all if limit <= 0)."""
    latest = likes.withColumn("_rn", F.row_number().over(W.partitionBy(per, "video_id", "instance_domain").orderBy(F.desc("updated_at"), F.desc("event_id")))).where("_rn = 1")
    ranked = latest.withColumn("position", F.row_number().over(W.partitionBy(per).orderBy(F.desc("updated_at"), F.desc("event_id")))).drop("_rn")
    return ranked.where(F.col("position") <= limit) if limit > 0 else ranked


def record_likes(stored: DataFrame, new: DataFrame, limit: int) -> DataFrame:
    return recent_likes(stored.unionByName(new), limit).drop("position")


def remove_likes(stored: DataFrame, gone: DataFrame) -> DataFrame:
    return stored.join(gone.select("user_id", "video_id", "instance_domain"), ["user_id", "video_id", "instance_domain"], "left_anti")


def clear_likes(stored: DataFrame, users: DataFrame) -> DataFrame:
    """Without any like of these users."""
    return stored.join(users.select("user_id"), "user_id", "left_anti")


def published(actions: DataFrame) -> DataFrame:
    """User actions (action_id, user_id, action, video_uuid, instance_domain, at) as events; unknown actions give none."""
    return actions.withColumn("event_type", S.action_event("action")).where("event_type is not null").select(F.concat(F.lit("evt-"), F.col("action_id")).alias("event_id"), "event_type", F.col("user_id").alias("actor_id"), *KEY, F.col("at").alias("published_at"))


def _stretches(requests: DataFrame, window_ms: int) -> DataFrame:
    """requests with _stretch: it changes where a key has no request for a window, as nothing before counts there.

    Gaps that long lie between stretches of time of one window's length, so they follow
    from the first and last request in each, which are aggregated before anything is ordered.
    """
    slot = F.expr(f"at div {window_ms}L")
    ends = requests.withColumn("_slot", slot).groupBy("key", "_slot").agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    order = W.partitionBy("key").orderBy("_slot")
    new = F.coalesce(F.col("_first") - F.lag("_last").over(order) >= window_ms, F.lit(True))
    ends = ends.withColumn("_new", new.cast("int")).select(F.col("key").alias("_key"), "_slot", F.sum("_new").over(order).alias("_stretch"))
    same = (F.col("key") == F.col("_key")) & (F.col("_slot") == F.col("_of"))
    return requests.withColumn("_slot", slot).join(ends.withColumnRenamed("_slot", "_of"), same).drop("_key", "_of", "_slot")


def rate_limited(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """requests (key, at, request) with allowed: fewer than limit allowed ones in the last window; all, if limit or window is not positive.

    Refused requests do not count.  Keys are dealt with by stretches without a gap of a window's
    length, in time order, some rows at a time; what is kept between them is the last
    limit allowed times.  A request without key or time is refused.
    """
    if limit <= 0 or window_ms <= 0:
        return requests.withColumn("allowed", F.lit(True))
    ship(requests.sparkSession)
    known, columns = F.col("key").isNotNull() & F.col("at").isNotNull(), requests.columns
    dealt = _stretches(requests.where(known), window_ms).repartition("key", "_stretch").sortWithinPartitions("key", "_stretch", "at", "request")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, times = None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("at").to_numpy(zero_copy_only=False)
            stretch, key = batch.column("_stretch").to_numpy(zero_copy_only=False), batch.column("key").dictionary_encode()
            code = key.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (stretch[1:] != stretch[:-1])))
            ok = np.zeros(batch.num_rows, bool)
            for lo, hi in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                own = (key.dictionary[int(code[lo])].as_py(), int(stretch[lo]))
                if own != group:
                    group, times = own, np.zeros(0, np.int64)
                ok[lo:hi], times = allowed(at[lo:hi], times, limit, window_ms)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(ok)], [*columns, "allowed"])

    from pyspark.sql.types import BooleanType, StructField, StructType

    out = dealt.mapInArrow(fold, StructType([*requests.schema.fields, StructField("allowed", BooleanType())]))
    return out.unionByName(requests.where(~known).withColumn("allowed", F.lit(False)))
