"""Crawl bookkeeping as table operators: work lists, progress, sweeps, state, queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .tables import count_errors, first_by, patch, rebuild_content

# Fixed values
RETRY_STEP_MS, RETRY_MOST_MS = 5_000, 30_000
NO_TAGS = "[]"


def work_list(videos: DataFrame, kind: str) -> DataFrame:
    """Valid videos with a uuid that a sweep has to visit: tags_missing, tags_present, comments_missing or comments (all)."""
    tagged = F.col("tags_json").isNotNull() & (F.col("tags_json") != NO_TAGS)
    wanted = {"tags_missing": ~tagged, "tags_present": tagged, "comments_missing": F.col("comments_count").isNull(), "comments": F.lit(True)}[kind]
    return videos.where(F.col("video_uuid").isNotNull() & F.col("invalid_reason").isNull() & wanted).select("video_id", "video_uuid", "instance_domain")


def enriched(videos: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """A sweep's results (keys, column) put into videos, whose errors they end."""
    keys = ["video_id", "instance_domain"]
    done = found.select(*keys, column, F.lit(0).alias("error_count"), F.lit(None).cast("string").alias("last_error"))
    return patch(videos, done, keys, [column, "error_count", "last_error"])


def failed(videos: DataFrame, failures: DataFrame) -> DataFrame:
    """A sweep's failures (keys, message): counted, and the reason where a video cannot be used."""
    keys = ["video_id", "instance_domain"]
    reasons = failures.withColumn("invalid_reason", S.failure_reason("message")).where("invalid_reason is not null").groupBy(*keys).agg(F.max("invalid_reason").alias("invalid_reason"))
    return patch(count_errors(videos, failures, keys), reasons, keys, ["invalid_reason"])


def progress_for(progress: DataFrame, work: DataFrame, keys: Sequence[str], resume: bool = True) -> DataFrame:
    """(keys, status, error_count): what is in work, pending where it is new; without resume all begin anew."""
    fresh = work.select(*keys).distinct()
    if not resume:
        return fresh.select(*keys, F.lit("pending").alias("status"), F.lit(0).alias("error_count"))
    known = progress.select(*keys, "status", "error_count")
    return fresh.join(known, list(keys), "left").select(*keys, F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("error_count", F.lit(0)).alias("error_count"))


def recovered(progress: DataFrame) -> DataFrame:
    """After a crash: what was in progress is pending again."""
    return progress.withColumn("status", F.when(F.col("status").isin("processing", "in_progress"), "pending").otherwise(F.col("status")))


def advanced(progress: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results (keys, ok): done, or error and one more; a key without result stays as it is."""
    r = results.groupBy(*keys).agg(F.bool_and("ok").alias("_ok"))
    j = progress.join(r, list(keys), "left")
    status = F.when(F.col("_ok"), "done").when(~F.col("_ok"), "error").otherwise(F.col("status"))
    return j.select(*keys, status.alias("status"), (F.col("error_count") + F.when(~F.col("_ok"), 1).otherwise(0)).alias("error_count"))


def retry_delay_ms(errors: Column | str) -> Column:
    """5 s an error, 30 s at most."""
    e = F.col(errors) if isinstance(errors, str) else errors
    return F.least(F.greatest(e, F.lit(0)) * RETRY_STEP_MS, F.lit(RETRY_MOST_MS))


def next_due(queue: DataFrame, now_ms: int, count: int = 1) -> DataFrame:
    """The earliest items that are due (due_at, host)."""
    return queue.where(F.col("due_at") <= now_ms).orderBy("due_at", "host").limit(count)


def put_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """Key and value rows, the new ones replacing old ones."""
    return state.join(new.select("key"), "key", "left_anti").unionByName(new)


def bump_state(state: DataFrame, key: str, by: int = 1) -> DataFrame:
    """A counter of the state, 0 where it is not there or no number."""
    one = state.sparkSession.createDataFrame([(key,)], "key string")
    old = one.join(state.where(F.col("key") == key), "key", "left")
    return put_state(state, old.select("key", (F.coalesce(F.expr("try_cast(value as bigint)"), F.lit(0)) + by).cast("string").alias("value")))


def selected_hosts(remote: DataFrame, source: DataFrame, denied: DataFrame, mode: str) -> DataFrame:
    """Hosts to keep: those of the remote list (include), or the source's that are not on it (exclude); never denied ones."""
    norm = lambda df: df.select(S.normalize_host("host").alias("host")).where("host is not null").distinct()
    if mode not in ("exclude", "include"):
        raise ValueError(f"unknown mode {mode}")
    chosen = norm(remote) if mode == "include" else norm(source).join(norm(remote), "host", "left_anti")
    return chosen.join(norm(denied), "host", "left_anti")


def synced(remote: DataFrame, denied: DataFrame, mode: str, instances: DataFrame, channels: DataFrame, videos: DataFrame, embeddings: DataFrame) -> dict[str, DataFrame]:
    """The catalogue of the selected hosts: their instances (new ones with nulls) and what belongs to them."""
    hosts = selected_hosts(remote, videos.select(F.col("instance_domain").alias("host")).distinct(), denied, mode)
    kept = hosts.join(instances, "host", "left").select(*instances.columns)
    return {"instances": kept, **rebuild_content(channels, videos, embeddings, hosts)}


def sliced(hosts: DataFrame, channels: DataFrame, max_instances: int, max_channels: int) -> DataFrame:
    """Channels of the first max_instances hosts, max_channels a host (0: no bound), by name."""
    some = hosts.select("host").distinct()
    some = some.orderBy("host").limit(max_instances) if max_instances else some
    own = channels.join(some, F.col("instance_domain") == F.col("host"), "left_semi")
    if not max_channels:
        return own
    from pyspark.sql import Window as W

    return own.withColumn("_n", F.row_number().over(W.partitionBy("instance_domain").orderBy("channel_id"))).where(F.col("_n") <= max_channels).drop("_n")


def taken(pages: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """What a reader that goes from page to page takes until its remaining limit is used up."""
    return pages.orderBy(*order).limit(max(0, limit))


def channels_to_read(channels: DataFrame, hosts: DataFrame, min_videos: int) -> DataFrame:
    """Named channels of known hosts with enough videos."""
    c = channels.where(F.col("channel_name").isNotNull() & (F.coalesce("videos_count", F.lit(0)) >= min_videos))
    return c.join(hosts.select(S.normalize_host("host").alias("_h")).distinct(), S.normalize_host("instance_domain") == F.col("_h"), "left_semi")


def health_of(probes: DataFrame) -> DataFrame:
    """Probes (host, at, status code or null, message) to the newest health of each host."""
    newest = first_by(probes, ["host"], F.desc("at"), F.desc_nulls_last("code"))
    good = F.col("code").between(200, 299)
    return newest.select("host", F.when(good, "ok").otherwise("error").alias("health_status"), F.col("at").alias("health_checked_at"), F.when(~F.coalesce(good, F.lit(False)), F.coalesce("message", F.concat(F.lit("HTTP "), "code"), F.lit("no answer"))).alias("health_error"))
