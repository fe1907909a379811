"""Moderation jobs: channel verdicts, lists, and purges over all tables that name a host."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .tables import host_counts, upsert, without_hosts

#: The tables that name a host, and in which column
HOST_COLUMNS = {
    "video_embeddings": "instance_domain", "videos": "instance_domain", "channels": "instance_domain", "instances": "host",
    "video_crawl_progress": "instance_domain", "channel_crawl_progress": "instance_domain", "instance_crawl_progress": "host",
}


def purge(tables: Mapping[str, DataFrame], hosts: DataFrame, dry_run: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the hosts' rows, counts of these rows); tables that are not there are skipped, nothing changes in a dry run."""
    own = {n: (tables[n], c) for n, c in HOST_COLUMNS.items() if n in tables}
    left = {n: df if dry_run else without_hosts(df, hosts, c) for n, (df, c) in own.items()}
    return {**tables, **left}, host_counts(own, hosts)


def purge_totals(counts: list[DataFrame]) -> DataFrame:
    """Counters of several purges added up by table."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("table_name").agg(F.sum("n").alias("n"))


def channel_of(videos: DataFrame, urls: DataFrame) -> DataFrame:
    """urls (video_url): channel and host of the video that each names, by uuid or id; null where it is unknown."""
    host, ref = S.video_ref("video_url")
    asked = urls.select("video_url", host.alias("_host"), ref.alias("_ref"))
    by = lambda c: videos.select(F.col("instance_domain").alias("_host"), F.col(c).alias("_ref"), "channel_id", "instance_domain").dropDuplicates(["_host", "_ref"])
    both = by("video_uuid").withColumn("_way", F.lit(0)).unionByName(by("video_id").withColumn("_way", F.lit(1))).where("_ref is not null")
    best = both.groupBy("_host", "_ref").agg(F.min(F.struct("_way", "channel_id", "instance_domain")).alias("v"))
    return asked.join(best, ["_host", "_ref"], "left").select("video_url", S.clean_text("v.channel_id").alias("channel_id"), F.col("v.instance_domain").alias("instance_domain"))


def set_status(moderation: DataFrame, changes: DataFrame, at: int) -> DataFrame:
    """Verdicts (channel_id, instance_domain, status, reason, source_video_url) put on record; the first one's time of creation stays."""
    new = changes.withColumns({"instance_domain": S.normalize_host("instance_domain"), "created_at": F.lit(at).cast("long"), "updated_at": F.lit(at).cast("long")})
    return upsert(moderation, new, ["channel_id", "instance_domain"], ["status", "reason", "source_video_url", "updated_at"])


def listed_channels(moderation: DataFrame, status: str | None = None, host: str | None = None) -> DataFrame:
    m = moderation if status is None else moderation.where(F.col("status") == status)
    m = m if host is None else m.where(F.col("instance_domain") == S.normalize_host(F.lit(host)))
    return m.orderBy("instance_domain", "channel_id")


def listed_hosts(denylist: DataFrame, active: bool | None = True) -> DataFrame:
    d = denylist if active is None else denylist.where(F.col("is_active") == int(active))
    return d.orderBy("host")


def merge_report(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame], keys: Mapping[str, list[str]]) -> DataFrame:
    """(table_name, before, after, affected) of a merge; affected rows are those with a new key or another value."""
    out = None
    for name, new in after.items():
        old = before[name]
        on = keys[name]
        mark = lambda df, c: df.select(*on, F.xxhash64(*new.columns).alias(c), F.lit(1).alias(f"{c}_there"))  # noqa: E731, B023
        both = mark(old, "h1").join(mark(new, "h2"), on, "full_outer")
        one = both.agg(F.count("h1_there").alias("before"), F.count("h2_there").alias("after"), F.count_if(F.col("h2_there").isNotNull() & ~F.col("h1").eqNullSafe(F.col("h2"))).alias("affected"))
        one = one.select(F.lit(name).alias("table_name"), "before", "after", "affected")
        out = one if out is None else out.unionByName(one)
    return out
