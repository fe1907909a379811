"""Reads of the video catalogue: metadata joins, lookups, listings, moderation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import ERROR_THRESHOLD, LIKE_WEIGHT
from ..functions import scalars as S

KEY = ["video_id", "instance_domain"]
STABLE = "video_id instance_domain video_uuid channel_id channel_name title category published_at views likes".split()


def usable(threshold: int | None = ERROR_THRESHOLD) -> Column:
    """Few errors so far; off for 0 or None."""
    return F.lit(True) if not threshold else F.col("error_count").isNull() | (F.col("error_count") < threshold)


def stable(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in STABLE if c in df.columns])


def _named(channels: DataFrame) -> DataFrame:
    return channels.select("channel_id", "instance_domain", "display_name", "followers_count")


def with_channel(rows: DataFrame, channels: DataFrame) -> DataFrame:
    """Video rows with their channel's display name and followers, null where it is not known."""
    return rows.join(_named(channels), ["channel_id", "instance_domain"], "left")


def metadata(embeddings: DataFrame, videos: DataFrame, channels: DataFrame, threshold: int | None = ERROR_THRESHOLD) -> DataFrame:
    """Videos that have an embedding, with their channel if it is known."""
    e = embeddings.select(*KEY, "embedding_dim", "model_name")
    return with_channel(e.join(videos.where(usable(threshold)), KEY), channels)


def metadata_of(entries: DataFrame, embeddings: DataFrame, videos: DataFrame, channels: DataFrame, threshold: int | None = ERROR_THRESHOLD) -> DataFrame:
    """Metadata of the entries' videos (any number, once each), with the like key."""
    wanted = embeddings.join(entries.select(*KEY).distinct(), KEY, "left_semi")
    return metadata(wanted, videos, channels, threshold).withColumn("like_key", S.like_key("video_id", "instance_domain"))


def with_signals(videos: DataFrame, signals: DataFrame) -> DataFrame:
    """adjusted_likes (null if likes are) and interaction_signal_score beside each video."""
    s = signals.select("video_uuid", "instance_domain", "likes_count", "undo_likes_count", "signal_score")
    adjusted = F.col("likes") + F.coalesce("likes_count", F.lit(0)) - F.coalesce("undo_likes_count", F.lit(0))
    j = videos.join(s, ["video_uuid", "instance_domain"], "left").withColumn("adjusted_likes", adjusted)
    return j.withColumn("interaction_signal_score", F.coalesce("signal_score", F.lit(0.0))).drop("likes_count", "undo_likes_count", "signal_score")


def recent(videos: DataFrame, embeddings: DataFrame, limit: int, threshold: int | None = ERROR_THRESHOLD) -> DataFrame:
    v = videos.where(usable(threshold)).join(embeddings.select(*KEY), KEY, "left_semi")
    return v.orderBy(F.desc_nulls_last("published_at"), F.desc("video_id")).limit(limit)


def ranked_popular(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows (of with_signals) by popularity and signals, with their position."""
    order = [F.round(F.col("popularity") + F.col("interaction_signal_score"), 9).desc(), F.desc_nulls_last("adjusted_likes"), F.desc_nulls_last("views"), F.desc_nulls_last("published_at"), F.desc("video_id")]
    return rows.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(W.orderBy(*order)))  # limit rows, not the catalogue


def popular(videos: DataFrame, signals: DataFrame, embeddings: DataFrame, limit: int, threshold: int | None = ERROR_THRESHOLD) -> DataFrame:
    """The pool is cut first, and only then joined with embeddings, so fewer rows than limit may be left."""
    return ranked_popular(with_signals(videos.where(usable(threshold)), signals), limit).join(embeddings.select(*KEY), KEY, "left_semi")


def shuffled(videos: DataFrame, seed: str, limit: int | None = None) -> DataFrame:
    """A reproducible random order: by md5 of seed and key."""
    order = [S.seeded(seed, S.like_key("video_id", "instance_domain")), F.col("video_id")]
    return videos.orderBy(*order) if limit is None else videos.orderBy(*order).limit(limit)


def lookup(videos: DataFrame, channels: DataFrame, ref: str, host: str | None = None, threshold: int | None = ERROR_THRESHOLD) -> DataFrame:
    """The video by id or uuid, and optionally host, with its channel; one row at most."""
    v = videos.where(((F.col("video_id") == ref) | (F.col("video_uuid") == ref)) & usable(threshold))
    v = v if host is None else v.where(F.col("instance_domain") == host)
    return v.join(_named(channels), ["channel_id", "instance_domain"], "left").orderBy("video_id", "instance_domain").limit(1)


def seeds(refs: DataFrame, videos: DataFrame, embeddings: DataFrame) -> DataFrame:
    """refs (ref, host): embedding of the video with this uuid, else with this id; refs without one are left out."""
    v = videos.select(*KEY, "video_uuid", "channel_id").join(embeddings.select(*KEY, "embedding"), KEY)
    r = refs.select("ref", "host").distinct()
    by_uuid = r.join(v, (F.col("ref") == F.col("video_uuid")) & (F.col("host") == F.col("instance_domain"))).withColumn("_way", F.lit(0))
    by_id = r.join(v, (F.col("ref") == F.col("video_id")) & (F.col("host") == F.col("instance_domain"))).withColumn("_way", F.lit(1))
    rn = F.row_number().over(W.partitionBy("ref", "host").orderBy("_way", "video_id"))
    return by_uuid.unionByName(by_id).withColumn("_rn", rn).where("_rn = 1").drop("_rn", "_way")


def resolve(likes: DataFrame, videos: DataFrame) -> DataFrame:
    """Client likes (position, uuid, host) to videos: trimmed, first mention of each, unknown ones left out, order kept."""
    c = likes.select("position", S.clean_text("uuid").alias("video_uuid"), S.clean_text("host").alias("instance_domain")).where("video_uuid is not null and instance_domain is not null")
    first = c.groupBy("video_uuid", "instance_domain").agg(F.min("position").alias("position"))
    return first.join(videos.select(*KEY, "video_uuid"), ["video_uuid", "instance_domain"])


def bad_like(likes: DataFrame, most: int) -> DataFrame:
    """One row: how many likes, whether too many, and the first bad position (null if none)."""
    bad = S.clean_text("uuid").isNull() | S.clean_text("host").isNull()
    return likes.agg(F.count("*").alias("received"), (F.count("*") > most).alias("too_many"), F.min(F.when(bad, F.col("position"))).alias("first_bad"))


CHANNEL_ORDERS = {
    "name": "lower(coalesce(display_name, channel_name, ''))",
    "followers": "coalesce(followers_count, 0)",
    "videos": "coalesce(videos_count, 0)",
    "instance": "instance_domain",
}


def channels(table: DataFrame, text: str | None = None, host: str | None = None, min_followers: int = 0, min_videos: int = 0, max_videos: int | None = None, sort: str = "followers", descending: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of channels with the total of all that match."""
    c = table
    if text:
        t = text.lower()
        c = c.where(F.lower(F.coalesce("display_name", "channel_name", F.lit(""))).contains(t) | F.lower("instance_domain").contains(t))
    if host:
        c = c.where(F.col("instance_domain") == host)
    n = F.coalesce("videos_count", F.lit(0))
    c = c.where((F.coalesce("followers_count", F.lit(0)) >= max(0, min_followers)) & (n >= max(0, min_videos)))
    c = c if max_videos is None else c.where(n <= max(0, max_videos))
    by = F.expr(CHANNEL_ORDERS.get(sort, CHANNEL_ORDERS["followers"]))
    order = [by.desc_nulls_last() if descending else by.asc_nulls_last(), F.desc_nulls_last("followers_count"), F.desc_nulls_last("videos_count"), F.asc("channel_name"), F.asc("channel_id")]
    total = c.agg(F.count("*").alias("total"))
    page = c.orderBy(*order).offset(max(0, offset)).limit(max(1, limit))
    return page.crossJoin(F.broadcast(total))  # one row


def denied_hosts(denylist: DataFrame) -> DataFrame:
    return denylist.where("is_active = 1").select(S.normalize_host("host").alias("_denied")).distinct()


def blocked_channels(moderation: DataFrame) -> DataFrame:
    return moderation.where("status = 'blocked'").select(F.col("channel_id").alias("_channel"), S.normalize_host("instance_domain").alias("_channel_host")).distinct()


def moderate(rows: DataFrame, denylist: DataFrame, moderation: DataFrame, by_host: bool = True, by_channel: bool = True) -> DataFrame:
    """Rows of denied hosts go first, then those of blocked channels."""
    if by_host:
        rows = rows.join(denied_hosts(denylist), S.normalize_host("instance_domain") == F.col("_denied"), "left_anti")
    if by_channel:
        rows = rows.join(blocked_channels(moderation), (F.col("channel_id") == F.col("_channel")) & (S.normalize_host("instance_domain") == F.col("_channel_host")), "left_anti")
    return rows


def moderation_counts(rows: DataFrame, denylist: DataFrame, moderation: DataFrame) -> DataFrame:
    j = rows.join(denied_hosts(denylist), S.normalize_host("instance_domain") == F.col("_denied"), "left")
    j = j.join(blocked_channels(moderation), (F.col("channel_id") == F.col("_channel")) & (S.normalize_host("instance_domain") == F.col("_channel_host")), "left")
    return j.agg(F.count("*").alias("seen"), F.count_if(F.col("_denied").isNotNull()).alias("denied"), F.count_if(F.col("_denied").isNull() & F.col("_channel").isNotNull()).alias("blocked"))


def capped(rows: DataFrame, order: list[Column], author_cap: int, instance_cap: int, limit: int | None = None, once: bool = True, within: list[str] | None = None) -> DataFrame:
    """At most author_cap rows an author, then instance_cap an instance (0: no cap), in the given order.

    Rows of one video count once.  An author belongs to one instance, so two
    ranked filters one after the other keep what a scan in order would keep.
    Rows without channel or host are not capped.
    """
    per = within or []
    df = rows.withColumn("_author", S.author_key("channel_id", "instance_domain"))

    def keep(df: DataFrame, by: list[str], most: int, free: Column) -> DataFrame:
        return df.withColumn("_rn", F.row_number().over(W.partitionBy(*per, *by).orderBy(*order))).where((F.col("_rn") <= most) | free).drop("_rn")

    if once:
        df = keep(df, KEY, 1, F.lit(False))
    if author_cap > 0:
        df = keep(df, ["_author"], author_cap, F.col("_author").isNull())
    if instance_cap > 0:
        df = keep(df, ["instance_domain"], instance_cap, F.coalesce("instance_domain", F.lit("")) == "")
    df = df.drop("_author")
    return df if limit is None else df.orderBy(*order).limit(limit)


#: Hex digits of a lot by which a shuffled cache is dealt.
LOT_DIGITS = 3


def ring_order(start: str, number: str = "video_number") -> list[Column]:
    return [F.expr(f"{number} < {start}"), F.col(number)]


def random_cache(videos: DataFrame, start: str, size: int, author_cap: int, instance_cap: int, number: str = "video_number") -> DataFrame:
    """Videos in ring order from a start number, capped, with their position."""
    ring = ring_order(start, number)
    kept = capped(videos, ring, author_cap, instance_cap, size)
    return kept.withColumn("position", F.row_number().over(W.orderBy(*ring)))  # size rows


def shuffled_cache(cache: DataFrame, seed: str) -> DataFrame:
    """The cache to store: its rows at positions 1, 2, ... in a seeded random order.

    The lots are md5 in hex, evenly spread, so rows are dealt by the first LOT_DIGITS of
    them, numbered in each part, and what precedes a part is a prefix sum of their counts.
    """
    lot = S.seeded(seed, S.like_key("video_id", "instance_domain"))
    df = cache.withColumn("_lot", lot).withColumn("_part", F.substring("_lot", 1, LOT_DIGITS))
    sums = df.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # 16 ** LOT_DIGITS rows at most
    place = F.row_number().over(W.partitionBy("_part").orderBy("_lot", "video_id"))
    return df.withColumn("_at", place).join(F.broadcast(sums.select("_part", before.alias("_before"))), "_part").withColumn("position", (F.col("_at") + F.col("_before")).cast("long")).drop("_lot", "_part", "_n", "_at", "_before")


def cache_window(cache: DataFrame, start: int, count: int) -> DataFrame:
    return cache.where((F.col("position") > start) & (F.col("position") <= start + count))


def full_page_stop(pages: DataFrame, after: int, per: list[str]) -> DataFrame:
    """Pages (page, known, size) up to and with the first run of ``after`` pages whose videos are all known."""
    order = W.partitionBy(*per).orderBy("page")
    df = pages.withColumn("_full", (F.col("known") == F.col("size")) & (F.col("size") > 0))
    df = df.withColumn("_island", F.sum(F.when(F.col("_full"), 0).otherwise(1)).over(order))
    df = df.withColumn("_run", F.sum(F.col("_full").cast("int")).over(W.partitionBy(*per, "_island").orderBy("page")))
    stop = F.min(F.when(F.col("_run") >= after, F.col("page"))).over(W.partitionBy(*per))
    return df.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop"))).drop("_full", "_island", "_run", "_stop")


def due_for_health(table: DataFrame, now_ms: int, min_age: int, errors_only: bool = False) -> DataFrame:
    due = F.col("health_checked_at").isNull() | (F.col("health_checked_at") <= now_ms - min_age)
    return table.where(due & (F.col("health_status") == "error" if errors_only else F.lit(True)))


LIVE_TEXT, LIVE_NUMBERS = ["title", "description", "channel_name"], ["views", "likes", "dislikes", "tags_json", "category", "nsfw"]


def merged_live(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored videos with what was just fetched on top: texts unless blank, numbers unless null."""
    j = stored.alias("l").join(live.withColumn("_live", F.lit(True)).alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in KEY], "left")
    value = lambda c: F.coalesce(F.nullif(F.col(f"r.{c}"), F.lit("")), F.col(f"l.{c}")) if c in LIVE_TEXT else F.coalesce(f"r.{c}", f"l.{c}") if c in LIVE_NUMBERS else F.col(f"l.{c}")
    here = set(live.columns)
    return j.select(*[(value(c) if c in here else F.col(f"l.{c}")).alias(c) for c in stored.columns], F.coalesce("_live", F.lit(False)).alias("refreshed"))


def refreshed(stored: DataFrame, live: DataFrame, now_ms: int, like_weight: float = LIKE_WEIGHT) -> DataFrame:
    """The rows to store after a live fetch: merged, with popularity and time of check anew where something was fetched."""
    m = merged_live(stored, live)
    new = {"popularity": S.popularity("views", "likes", "published_at", now_ms, like_weight), "last_checked_at": F.lit(now_ms).cast("long")}
    return m.select(*[F.when(F.col("refreshed"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in stored.columns])


POPULARITY_MODES = {"missing": "popularity is null", "incremental": "popularity is null or popularity = 0", "reset": "true"}


def with_popularity(videos: DataFrame, mode: str, now_ms: int, like_weight: float = LIKE_WEIGHT) -> DataFrame:
    """Popularity where it is missing, where it is missing or 0 (incremental), or anew for all (reset)."""
    if mode not in POPULARITY_MODES:
        raise ValueError(f"unknown mode {mode}")
    return videos.withColumn("popularity", F.when(F.expr(POPULARITY_MODES[mode]), S.popularity("views", "likes", "published_at", now_ms, like_weight)).otherwise(F.col("popularity")))
