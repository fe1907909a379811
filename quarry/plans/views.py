"""Canonical tables of the engine over a directory of Parquet tables.

The test tables have no videos, so these stand-ins are derived: nations are
instances, customers channels, orders videos, purchases likes and so on.  The
SQL text of each stand-in is in ``SQL_VIEWS`` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

NOW_MS = 996_710_400_000  # the day after the last order


class Catalogue:
    """Lazily built canonical tables; nothing is read before an action."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")

    @property
    def hosts(self) -> DataFrame:
        return self.table("nation").select("n_nationkey", F.concat(F.lower("n_name"), F.lit(".example")).alias("host"))

    @property
    def instances(self) -> DataFrame:
        return self.hosts.select("host", F.when(F.col("n_nationkey") % 5 == 0, "error").otherwise("ok").alias("health_status"))

    @property
    def channels(self) -> DataFrame:
        counts = self.table("orders").groupBy("o_custkey").agg(F.count("*").alias("videos_count"))
        c = self.table("customer").join(self.hosts, F.col("c_nationkey") == F.col("n_nationkey")).join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
        return c.select(
            F.col("c_custkey").cast("string").alias("channel_id"), F.col("host").alias("instance_domain"), F.col("c_name").alias("channel_name"),
            F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("Channel "), F.col("c_custkey"))).alias("display_name"),
            F.floor(F.abs("c_acctbal")).cast("long").alias("followers_count"), "videos_count",
        )

    @property
    def videos(self) -> DataFrame:
        likes = self.table("lineitem").groupBy("l_orderkey").agg(F.floor(F.sum("l_quantity")).cast("long").alias("likes"))
        owner = self.table("customer").join(self.hosts, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "host")
        o = self.table("orders").join(owner, F.col("o_custkey") == F.col("c_custkey")).join(likes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        v = o.select(
            F.col("o_orderkey").cast("string").alias("video_id"), F.col("host").alias("instance_domain"), F.concat(F.lit("u-"), F.col("o_orderkey")).alias("video_uuid"),
            F.col("o_custkey").cast("string").alias("channel_id"), F.col("c_name").alias("channel_name"), F.concat(F.lit("Video "), F.col("o_orderkey")).alias("title"),
            F.col("o_orderpriority").alias("category"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("published_at"),
            F.floor("o_totalprice").cast("long").alias("views"), "likes",
            F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 5).cast("int").alias("error_count"),
        )
        return v.withColumn("popularity", S.popularity("views", "likes", "published_at", NOW_MS))

    @property
    def embeddings(self) -> DataFrame:
        """vec_id is the video; the host is looked up in videos."""
        e = self.table("embeddings").select(F.col("vec_id").cast("string").alias("e_id"), "embedding", F.size("embedding").alias("embedding_dim"), F.lit("hash-64").alias("model_name"))
        keys = self.videos.select("video_id", "instance_domain")
        return e.join(keys, F.col("e_id") == F.col("video_id")).select("video_id", "instance_domain", "embedding", "embedding_dim", "model_name")

    @property
    def raw_events(self) -> DataFrame:
        kind = F.col("event_type")
        k = F.get_json_object("props", "$.k").cast("long")
        v = self.videos.select("video_uuid", "instance_domain")
        e = self.table("events").select(
            F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("arrival"),
            F.when(kind == "click", "Like").when(kind == "error", "UndoLike").when(kind == "view", "Comment").otherwise(kind).alias("event_type"),
            F.col("user_id").cast("string").alias("actor_id"), F.concat(F.lit("u-"), k).alias("uuid"), F.unix_millis(F.col("ts").cast("timestamp")).alias("published_at"), "props",
        )
        return e.join(v, F.col("uuid") == F.col("video_uuid"), "left").drop("uuid")

    @property
    def user_likes(self) -> DataFrame:
        e = self.table("events").where("event_type = 'purchase'")
        k = F.get_json_object("props", "$.k").cast("long").cast("string")
        v = self.videos.select(F.col("video_id").alias("k"), "instance_domain", "video_uuid")
        return e.select(F.col("user_id").cast("string").alias("user_id"), k.alias("video_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("updated_at"), "event_id").join(v, F.col("video_id") == F.col("k")).drop("k")

    @property
    def denylist(self) -> DataFrame:
        return self.hosts.select("host", (F.col("n_nationkey") % 7 == 0).cast("int").alias("is_active"))

    @property
    def channel_moderation(self) -> DataFrame:
        return self.channels.select("channel_id", "instance_domain", F.when(F.col("channel_id").cast("long") % 13 == 0, "blocked").otherwise("allowed").alias("status"))

    @property
    def prod(self) -> DataFrame:
        return self.videos.where("cast(video_id as bigint) % 3 <> 0").select("video_id", "instance_domain", "channel_id", "title", "views", "likes", "popularity")

    @property
    def stage(self) -> DataFrame:
        return self.videos.where("cast(video_id as bigint) % 2 = 0").select("video_id", "instance_domain", "channel_id", F.concat("title", F.lit(" (new)")).alias("title"), (F.col("views") + 1).alias("views"), F.when(F.col("likes") % 2 == 0, F.col("likes")).alias("likes"))

    @property
    def similar_items(self) -> DataFrame:
        """A stored similarity cache: each even video's three successors, some without score."""
        v = self.videos.select(F.col("video_id").cast("long").alias("n"), "instance_domain")
        src = v.where("n % 2 = 0").select(F.col("n").alias("s"), F.col("instance_domain").alias("source_instance_domain"))
        j = src.withColumn("n", F.explode(F.sequence(F.col("s") + 1, F.col("s") + 3))).join(v, "n")
        return j.select(
            F.col("s").cast("string").alias("source_video_id"), "source_instance_domain", F.col("n").cast("string").alias("similar_video_id"), F.col("instance_domain").alias("similar_instance_domain"),
            F.when(F.col("s") % 20 != 0, 1.0 - (F.col("n") - F.col("s")) / 10.0).alias("score"), (F.col("n") - F.col("s")).cast("int").alias("rank"),
        )


SQL_VIEWS = {
    "hosts": "SELECT n_nationkey, lower(n_name) || '.example' AS host FROM nation",
    "instances": "SELECT host, CASE WHEN n_nationkey % 5 = 0 THEN 'error' ELSE 'ok' END AS health_status FROM hosts",
    "channels": """SELECT CAST(c_custkey AS VARCHAR) AS channel_id, host AS instance_domain, c_name AS channel_name, CASE WHEN c_custkey % 3 <> 0 THEN 'Channel ' || c_custkey END AS display_name,
      CAST(floor(abs(c_acctbal)) AS BIGINT) AS followers_count, videos_count FROM customer JOIN hosts ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS videos_count FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "videos0": """SELECT CAST(o_orderkey AS VARCHAR) AS video_id, host AS instance_domain, 'u-' || o_orderkey AS video_uuid, CAST(o_custkey AS VARCHAR) AS channel_id, c_name AS channel_name, 'Video ' || o_orderkey AS title,
      o_orderpriority AS category, epoch_us(o_orderdate) // 1000 AS published_at, CAST(floor(o_totalprice) AS BIGINT) AS views, likes, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 5 AS INTEGER) END AS error_count
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN hosts ON c_nationkey = n_nationkey LEFT JOIN (SELECT l_orderkey, CAST(floor(sum(l_quantity)) AS BIGINT) AS likes FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "videos": f"SELECT *, (greatest(views, 0) + 2.0 * greatest(coalesce(likes, 0), 0)) / (1 + (greatest({NOW_MS} - published_at, 0) / 86400000.0) / 30.0) AS popularity FROM videos0",
    "video_embeddings": "SELECT video_id, instance_domain, embedding, len(embedding) AS embedding_dim, 'hash-64' AS model_name FROM embeddings JOIN videos ON CAST(vec_id AS VARCHAR) = video_id",
    "raw_events": """SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS arrival, CASE event_type WHEN 'click' THEN 'Like' WHEN 'error' THEN 'UndoLike' WHEN 'view' THEN 'Comment' ELSE event_type END AS event_type,
      CAST(user_id AS VARCHAR) AS actor_id, video_uuid, instance_domain, epoch_us(ts) // 1000 AS published_at, props FROM events LEFT JOIN videos ON video_uuid = 'u-' || regexp_extract(props, '"k": *([0-9]+)', 1)""",
    "user_likes": """SELECT CAST(user_id AS VARCHAR) AS user_id, video_id, epoch_us(ts) // 1000 AS updated_at, event_id, instance_domain, video_uuid FROM events JOIN videos ON video_id = regexp_extract(props, '"k": *([0-9]+)', 1) WHERE event_type = 'purchase'""",
    "denylist": "SELECT host, CAST(n_nationkey % 7 = 0 AS INTEGER) AS is_active FROM hosts",
    "channel_moderation": "SELECT channel_id, instance_domain, CASE WHEN CAST(channel_id AS BIGINT) % 13 = 0 THEN 'blocked' ELSE 'allowed' END AS status FROM channels",
    "prod": "SELECT video_id, instance_domain, channel_id, title, views, likes, popularity FROM videos WHERE CAST(video_id AS BIGINT) % 3 <> 0",
    "stage": "SELECT video_id, instance_domain, channel_id, title || ' (new)' AS title, views + 1 AS views, CASE WHEN likes % 2 = 0 THEN likes END AS likes FROM videos WHERE CAST(video_id AS BIGINT) % 2 = 0",
    "similar_items": """SELECT CAST(s AS VARCHAR) AS source_video_id, source_instance_domain, b.video_id AS similar_video_id, b.instance_domain AS similar_instance_domain,
      CASE WHEN s % 20 <> 0 THEN 1.0 - (n - s) / 10.0 END AS score, CAST(n - s AS INTEGER) AS rank
      FROM (SELECT CAST(video_id AS BIGINT) AS s, instance_domain AS source_instance_domain, CAST(video_id AS BIGINT) + unnest([1, 2, 3]) AS n FROM videos WHERE CAST(video_id AS BIGINT) % 2 = 0) a
      JOIN videos b ON CAST(b.video_id AS BIGINT) = n""",
    "signals": """SELECT video_uuid, instance_domain, CAST(arg_max(sl - least(0, ml), arrival) AS BIGINT) AS likes_count, CAST(arg_max(su - least(0, mu), arrival) AS BIGINT) AS undo_likes_count,
      CAST(arg_max(sc - least(0, mc), arrival) AS BIGINT) AS comments_count, arg_max(ss - least(0.0, ms), arrival) AS signal_score
      FROM (SELECT *, coalesce(min(CASE WHEN n > 1 THEN sl END) OVER w2, 0) AS ml, coalesce(min(CASE WHEN n > 1 THEN su END) OVER w2, 0) AS mu, coalesce(min(CASE WHEN n > 1 THEN sc END) OVER w2, 0) AS mc, coalesce(min(CASE WHEN n > 1 THEN ss END) OVER w2, 0.0) AS ms
        FROM (SELECT *, row_number() OVER w AS n, sum(dl) OVER w AS sl, sum(du) OVER w AS su, sum(dc) OVER w AS sc, sum(ds) OVER w AS ss
          FROM (SELECT arrival, video_uuid, instance_domain, CASE event_type WHEN 'Like' THEN 1 WHEN 'UndoLike' THEN -1 ELSE 0 END AS dl, CASE event_type WHEN 'UndoLike' THEN 1 ELSE 0 END AS du, CASE event_type WHEN 'Comment' THEN 1 ELSE 0 END AS dc,
              CASE event_type WHEN 'Like' THEN 1.0::DOUBLE WHEN 'UndoLike' THEN -1.0::DOUBLE ELSE 0.25::DOUBLE END AS ds
            FROM raw_events WHERE event_type IN ('Like', 'UndoLike', 'Comment') AND video_uuid IS NOT NULL)
          WINDOW w AS (PARTITION BY video_uuid, instance_domain ORDER BY arrival))
        WINDOW w2 AS (PARTITION BY video_uuid, instance_domain ORDER BY arrival)) GROUP BY 1, 2""",
}


def sql(body: str, *names: str) -> str:
    """The body with the named views, and those that they need, before it."""
    need = {"instances": ["hosts"], "channels": ["hosts"], "videos": ["hosts", "videos0"], "denylist": ["hosts"], "channel_moderation": ["hosts", "channels"]}
    for n in ("video_embeddings", "raw_events", "user_likes", "prod", "stage", "similar_items"):
        need[n] = ["hosts", "videos0", "videos"]
    need["signals"] = [*need["raw_events"], "raw_events"]
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*need.get(n, []), n] if x not in wanted]
    body = body.strip()
    head = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in SQL_VIEWS if n in wanted)
    return f"WITH {head}\n{body}" if not body.upper().startswith("WITH ") else f"WITH {head},\n{body[5:]}"
