"""Physical layout: tables stored by buckets of a key, so that joins and groups by it need no exchange.

Where a database keeps secondary indexes for lookups and purges, a stored table here has
its rows dealt over buckets by a hash of the key and sorted by it inside: a join of two such
tables reads matching buckets side by side, a lookup by a whole key reads one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Keys of the tables that are joined most; a table may be stored by one of them.
BY_VIDEO = ["video_id", "instance_domain"]
BY_CHANNEL = ["channel_id", "instance_domain"]
LAYOUT = {"videos": BY_VIDEO, "video_embeddings": BY_VIDEO, "channels": BY_CHANNEL, "channel_moderation": BY_CHANNEL, "interaction_signals": ["video_uuid", "instance_domain"]}
#: Bytes of Parquet that a bucket should hold.
BUCKET_BYTES = 256 << 20


def buckets_for(total_bytes: int, least: int = 8) -> int:
    """A power of two, so that tables of different sizes still fit each other (one count divides the other)."""
    n = least
    while n * BUCKET_BYTES < total_bytes:
        n *= 2
    return n


def store(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Write df as a table of the session's catalogue in buckets by keys, each one sorted file, and read it."""
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("compression", "zstd").format("parquet").mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def store_all(spark: SparkSession, tables: dict[str, DataFrame], prefix: str, buckets: int, layout: dict[str, list[str]] = LAYOUT) -> dict[str, DataFrame]:
    """The tables under names with the prefix, each by its key of the layout."""
    return {n: store(df, f"{prefix}{n}", layout[n], buckets) for n, df in tables.items()}
