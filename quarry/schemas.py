"""Schemas of the catalogue's tables, and checks of tables against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

_TYPES = {"string": StringType(), "long": LongType(), "int": IntegerType(), "double": DoubleType(), "array<float>": ArrayType(FloatType()), "array<double>": ArrayType(DoubleType()), "binary": BinaryType()}


def _schema(columns: str) -> StructType:
    """Of "name type, name type, ...", without needing a session."""
    out = StructType()
    for c in columns.split(", "):
        name, kind = c.split()
        out.add(name, _TYPES[kind])
    return out


_HEALTH = "health_status string, health_checked_at long, health_error string, last_error string, last_error_at long, last_error_source string"
TABLES: dict[str, StructType] = {
    name: _schema(ddl)
    for name, ddl in {
        "instances": f"host string, {_HEALTH}",
        "channels": f"channel_id string, instance_domain string, channel_name string, channel_url string, display_name string, videos_count long, followers_count long, avatar_url string, {_HEALTH}",
        "videos": "video_id string, instance_domain string, video_uuid string, video_numeric_id long, channel_id string, channel_name string, account_name string, title string, description string, tags_json string, category string, published_at long, video_url string, duration long, thumbnail_url string, embed_path string, views long, likes long, dislikes long, comments_count long, nsfw int, preview_path string, last_checked_at long, last_error string, error_count int, invalid_reason string, popularity double",
        "video_embeddings": "video_id string, instance_domain string, embedding array<float>, embedding_dim int, model_name string, created_at string",
        "similarity_items": "source_video_id string, source_instance_domain string, similar_video_id string, similar_instance_domain string, score double, rank int",
        "ann_model": "dim int, lists int, parts int, probes int, shortlist int, recall double, recall_at int, trained_at long, centroids array<double>, books array<double>",
        "ann_lists": "video_id string, instance_domain string, code binary, embedding array<float>, list_id int",
        "similarity_sources": "video_id string, instance_domain string, computed_at long",
        "random_rowids": "position long, video_id string, instance_domain string",
        "interaction_raw_events": "event_id string, event_type string, actor_id string, video_uuid string, instance_domain string, canonical_url string, source_instance string, published_at long, raw_payload_json string, ingested_at long, arrival long",
        "interaction_signals": "video_uuid string, instance_domain string, likes_count long, undo_likes_count long, comments_count long, signal_score double, updated_at long, version long",
        "instance_denylist": "host string, is_active int, reason string, note string, created_at long, updated_at long",
        "channel_moderation": "channel_id string, instance_domain string, status string, reason string, source_video_url string, updated_at long, created_at long",
        "likes": "user_id string, video_id string, instance_domain string, video_uuid string, updated_at long, event_id string",
        "edges": "source_host string, target_host string",
        "video_crawl_progress": "instance_domain string, channel_id string, status string, error_count int, updated_at long",
        "channel_crawl_progress": "instance_domain string, status string, error_count int, updated_at long",
        "instance_crawl_progress": "host string, status string, error_count int, updated_at long",
        "crawl_state": "key string, value string",
        "crawl_progress": "instance_domain string, channel_id string, status string, error_count int, last_start long, updated_at long",
    }.items()
}


def missing_columns(df: DataFrame, table: str) -> list[str]:
    return [f.name for f in TABLES[table] if f.name not in df.columns]


def assert_columns(df: DataFrame, table: str, exact: bool = False) -> DataFrame:
    """df itself, if it has the table's columns (and no others where exact)."""
    extra = [c for c in df.columns if c not in TABLES[table].names] if exact else []
    if (lost := missing_columns(df, table)) or extra:
        raise ValueError(f"{table}: missing {lost}, unexpected {extra}")
    return df


def conform(df: DataFrame, table: str, fallback: dict[str, str] | None = None) -> DataFrame:
    """Migration: the table's columns in order, cast; a missing one from its fallback SQL or null."""
    fallback = fallback or {}
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.expr(fallback.get(f.name, "null"))).cast(f.dataType).alias(f.name) for f in TABLES[table]])


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]
