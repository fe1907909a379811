"""Stored layout: joins and groups by the key of bucketed tables have no exchange."""

import uuid

import pytest

from quarry.operators import catalogue as K
from quarry.plans.views import Catalogue
from quarry.sources import layout


@pytest.fixture
def tables(spark):
    c = Catalogue(spark, "/root/testdata/sf0.001")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables too large to be broadcast
    made = layout.store_all(spark, {"videos": c.videos, "video_embeddings": c.embeddings, "channels": c.channels}, f"t_{uuid.uuid4().hex}_", 8)
    yield c, made
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    for df in made.values():
        for name in {r["tableName"] for r in spark.sql("show tables").collect() if r["tableName"].startswith("t_")}:
            spark.sql(f"drop table if exists {name}")
        del df


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_without_exchange(tables):
    c, t = tables
    near = t["video_embeddings"].join(t["videos"].where(K.usable()), K.KEY)
    grouped = near.groupBy(*K.KEY).count()
    assert "Exchange" not in plan(near) and "Exchange" not in plan(grouped)
    both = K.metadata(t["video_embeddings"], t["videos"], t["channels"])
    assert plan(both).count("Exchange hashpartitioning") <= 1  # only what goes on to the channels' key
    want = K.metadata(c.embeddings, c.videos, c.channels)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select("video_id", "instance_domain", "title", "display_name", "embedding_dim").collect())
    assert rows(both) == rows(want) and near.count() == want.count()
    assert plan(K.metadata(c.embeddings, c.videos, c.channels)).count("Exchange hashpartitioning") > 1


def test_lookup_reads_one_bucket(tables):
    _, t = tables
    one = t["videos"].first()
    found = t["videos"].where((t["videos"]["video_id"] == one["video_id"]) & (t["videos"]["instance_domain"] == one["instance_domain"]))
    assert found.count() == 1
    assert layout.buckets_for(0) == 8 and layout.buckets_for(layout.BUCKET_BYTES * 9) == 16
