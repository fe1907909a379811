"""The engine's calls over a small store."""

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.operators import logs
from quarry.plans.views import NOW_MS, Catalogue
from quarry.schemas import TABLES, conform
from quarry.sources.stores import Store

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    store, c = Store(spark, str(tmp_path_factory.mktemp("store"))), Catalogue(spark, DIR)
    store.write("videos", conform(c.videos, "videos"), 1)
    store.write("channels", conform(c.channels, "channels"), 1)
    store.write("video_embeddings", conform(c.embeddings, "video_embeddings"), 1)
    return Engine(spark, store, NOW_MS)


def refs(engine, n):
    return [(r["video_uuid"], r["instance_domain"]) for r in engine._t("videos").join(engine._t("video_embeddings").select("video_id"), "video_id").orderBy("video_id").limit(n).collect()]


def test_feeds(engine):
    assert 0 < engine.recommend().count() <= 48
    page = engine.recommend(refs(engine, 3))
    assert page.count() > 0 and page.groupBy("video_id").count().where("count > 1").count() == 0


def test_limits(engine):
    with pytest.raises(ValueError, match="received 6"):
        engine.recommend([("u", "h")] * 6)
    with pytest.raises(ValueError, match="like 0"):
        engine.recommend([("   ", "example.com")])


def test_similar(engine):
    uuid, host = refs(engine, 1)[0]
    rows = engine.similar(uuid, host, 10).collect()
    assert len(rows) == 10 and all(r["video_uuid"] != uuid for r in rows)
    with pytest.raises(LookupError):
        engine.similar("nothing")
    assert engine.search([0.0] * 64, 5).count() == 5 and engine.health().first()["dim"] == 64


def test_ingest_and_block(engine, spark):
    uuid, host = refs(engine, 1)[0]
    rows = [("e1", 1, "Like", uuid, host), ("e1", 2, "Like", uuid, host), ("e2", 3, "Share", uuid, host)]
    bad = engine.ingest(spark.createDataFrame(rows, "event_id string, arrival long, event_type string, video_uuid string, instance_domain string"), 5)
    assert bad.count() == 1 and engine._t("interaction_signals").first()["likes_count"] == 1
    counts = {r["table_name"]: r["n"] for r in engine.block_host(host.upper(), 6, purge=True, yes=True).collect()}
    assert counts["videos"] > 0 and engine._t("videos").where(F.col("instance_domain") == host).count() == 0
    engine.unblock_host(host, 7)
    assert engine._t("instance_denylist").first()["is_active"] == 0


def test_ingest_in_order_of_arrival(engine, spark):
    """Arrival decides, not the time of publication; repeats of stored events change nothing, in later batches neither."""
    schema = "event_id string, arrival long, event_type string, video_uuid string, instance_domain string, published_at long"
    first = [("a1", 1, "Like", "au", "ah", 30), ("a2", 2, "UndoLike", "au", "ah", 20), ("a3", 3, "UndoLike", "au", "ah", 10)]
    engine.ingest(spark.createDataFrame(first, schema), 11)
    own = lambda: engine._t("interaction_signals").where("video_uuid = 'au'").first()
    assert (own()["likes_count"], own()["undo_likes_count"]) == (0, 2)
    engine.ingest(spark.createDataFrame([first[0], ("a4", 1, "Like", "au", "ah", 5), ("a5", 2, "Like", "bu", "ah", 5)], schema), 12)
    assert own()["likes_count"] == 1 and own()["updated_at"] == 12
    engine.ingest(spark.createDataFrame([("a6", 1, "UndoLike", "bu", "ah", 5), ("a7", 2, "UndoLike", "bu", "ah", 5)], schema), 13)
    assert own()["updated_at"] == 12 and engine._t("interaction_signals").where("video_uuid = 'bu'").first()["likes_count"] == 0
    assert engine._t("interaction_raw_events").where("instance_domain = 'ah'").count() == 7


def test_similar_is_stored(engine):
    uuid, host = refs(engine, 3)[2]
    before = engine._t("similarity_items").count()
    one = [r["video_id"] for r in engine.similar(uuid, host, 10, at=20).collect()]
    stored = engine._t("similarity_items").count()
    assert stored > before and [r["video_id"] for r in engine.similar(uuid, host, 10, at=21).collect()] == one and engine._t("similarity_items").count() == stored


def test_profile(engine, spark):
    uuid, host = refs(engine, 4)[3]
    do = lambda k, action, at: engine.act(" ", spark.createDataFrame([(k, action, uuid, host)], "action_id long, action string, video_uuid string, instance_domain string"), at)
    assert do(1, "like", 30).first()["event_type"] == "Like" and engine.profile(None).first()["updated_at"] == 30
    assert do(2, "open", 31).count() == 0 and engine.profile(None).count() == 1
    assert do(3, "undo_like", 32).first()["event_id"] == "evt-3" and engine.profile(None).count() == 0
    do(4, "like", 33)
    engine.reset_profile("local-user", 34)
    assert engine.profile(None).count() == 0


def test_debug_needs_leave(engine):
    with pytest.raises(PermissionError):
        engine.recommend(debug=True)
    assert engine.recommend(debug=True, debug_allowed=True).first()["debug"]["layer"] in ("popular", "random", "fresh")


def test_live_refresh_and_verdicts(engine, spark):
    v = engine._t("videos").orderBy("video_id").first()
    engine.refresh_video(spark.createDataFrame([(v["video_id"], v["instance_domain"], "new title", 10**9)], "video_id string, instance_domain string, title string, views long"), 40)
    now = engine.video(v["video_id"]).first()
    assert now["title"] == "new title" and now["last_checked_at"] == 40 and now["popularity"] != v["popularity"]
    engine.set_channels(spark.createDataFrame([(v["channel_id"], v["instance_domain"].upper(), "blocked", "r", None)], "channel_id string, instance_domain string, status string, reason string, source_video_url string"), 41)
    assert [r["channel_id"] for r in engine.moderated("blocked").collect()] == [v["channel_id"]]


def test_schemas():
    assert "popularity" in TABLES["videos"].names


def test_logs(spark, tmp_path):
    rows = [("2024-01-01T00:00:00Z", "INFO", None, "stage merge started rows=3", ["focused"], "r", None), ("2024-01-01T00:00:02Z", "INFO", None, "stage merge finished", None, "r", None), ("2024-01-01T00:00:03Z", "INFO", None, "[access] GET /x code=500, code=501", ["focused"], "r", None)]
    rows += [("2024-01-01T00:00:04Z", "warning", None, "[similar-server][id 7] candidates=3 a=b=c", None, " ", None), ("2024-01-01T00:00:05Z", "INFO", None, "[service] lifecycle state=up =x", None, None, None), ("2024-01-01T00:00:06Z", "INFO", None, None, None, None, None)]
    df = spark.createDataFrame(rows, logs.SCHEMA)
    logs.write(df, str(tmp_path / "log"))
    assert logs.read(spark, str(tmp_path / "log")).where("event = 'access' and context['code'] = '501' and message = 'request finished'").count() == 1
    assert logs.stage_durations(df).first()["ms"] == 2000
    assert logs.visible(df, "focused").count() == 3 and logs.visible(df, "none").count() == 4
    got = logs.classified(df).orderBy("ts").collect()
    assert [r["event"] for r in got] == ["engine.log", "engine.log", "access", "similar_server.info", "service.lifecycle", "engine.log"]
    assert got[0]["pairs"] == {"rows": "3"} and got[3]["pairs"] == {"candidates": "3", "a": "b=c"} and got[4]["pairs"] == {"state": "up"} and got[4]["message"] is None
    assert [r["modes"] for r in got[3:]] == [logs.MODES, logs.MODES, ["verbose"]] and [r["request_id"] for r in got[3:]] == ["id 7", None, None]
