"""Appends, leases, and a refresh that is stopped after each of its stages."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.jobs import Files, Lease, LeaseHeld, Run
from quarry.plans.views import NOW_MS, Catalogue
from quarry.schemas import conform
from quarry.sources.stores import Store

DIR = "/root/testdata/sf0.001"
EVENTS = "event_id string, arrival long, event_type string, video_uuid string, instance_domain string"


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_ingest_writes_what_follows_the_batch(spark, tmp_path):
    """After a large history a small batch writes little, and repeats write nothing; compaction changes no row."""
    store = Store(spark, str(tmp_path / "s"))
    engine = Engine(spark, store, NOW_MS)
    many = spark.range(60_000).select(F.concat(F.lit("e"), "id").alias("event_id"), F.col("id").alias("arrival"), F.lit("Like").alias("event_type"), F.concat(F.lit("u"), F.col("id") % 5000).alias("video_uuid"), F.lit("h").alias("instance_domain"))
    engine.ingest(many, 1)
    first = size_of(tmp_path)
    few = spark.createDataFrame([("e5", 70_000, "Like", "u5", "h"), ("x1", 70_001, "Like", "u5", "h"), ("x2", 70_002, "UndoLike", "u6", "h"), ("x1", 70_003, "Like", "u5", "h")], EVENTS)
    for k in range(3):
        before = size_of(tmp_path)
        engine.ingest(few, 2 + k)
        assert size_of(tmp_path) - before < first / 20
    got = {r["video_uuid"]: r["likes_count"] for r in engine._t("interaction_signals").where("video_uuid in ('u5', 'u6', 'u7')").collect()}
    assert got == {"u5": 13, "u6": 11, "u7": 12} and engine._t("interaction_raw_events").count() == 60_002
    assert engine._t("interaction_signals").count() == 5000 and store.read("interaction_signals").count() == 5002
    rows = sorted(map(tuple, engine._t("interaction_signals").drop("version").collect()))
    assert engine.compact(9, parts=2) == ["interaction_raw_events", "interaction_signals"] and engine.compact(10, parts=2) == []
    assert sorted(map(tuple, engine._t("interaction_signals").drop("version").collect())) == rows and engine._t("interaction_raw_events").count() == 60_002
    assert len(store.version("interaction_raw_events")) == 1 and store.drop_old("interaction_raw_events") == 4


def test_lease(spark, tmp_path):
    now = [0.0]
    of = lambda holder: Lease(Store(spark, str(tmp_path)), "refresh", holder, 10, lambda: now[0])
    a, b = of("a"), of("b")
    first = a.acquire()
    with pytest.raises(LeaseHeld):
        b.acquire()
    assert a.held() and not b.held() and a.acquire() == first + 1  # renewed
    now[0] = 11
    assert b.acquire() > first and not a.held()
    with pytest.raises(LeaseHeld):
        a.acquire()
    b.release()
    assert a.acquire() and a.held()
    files = Files(spark, str(tmp_path / "f"))
    assert files.create("x", "1") and not files.create("x", "2") and files.read("x") == "1" and files.read("y") is None


RULES = [{"name": "videos", "keys": ["video_id", "instance_domain"], "strategy": "UPSERT"}, {"name": "video_embeddings", "keys": ["video_id", "instance_domain"], "strategy": "INSERT_ONLY"}]


def test_refresh_is_one_commit_and_goes_on(spark, tmp_path, monkeypatch):
    """Stopped after each stage, all old versions stay current; the last attempt writes only what is left and commits once."""
    store, c = Store(spark, str(tmp_path / "s")), Catalogue(spark, DIR)
    old = c.videos.where("cast(video_id as int) % 2 = 0")
    store.write_all({"videos": conform(old, "videos"), "video_embeddings": conform(c.embeddings.where("cast(video_id as int) % 2 = 0"), "video_embeddings")}, 1)
    engine = Engine(spark, store, NOW_MS)
    stage = {"videos": conform(c.videos, "videos"), "video_embeddings": conform(c.embeddings, "video_embeddings")}
    names = ["videos", "video_embeddings", "ann_model", "ann_lists", "similarity_items"]
    state = {n: store.version(n) for n in names}
    made, real = [], Run.stage

    def stopping(at):
        def step(self, name, *args, **kw):
            fresh = self.done(name) is None
            found = real(self, name, *args, **kw)
            if fresh:
                made.append(name)
            if fresh and len(made) == at:
                raise RuntimeError(f"stopped after {name}")
            return found

        return step

    for k in range(1, 6):
        monkeypatch.setattr(Run, "stage", stopping(k))
        with pytest.raises(RuntimeError, match="stopped"):
            engine.refresh(stage, RULES, 5, top_k=5, lease=Lease(store, "refresh", f"worker {k}", -1))
        assert {n: store.version(n) for n in names} == state and len(made) == k
    monkeypatch.setattr(Run, "stage", stopping(-1))
    deltas = engine.refresh(stage, RULES, 5, top_k=5, lease=Lease(store, "refresh", "last", 60))
    assert made == ["deltas", "merge-videos", "merge-video_embeddings", "index", "similar"]  # each made once over all attempts
    now = {n: store.version(n) for n in names}
    assert all(len(now[n]) == 1 and now[n] != state[n] for n in names)
    e = engine._t("video_embeddings").count()
    assert engine._t("videos").count() == c.videos.count() and e == c.embeddings.count() == store.read("ann_lists").count() and deltas["videos"] > 0
    assert engine._t("similarity_items").groupBy("source_video_id").count().where("count = 5").count() == e
    assert engine.refresh(stage, RULES, 5, top_k=5) == deltas and {n: store.version(n) for n in names} == now  # committed: nothing is done again


def test_counts_of_a_merge(spark, tmp_path):
    """Counted while writing, for every strategy as by comparing both versions afterwards."""
    from quarry.operators import moderation as M
    from quarry.operators import tables as T

    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "z")], "k string, n int, only string")
    new = spark.createDataFrame([("b", 2), ("c", 4), ("d", None)], "k string, n int")
    for strategy in T.STRATEGIES:
        store = Store(spark, str(tmp_path / strategy))
        store.write("t", old, 1)
        got = store.merge("t", new, ["k"], strategy, 2)
        want = T.STRATEGIES[strategy](old, new, ["k"])
        rows = lambda df: sorted(map(str, df.select("k", "n", "only").collect()))
        assert rows(store.read("t")) == rows(want)
        assert got == M.merge_report({"t": old}, {"t": want}, {"t": ["k"]}).drop("table_name").first().asDict()
    with pytest.raises(ValueError):
        store.merge("t", new, ["k"], "NONE", 3)
