"""The stored index: build, add, pruned reads, recall, and bounded merging of many queries."""

import numpy as np
import pytest

from quarry import config as C
from quarry.engine import Engine
from quarry.operators import ann
from quarry.operators import similarity as N
from quarry.plans.views import NOW_MS, Catalogue
from quarry.schemas import conform
from quarry.sources.stores import Store

from test_engine import shuffled_rows


def vectors(spark, x):
    return spark.createDataFrame([(str(i), "h", [float(v) for v in row]) for i, row in enumerate(x)], "video_id string, instance_domain string, embedding array<float>")


def clustered(seed, n, centres=12, dim=16, spread=0.3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows_of(df):
    return sorted((r["src_id"], r["rank"], r["video_id"], r["score"]) for r in df.collect())


def test_stored_index(spark, tmp_path):
    """Few queries read only the folders of the lists that they probe; with all lists the result is exact."""
    df = vectors(spark, clustered(4, 900))
    old, late = df.where("cast(video_id as int) < 700"), df.where("cast(video_id as int) >= 700")
    store = Store(spark, str(tmp_path / "store"))
    assert not ann.StoredIndex.exists(store)
    with pytest.raises(LookupError):
        ann.StoredIndex(store)
    index = ann.StoredIndex.build(store, old, 1, lists=20, recall_at=5)
    assert index.rows.count() == 700 and index.model.recall >= 0.9 and 1 <= index.model.probes <= 20
    centroids = index.model.centroids.copy()
    assert index.add(df, 2) == 200 and index.add(late, 3) == 0
    again = ann.StoredIndex(store)
    assert (again.model.centroids == centroids).all() and again.rows.count() == 900
    some = df.where("cast(video_id as int) % 50 = 3")
    assert rows_of(again.nearest(some, 6, probes=20)) == rows_of(N.knn(some, df, 6))
    found = again.nearest(some, 6)
    assert N.recall(found, N.knn(some, df, 6)).first()["recall"] >= 0.85

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan's metrics lie open
    try:
        plan = again.nearest(df.where("video_id = '3'"), 6, probes=2)
        plan.collect()
        leaves = plan._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        assert "PartitionFilters: [" in scans[0].toString() and len(scans) == 1
        read = scans[0].metrics()
        assert read.apply("numPartitions").value() == 4 and read.apply("numFiles").value() <= 4  # two lists, of the build and of the append
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert again.compact(4, parts=1) and len(store.version("ann_lists")) == 1 and again.rows.count() == 900 and not again.compact(5, parts=1)


def test_empty_and_odd_vectors(spark, tmp_path):
    df = vectors(spark, clustered(5, 60, dim=8))
    odd = spark.createDataFrame([("a", "h", None), ("b", "h", [1.0, 2.0]), ("c", "h", [float("nan")] * 8), ("d", "h", [])], "video_id string, instance_domain string, embedding array<float>")
    store = Store(spark, str(tmp_path / "store"))
    index = ann.StoredIndex.build(store, df.unionByName(odd), 1, lists=4, recall_at=3)
    assert index.rows.count() == 60 and index.nearest(odd, 3).count() == 0 and index.nearest(df.limit(0), 3).count() == 0 and index.add(odd, 2) == 0
    with pytest.raises(ValueError):
        ann.StoredIndex.build(Store(spark, str(tmp_path / "none")), df.limit(0), 1)


def test_recall_that_is_not_reached_is_reported(spark, monkeypatch):
    df = vectors(spark, np.random.default_rng(8).normal(size=(300, 16)))
    centroids, books = N.train_index(df, 6, 1)
    monkeypatch.setattr(N, "WIDEST", 8)
    with pytest.raises(ValueError, match="all 6 lists"):
        N.measured_probes(N.build_index(df, centroids, books[:, :1].repeat(N.CODES, 1)), df, 5, 0.9, 40)


def test_many_queries(spark, monkeypatch):
    """Both sides of a hot list are dealt over tasks; rounds shuffle a small multiple of queries times the shortlist; the sketch is that of all lists at once."""
    hot = np.concatenate([clustered(6, 500, 1, spread=0.15), clustered(7, 300)])
    df = vectors(spark, hot)
    monkeypatch.setattr(N, "LIST_ROWS", 60)
    monkeypatch.setattr(N, "LIST_QUERIES", 90)
    index = N.build_index(df, *N.train_index(df, 12, 8))
    assert index.split
    wide, sent = 24, []
    got = N.shortlisted(df, index, wide, 12, sent)
    assert got.count() == 800 and len(sent) == 4 and sum(sent) <= 5 * 800 * wide and sent[-1] < sent[0]
    decoded = {r["video_id"]: np.concatenate([b[c] for b, c in zip(index.books, r["code"])]) for r in index.rows.collect()}
    names = sorted(decoded)
    scores = np.round(np.array([hot[int(i)].astype(np.float32) for i in names], float) @ np.array([decoded[i] for i in names]).T, 6)
    rows = {r["src_id"]: [(e["video_id"], e["away"]) for e in r["top"]] for r in got.collect()}
    for i, name in enumerate(names):
        want = sorted(((-scores[i, j], other) for j, other in enumerate(names) if other != name))[:wide]
        assert np.allclose([a for _, a in rows[name]], [a for a, _ in want], atol=3e-6)
    probes, shortlist, reached = N.measured_probes(index, df, 5, 0.9, 60)
    assert reached >= 0.9 and N.recall(N.ivf_knn(df, index, df, 5, probes, shortlist), N.knn(df, df, 5)).first()["recall"] >= 0.85


def test_serving_reads_the_index(spark, tmp_path):
    """similar and recommend search by the stored index when there is one, new embeddings included."""
    store, c = Store(spark, str(tmp_path / "store")), Catalogue(spark, "/root/testdata/sf0.001")
    e = conform(c.embeddings, "video_embeddings")
    store.write("videos", conform(c.videos, "videos"), 1)
    store.write("channels", conform(c.channels, "channels"), 1)
    store.write("video_embeddings", e, 1)
    engine = Engine(spark, store, NOW_MS)
    v = engine._t("videos").join(e.select("video_id"), "video_id").orderBy("video_id").first()
    exact = [r["video_id"] for r in engine.similar(v["video_uuid"], v["instance_domain"], 10).collect()]
    built = engine.build_index(2, recall_at=10)
    assert built.model.recall >= 0.9 and engine.extend_index(3) == 0
    asked = []
    search = ann.StoredIndex.nearest
    ann.StoredIndex.nearest = lambda self, q, k, probes=None: asked.append(k) or search(self, q, k, len(self.model.centroids))
    try:
        assert [r["video_id"] for r in engine.similar(v["video_uuid"], v["instance_domain"], 10).collect()] == exact
        assert engine.recommend([(v["video_uuid"], v["instance_domain"])]).count() > 0
    finally:
        ann.StoredIndex.nearest = search
    assert asked == [C.SEARCH_LIMIT, C.POOL["exploit"]]


def test_codes_grow_before_the_shortlist(spark, monkeypatch):
    """Where PARTS codes are too coarse for the recall, finer ones reach it with the narrow shortlist; many probed lists are one scan with the same result."""
    df = vectors(spark, np.random.default_rng(9).normal(size=(3000, 64)))
    monkeypatch.setattr(N, "WIDEST", 8)
    model, rows = ann.trained(df, 0.95, 5, lists=8)
    assert model.recall >= 0.95 and model.shortlist == 8 and len(model.books) > N.PARTS
    some, index = df.where("cast(video_id as int) % 30 = 0"), ann.index_of(rows, model)
    by_scan, by_rounds = ({(r["src_id"]): [(e["video_id"], round(e["away"], 5)) for e in r["top"]] for r in f(some, index, 20, 5).collect()} for f in (N._scanned_lists, N.shortlisted))
    assert by_scan == by_rounds and len(by_scan) == 100


def test_many_probes_shuffle_no_shortlists(spark):
    """Of shortlists by codes only the k best leave a task, ranked by the vectors; nothing is joined with 8 k rows a query."""
    df = vectors(spark, clustered(10, 1200, 40))
    index = ann.index_of(ann.placed(df, ann.Model(*N.train_index(df, 30))), ann.Model(*N.train_index(df, 30)))
    plan = N.ivf_knn(df, index, df, 5, 12)
    groups, stripes = N._scan_shape(1200, 1200, 40, 16, 3 * spark.sparkContext.defaultParallelism)
    assert shuffled_rows(spark, plan) <= (groups + 2 * stripes) * 1200 < 1200 * 40
    assert plan.count() == 1200 * 5 and N.recall(plan, N.knn(df, df, 5)).first()["recall"] >= 0.9


def test_recall_holds_beyond_the_sample(spark):
    """The probes are those whose recall less two standard errors reaches what is asked, not those whose sample just does."""
    df = vectors(spark, np.random.default_rng(12).normal(size=(800, 16)))
    index, exact, some = N.build_index(df, *N.train_index(df, 16, 16)), N.knn(df, df, 5), df.limit(40)
    reached, surely = N._surely(N.ivf_knn(df, index, df, 5, 9), exact)
    assert reached == N.recall(N.ivf_knn(df, index, df, 5, 9), exact).first()["recall"] and reached - 0.03 < surely < reached
    assert N._surely(N.knn(some, df, 5), N.knn(some, df, 5)) == (1.0, 1.0)
    probes, shortlist, mean = N.measured_probes(index, df, 5, reached, 800)
    assert probes > 9 or shortlist > 8


def test_fit_is_bounded(monkeypatch):
    """However many training rows there are, code books are made of BOOK_TRAINING of them, and nearest centroids found in single precision."""
    x = clustered(13, 3000, dim=8)
    monkeypatch.setattr(N, "BOOK_TRAINING", 700)
    assert (N._books(x, 4) == N._books(x[:700], 4)).all()
    near, c = N._nearest(x, x[:50], True), x[:50]
    assert (near == (x @ c.T).argmax(1)).mean() > 0.999 and N._nearest(x, c).dtype == np.int64
