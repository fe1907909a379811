"""Small exact cases of the catalogue's operators."""

import json

import pytest
from pyspark.sql import functions as F

from quarry import config as C
from quarry import schemas
from quarry.functions import scalars as S
from quarry.operators import catalogue as K
from quarry.operators import crawl as R
from quarry.operators import events as E
from quarry.operators import feeds as P
from quarry.operators import likes as L
from quarry.operators import similarity as N
from quarry.operators import tables as T
from quarry.sources import hosts, live, pages, stores


def events(spark, *rows):
    return spark.createDataFrame([(i, n, t, "u", "h") for n, (i, t) in enumerate(rows)], "event_id string, arrival long, event_type string, video_uuid string, instance_domain string")


def one(df):
    r = df.first()
    return r["likes_count"], r["undo_likes_count"], r["comments_count"], r["signal_score"]


def test_signals(spark):
    e = events(spark, ("a", "Like"), ("a", "Like"), ("b", "UndoLike"), ("c", "Comment"))
    assert one(E.signals(E.first_arrivals(e))) == (0, 1, 1, 0.25)
    assert one(E.signals(events(spark, ("a", "UndoLike")))) == (-1, 1, 0, -1.0)
    assert one(E.signals(events(spark, ("a", "UndoLike"), ("b", "Like")))) == (0, 1, 0, 0.0)


def test_signals_fold(spark):
    """The closed form equals the fold, event by event."""
    import random

    random.seed(5)
    rows, want = [], {}
    for v in range(40):
        state = None
        for n in range(random.randint(1, 12)):
            t = random.choice(list(S.EVENT_DELTAS))
            rows.append((f"{v}-{n}", n, t, f"u{v}", "h"))
            d = S.EVENT_DELTAS[t]
            state = list(d) if state is None else [max(0, a + b) for a, b in zip(state, d)]
        want[f"u{v}"] = tuple(state)
    df = spark.createDataFrame(rows, "event_id string, arrival long, event_type string, video_uuid string, instance_domain string")
    got = {r["video_uuid"]: (r["likes_count"], r["undo_likes_count"], r["comments_count"], r["signal_score"]) for r in E.signals(df).collect()}
    assert got == want


def test_rejects(spark):
    bad = events(spark, ("a", "Like"), ("b", "Share"), (" ", "Like"))
    ok, no = E.split(bad)
    assert ok.count() == 1 and {r["reason"] for r in no.collect()} == {"unsupported event_type", "no event_id"}


def test_moderation(spark):
    rows = spark.createDataFrame([("v1", "ch_allowed", "allowed.example"), ("v2", "ch_blocked", "allowed.example"), ("v3", "ch_deny", "deny.example")], "video_id string, channel_id string, instance_domain string")
    deny = spark.createDataFrame([("Deny.example.", 1), ("allowed.example", 0)], "host string, is_active int")
    mod = spark.createDataFrame([("ch_blocked", "allowed.example", "blocked")], "channel_id string, instance_domain string, status string")
    assert [r["video_id"] for r in K.moderate(rows, deny, mod).collect()] == ["v1"]
    c = K.moderation_counts(rows, deny, mod).first()
    assert (c["denied"], c["blocked"]) == (1, 1)


def test_hosts(spark):
    x = spark.createDataFrame([("HTTPS://user@A.example:443/p?q",), ("b.example:9000",), (" .c.example. ",), ("a b",), ("",), (None,)], "x string")
    got = [tuple(r) for r in x.select(S.normalize_host("x"), S.host_token("x")).collect()]
    assert got == [("a.example", "a.example"), ("b.example", "b.example:9000"), ("c.example", "c.example"), (None, None), (None, None), (None, None)]


def test_allow_list(spark, tmp_path):
    for k, body in enumerate(({"total": 2, "data": [{"host": " A.example"}, {"host": "b.example"}]}, [{"host": "a.example"}, {"host": "b.example"}], ["a.example", "B.example"])):
        (tmp_path / f"{k}.json").write_text(json.dumps(body))
        assert {r["host"] for r in hosts.from_json(spark, str(tmp_path / f"{k}.json")).collect()} == {"a.example", "b.example"}
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        hosts.from_json(spark, str(tmp_path / "e.json"))
    (tmp_path / "h.txt").write_text("# all\n\nA.example\na.example\n")
    assert [r["host"] for r in hosts.from_text(spark, str(tmp_path / "h.txt")).collect()] == ["a.example"]
    hosts.to_text(spark.createDataFrame([("b.example",), ("a.example",), ("b.example",)], "host string"), str(tmp_path / "out"))
    assert sorted(r["host"] for r in hosts.from_text(spark, str(tmp_path / "out")).collect()) == ["a.example", "b.example"]


def test_pages():
    body = {0: {"total": 70, "data": [{"id": i} for i in range(50)]}, 50: {"total": 70, "data": [{"id": i} for i in range(50, 70)]}}
    assert len(list(pages.read_all(lambda s: json.dumps(body[s])))) == 70


def test_merge_rules(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, t string, p double")
    b = spark.createDataFrame([(2, None), (3, "w")], "k int, t string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(T.insert_only(a, b, ["k"])) == [(1, "x", 1.0), (2, "y", 2.0), (3, "w", None)]
    assert rows(T.insert_or_replace(a, b, ["k"])) == [(1, "x", 1.0), (2, None, None), (3, "w", None)]
    assert rows(T.upsert(a, b, ["k"])) == [(1, "x", 1.0), (2, None, 2.0), (3, "w", None)]
    assert rows(T.upsert(a, b, ["k"], keep_if_null=True)) == [(1, "x", 1.0), (2, "y", 2.0), (3, "w", None)]
    with pytest.raises(ValueError):
        T.merge_tables({"t": a}, {"t": b}, [{"name": "t", "strategy": "NONE", "keys": ["k"]}])


def test_store(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path))
    assert s.read("edges").count() == 0
    e = spark.createDataFrame([("a", "b")], schemas.TABLES["edges"])
    s.write("edges", e, 1)
    s.merge("edges", spark.createDataFrame([("a", "b"), ("b", "c")], schemas.TABLES["edges"]), ["source_host", "target_host"], "INSERT_ONLY", 2)
    assert s.read("edges").count() == 2


def test_quotas():
    assert list(C.fetch_limits(C.HOME, True).values()) == [10, 25, 5, 4, 4]
    assert C.fetch_limits(C.GUEST_HOME, False) == {"popular": 20, "random": 57, "fresh": 19}
    assert C.profile_for("home", False) is C.GUEST_HOME and C.profile_for("upnext", True) is C.UPNEXT


def test_likes_check(spark):
    df = spark.createDataFrame([(0, "   ", "example.com")], "position int, uuid string, host string")
    r = K.bad_like(df, 5).first()
    assert (r["received"], r["too_many"], r["first_bad"]) == (1, False, 0)


def test_rate_limit(spark):
    rows = [("k", t, t) for t in (0, 10, 20, 30, 1005, 1012)]
    got = E.rate_limited(spark.createDataFrame(rows, "key string, at long, request long"), 2, 1000).orderBy("at").collect()
    assert [r["allowed"] for r in got] == [True, True, False, False, True, True]


def test_cap_keeps_rows_without_channel(spark):
    df = spark.createDataFrame([(str(i), None, "h", i) for i in range(5)], "video_id string, channel_id string, instance_domain string, n int")
    assert K.capped(df, [F.col("n")], 1, 0).count() == 5


def test_reachable_has_no_depth_limit(spark):
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}") for i in range(30)] + [("h30", "h4")], "source_host string, target_host string")
    got = {r["host"]: r["depth"] for r in T.reachable(edges, spark.createDataFrame([("h0",)], "host string")).collect()}
    assert got == {f"h{i}": i for i in range(31)}
    assert T.reachable(edges.limit(0), spark.createDataFrame([("h0",)], "host string")).count() == 1


def test_errors_are_counted_once_a_row(spark):
    t = spark.createDataFrame([("a", 1, None), ("b", None, "old")], "k string, error_count int, last_error string")
    bad = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "z")], "k string, message string")
    assert sorted(map(tuple, T.count_errors(t, bad, ["k"]).collect())) == [("a", 3, "y"), ("b", None, "old")]


def test_tags_of_json_strings(spark):
    x = spark.createDataFrame([('"one tag"',), ('["a", " b "]',), ("plain",), (None,)], "x string")
    assert [r[0] for r in x.select(S.parse_tags("x")).collect()] == [["one tag"], ["a", "b"], ["plain"], []]


def test_signals_on_top_of_stored(spark):
    """Batches on top of each other give what one fold over all events gives, whatever the slices."""
    import random

    rng = random.Random(6)
    rows = [(str(n), n * 40_000, rng.choice(list(S.EVENT_DELTAS)), f"u{rng.randint(0, 5)}", "h") for n in range(200)]
    schema = "event_id string, arrival long, event_type string, video_uuid string, instance_domain string"
    want, stored, signals = {}, spark.createDataFrame([], schema), None
    for _, _, t, u, _ in rows:
        want[u] = list(S.EVENT_DELTAS[t]) if u not in want else [max(0, a + b) for a, b in zip(want[u], S.EVENT_DELTAS[t])]
    signals = E.signals(stored)
    for k in range(0, 200, 67):
        batch = spark.createDataFrame(rows[max(0, k - 5) : k + 67], schema)
        new, touched, _ = E.ingest(batch, stored, signals)
        new, touched = T.settled(new), T.settled(touched)
        stored, signals = stored.unionByName(new), signals.join(touched.select(*E.KEY), E.KEY, "left_anti").unionByName(touched)
    got = {r["video_uuid"]: [r["likes_count"], r["undo_likes_count"], r["comments_count"], r["signal_score"]] for r in signals.collect()}
    assert got == want and stored.count() == 200
    whole = {r["video_uuid"]: r["likes_count"] for r in E.signals(spark.createDataFrame(rows, schema)).collect()}
    assert whole == {u: x[0] for u, x in want.items()}


def vectors(spark, rows):
    return spark.createDataFrame([(str(i), "h", v) for i, v in enumerate(rows)], "video_id string, instance_domain string, embedding array<float>")


def test_knn_skips_bad_vectors(spark):
    good = [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0]]
    df = vectors(spark, [*good, None, [1.0], [float("nan"), 1.0], [], [None, 1.0]])
    got = {(r["src_id"], r["rank"]): r["video_id"] for r in N.knn(df, df, 2).collect()}
    assert got == {("0", 1): "1", ("0", 2): "2", ("1", 1): "0", ("1", 2): "2", ("2", 1): "1", ("2", 2): "0"}
    assert N.knn(df.limit(0), df, 2).count() == 0 and N.knn(df, df.limit(0), 2).count() == 0


def test_knn_in_blocks(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(90, 6)).round(2)
    df = vectors(spark, x.tolist())
    few = sorted(map(tuple, N.knn(df, df, 4).collect()))
    monkeypatch.setattr(N, "BLOCK", 20)
    assert sorted(map(tuple, N.knn(df, df, 4).collect())) == few and len(few) == 360


def shuffled_rows(spark, df):
    """Rows that the exchanges of df's plan write."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        nodes, rows = [df._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            written = node.metrics().get("shuffleRecordsWritten")
            rows += written.get().value() if node.nodeName() == "Exchange" and written.isDefined() else 0
        return rows
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_knn_scan_sends_no_pairs(spark, monkeypatch):
    """Groups of queries by stripes of vectors: equal scores by key, and a vector travels once a group, a query and its list twice a stripe."""
    import numpy as np

    x = np.random.default_rng(3).integers(-1, 2, size=(90, 6)).astype(float)
    df = vectors(spark, x.tolist())
    for name, size in (("BLOCK", 20), ("HELD", 120), ("STRIPE", 180)):
        monkeypatch.setattr(N, name, size)
    plan = N.knn(df, df, 4)
    score = np.round(x @ x.T, 6)
    want = {(str(i), r + 1): (j, score[i, int(j)]) for i in range(90) for r, j in enumerate(sorted((str(j) for j in range(90) if j != i), key=lambda j: (-score[i, int(j)], j))[:4])}
    assert {(r["src_id"], r["rank"]): (r["video_id"], r["score"]) for r in plan.collect()} == want
    groups, stripes = N._scan_shape(90, 90, 4, 6, 12)
    assert groups > 1 and stripes > 1 and shuffled_rows(spark, plan) <= (groups + 2 * stripes) * 90 < 5 * 90 * 4


def test_scan_scores_few_pairs_twice(monkeypatch):
    """Exact search makes its scores in single precision and only what may be among the k best again in double precision; vectors too long for that are exact too."""
    import numpy as np

    rng = np.random.default_rng(5)
    q, v, k = rng.normal(size=(120, 16)), rng.normal(size=(4000, 16)), 5
    q, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, v))
    v[1000:1010] = v[0]  # equal scores
    v[:120] = q
    rank, own, pairs, dots = rng.permutation(len(v)), np.arange(120), [], N._dots
    monkeypatch.setattr(N, "_dots", lambda q, row, v, place: pairs.append(len(row)) or dots(q, row, v, place))
    monkeypatch.setattr(N, "STEP_VECTORS", 300)
    for lengths, kind in ((1.0, np.float32), (10.0 ** rng.integers(-3, 4, (len(v), 1)), np.float32), (1e19, np.float64)):
        pairs.clear()
        tops = N._Tops(q, v * lengths, k, rank, own)
        N._meet_all(tops, np.arange(120), 0, len(v))
        tops.settle()
        score = np.round(np.einsum("ij,kj->ik", q, v * lengths), 6)
        score[own, own] = -np.inf
        want = np.lexsort((np.broadcast_to(rank, score.shape), -score))[:, :k]
        if kind is np.float32:
            assert (tops.at == want).all()
        assert tops.kind is kind and np.allclose(tops.score, np.take_along_axis(score, want, 1)) and sum(pairs) < 120 * 4000 / 20


def test_cache_policy(spark):
    items = spark.createDataFrame([("0", "h", "1", "h", 0.9, 1), ("2", "h", "1", "h", None, 1)], schemas.TABLES["similarity_items"])
    df = vectors(spark, [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0]])
    run = lambda **p: [df_.count() for df_ in N.similar_candidates(df, df, items, 2, N.CachePolicy(**p))]
    assert run() == [5, 2] and run(allow_write=False) == [5, 0] and run(refresh=True) == [6, 6] and run(require_full=True) == [6, 2] and run(allow_compute=False) == [1, 0]


def test_bodies_and_probes():
    assert live.json_body(b'{"a": 1}') == {"a": 1} and live.json_body(b"") == {}
    for bad in (b"[1]", b"{", b"x" * (live.MAX_BODY + 1)):
        with pytest.raises(ValueError):
            live.json_body(bad)
    assert live.total_of('{"total": 3}') == 3
    for bad in ('{"total": -1}', '{"total": true}', "{}"):
        with pytest.raises(ValueError):
            live.total_of(bad)


def test_retries_and_fallback():
    import urllib.error

    waits, calls = [], []

    def fetch(url):
        calls.append(url)
        if url.startswith("https"):
            raise urllib.error.URLError("refused")
        return "ok"

    assert live.with_fallback(fetch, "h/x", 3, waits.append) == "ok" and calls == ["https://h/x"] * 3 + ["http://h/x"] and waits == [1.0, 2.0]
    answers = iter([429, 503, 429, 200])

    def server():
        code = next(answers)
        if code != 200:
            raise urllib.error.HTTPError("u", code, "", {"Retry-After": "7"}, None)
        return "done"

    waits.clear()
    assert pages.with_retry(server, 2, waits.append) == "done" and waits == [7.0, 1.0, 7.0]
    with pytest.raises(urllib.error.HTTPError):
        pages.with_retry(lambda: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "", {}, None)), 3, waits.append)


def test_page_source(spark, tmp_path):
    for host, n in (("a.example", 120), ("b.example", 50)):
        (tmp_path / host).mkdir()
        for start in range(0, n + 1, 50):
            (tmp_path / host / f"videos-{start}.json").write_text(json.dumps({"total": n, "data": [{"uuid": f"{host}-{i}", "name": f"n{i}"} for i in range(start, min(n, start + 50))]}))
    pages.register(spark)
    items = spark.read.format("catalogue_pages").option("hosts", "a.example, b.example").option("folder", str(tmp_path)).load()
    assert items.groupBy("host").count().orderBy("host").collect() == [("a.example", 120), ("b.example", 50)]
    known = json.dumps([f"a.example-{i}" for i in range(0, 120) if i != 110])
    some = spark.read.format("catalogue_pages").option("hosts", "a.example,b.example").option("folder", str(tmp_path)).option("known", known)
    assert some.load().groupBy("host").count().orderBy("host").collect() == [("a.example", 1), ("b.example", 50)]
    assert some.option("stop_after", "2").option("limit", "7").load().groupBy("host").count().collect() == [("b.example", 7)]
    rows = pages.video_rows(items, 5)
    assert rows.count() == 170 and rows.where("video_id = 'a.example-7' and title = 'n7'").count() == 1


def test_rate_limit_at_size(spark):
    from collections import deque

    import numpy as np

    rng = np.random.default_rng(7)
    rows = sorted((f"k{min(9, int(rng.exponential(2)))}", int(t), i) for i, t in enumerate(rng.integers(0, 200_000, 6000)))
    want, times = {}, {}
    for key, at, request in rows:
        own = times.setdefault(key, deque())
        while own and own[0] <= at - 5000:
            own.popleft()
        want[request] = len(own) < 4
        if want[request]:
            own.append(at)
    got = {r["request"]: r["allowed"] for r in E.rate_limited(spark.createDataFrame(rows, "key string, at long, request long"), 4, 5000).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_store_of_several_tables(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "s"))
    e = spark.createDataFrame([("a", "b")], schemas.TABLES["edges"])
    for k in range(3):
        s.write_all({"edges": e.limit(k % 2 + 0 * k), "likes": spark.createDataFrame([], schemas.TABLES["likes"])}, 1)
    assert len(s.versions("edges")) == 3 and s.read("edges").count() == 0 and s.backup("edges", str(tmp_path / "b")) and s.backup("channels", str(tmp_path / "b")) is None
    assert s.drop_old("edges") == 2 and s.read("edges").count() == 0


def test_unknown_names_raise(spark):
    for f in (lambda: L.like_source("none", None, None, "s"), lambda: L.strategy("none"), lambda: K.with_popularity(None, "none", 0), lambda: R.selected_hosts(spark.createDataFrame([("a",)], "host string"), spark.createDataFrame([("a",)], "host string"), None, "none"), lambda: P.ordered_layers(C.HOME, ["none"])):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(PermissionError):
        P.with_debug(spark.range(1), allowed=False)
    assert list(P.ordered_layers(C.HOME, ["fresh"]).layers)[:2] == ["fresh", "explore"]


def test_encoder_can_be_given(spark):
    t = spark.createDataFrame([("1", "h", "a b"), ("2", "h", None), ("3", "h", "c")], "video_id string, instance_domain string, text string")
    own = lambda text: F.array(F.length(text).cast("float"))
    got = {r["video_id"]: r["embedding"] for r in N.encode_missing(t, t.where("video_id = '3'"), own).collect()}
    assert got == {"1": [3.0]} and N.encode_missing(t, t, own, force=True).count() == 2


def test_layer_minimums_and_caps(spark):
    """A mixed page with minimums and maximums by layer against a plain fold."""
    import random
    from dataclasses import replace

    rng = random.Random(8)
    cols = "video_id string, instance_domain string, channel_id string, published_at long, views long, likes long, similarity_score double, position int"
    rows = {n: [(f"v{rng.randint(0, 60)}", "h", "c", 10**12, rng.randint(0, 9999), 1, 0.0, k + 1) for k in range(30)] for n in ("popular", "random", "fresh")}
    profile = replace(C.GUEST_HOME, max_per_layer={"random": 6, "fresh": 12}, min_per_layer={"fresh": 3, "popular": 2}, batch=24)
    page = P.mix({n: spark.createDataFrame(list({r[0]: r for r in own}.values()), cols) for n, own in rows.items()}, profile, 2 * 10**12).orderBy("rank_after").collect()
    whole = P.mix({n: spark.createDataFrame(list({r[0]: r for r in own}.values()), cols) for n, own in rows.items()}, replace(profile, max_per_layer={"none": 1}, min_per_layer={}), 2 * 10**12).orderBy("rank_after").collect()
    layers = [r["layer"] for r in page]
    assert layers[:3] == ["fresh"] * 3 and layers[3:5] == ["popular"] * 2 and layers.count("random") <= 6 and layers.count("fresh") <= 12
    assert len({r["video_id"] for r in page}) == len(page) <= len(whole) <= 24


def test_encoder_gets_small_lists(spark):
    """An encoder never gets more texts at once than asked for, and every text is encoded once."""
    t = spark.createDataFrame([(str(i), "h", None if i == 7 else "x" * i) for i in range(150)], "video_id string, instance_domain string, text string").coalesce(1)
    encoder = N.batched_encoder(lambda texts: [[len(x), len(texts)] for x in texts], 20)
    got = {r["video_id"]: r["embedding"] for r in N.encode_missing(t, t.limit(0), encoder).collect()}
    assert len(got) == 149 and all(got[k][0] == int(k) and got[k][1] <= 20 for k in got)


def test_given_search_fills_the_cache(spark):
    """Similar videos by a function that a caller gives instead of the search."""
    df = vectors(spark, [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0]])
    items = spark.createDataFrame([], schemas.TABLES["similarity_items"])
    own = lambda seeds, k: seeds.selectExpr("video_id src_id", "instance_domain src_host", "'given' video_id", "'g' instance_domain", "0.5D score", "1 rank")
    found, new = N.similar_candidates(df, df, items, 2, N.CachePolicy(), own)
    assert {r["similar_video_id"] for r in found.collect()} == {"given"} and new.count() == 3
