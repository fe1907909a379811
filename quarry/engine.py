"""The engine's calls over stored tables: what a serving layer would ask for."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .functions import scalars as S
from .jobs import Lease, Run
from .operators import ann
from .operators import catalogue as K
from .operators import events as E
from .operators import feeds as P
from .operators import moderation as M
from .operators import similarity as N
from .operators import tables as T
from .schemas import conform
from .sources.stores import Store


class Engine:
    def __init__(self, spark: SparkSession, store: Store, now_ms: int, seed: str = "0"):
        self.spark, self.store, self.now_ms, self.seed = spark, store, now_ms, seed

    def _t(self, name: str) -> DataFrame:
        """The current rows of a table; of signals, to which changes are appended, each video's latest."""
        rows = self.store.read(name)
        return E.latest(rows) if name == "interaction_signals" else rows

    def _nearest(self) -> Callable[[DataFrame, int], DataFrame] | None:
        """Search by the stored index, if there is one."""
        return ann.StoredIndex(self.store).nearest if ann.StoredIndex.exists(self.store) else None

    def build_index(self, at: int, **options) -> ann.StoredIndex:
        """Store an index of all embeddings, which similar and recommend search from then on."""
        return ann.StoredIndex.build(self.store, self._t("video_embeddings"), at, **options)

    def extend_index(self, at: int) -> int:
        """Append the embeddings that the index lacks; how many."""
        return ann.StoredIndex(self.store).add(self._t("video_embeddings"), at)

    def likes_frame(self, likes: Sequence[tuple[str, str]]) -> DataFrame:
        return self.spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(likes)], "position int, uuid string, host string")

    def resolve(self, likes: Sequence[tuple[str, str]]) -> DataFrame:
        return K.resolve(self.likes_frame(likes), self._t("videos")).orderBy("position")

    def metadata(self, entries: DataFrame) -> DataFrame:
        return K.metadata_of(entries, self._t("video_embeddings"), self._t("videos"), self._t("channels"))

    def recommend(self, likes: Sequence[tuple[str, str]] = (), mode: str = "home", debug: bool = False, debug_allowed: bool = False) -> DataFrame:
        """A page for the likes (uuid, host); too many or bad likes raise with what is wrong, and debug where it is not allowed."""
        if debug and not debug_allowed:
            raise PermissionError("debug columns are disabled")
        liked = None
        if likes:
            check = K.bad_like(self.likes_frame(likes), C.CLIENT_LIKES).first()
            if check["too_many"]:
                raise ValueError(f"max_allowed {C.CLIENT_LIKES}, received {check['received']}")
            if check["first_bad"] is not None:
                raise ValueError(f"like {check['first_bad']}: uuid and host are needed")
            known = self.resolve(likes).limit(C.LIKES_FOR_FEED)
            liked = known.join(self._t("video_embeddings").select(*K.KEY, "embedding"), K.KEY)
            liked = None if liked.isEmpty() else liked
        layers = P.Candidates(self._t("videos"), self._t("video_embeddings"), self._t("interaction_signals"), liked, self.seed, search=self._nearest())
        page = P.feed(layers, C.profile_for(mode, liked is not None), self.now_ms, self._t("instance_denylist"), self._t("channel_moderation"))
        return P.with_debug(page) if debug else page

    def random(self, limit: int = C.BATCH) -> DataFrame:
        """The random feed: from the stored cache, else from the videos."""
        cache = self._t("random_rowids")
        videos = K.with_signals(self._t("videos").where(K.usable()), self._t("interaction_signals"))
        rows = K.shuffled(videos, self.seed, limit) if cache.isEmpty() else videos.join(K.cache_window(cache, 0, limit).select(*K.KEY, "position"), K.KEY).orderBy("position")
        return K.moderate(K.with_channel(rows, self._t("channels")), self._t("instance_denylist"), self._t("channel_moderation"))

    def similar(self, ref: str, host: str | None = None, limit: int = C.BATCH, likes: DataFrame | None = None, policy: N.CachePolicy = N.CachePolicy(), at: int | None = None) -> DataFrame:
        """Videos like one: from the cache if its list is valid, else searched (and the new list stored, where policy and ``at`` allow); one a channel; ordered by unified score."""
        videos, embeddings, items = self._t("videos"), self._t("video_embeddings"), self._t("similarity_items")
        seed = K.lookup(videos, self._t("channels"), ref, host).join(embeddings.select(*K.KEY, "embedding"), K.KEY)
        if seed.isEmpty():
            raise LookupError(f"no embedding for {ref}")
        near, new = N.similar_candidates(seed, embeddings, items, C.SEARCH_LIMIT, policy, self._nearest())
        if at is not None and not new.isEmpty():
            self.store.write("similarity_items", N.store_similar(items, new), at)
        found = near.select(F.col("similar_video_id").alias("video_id"), F.col("similar_instance_domain").alias("instance_domain"), F.col("score").alias("similarity_score"), "rank")
        rows = videos.where(K.usable()).join(found, K.KEY)
        page = P.related(K.capped(rows, [F.col("rank")], C.SIMILAR_AUTHOR_CAP, 0).drop("rank"), C.UPNEXT, self.now_ms, limit)
        page = page.withColumn("rank_after", F.col("rank")) if likes is None else P.personalized(page, embeddings, likes, C.RELATED_ALPHA, C.RELATED_BETA)
        return K.moderate(page, self._t("instance_denylist"), self._t("channel_moderation"))

    def search(self, vector: Sequence[float], limit: int = C.BATCH) -> DataFrame:
        """By a vector; one without length gives the random feed."""
        length = sum(x * x for x in vector) ** 0.5
        if not length:
            return self.random(limit)
        near = N.search(self._t("video_embeddings"), [x / length for x in vector], limit + 5)
        return self._t("videos").where(K.usable()).join(near, K.KEY).orderBy(F.desc("score"), "video_id").limit(limit)

    def channels(self, **filters) -> DataFrame:
        return K.channels(self._t("channels"), **filters)

    def video(self, ref: str, host: str | None = None) -> DataFrame:
        return K.lookup(self._t("videos"), self._t("channels"), ref, host)

    def health(self) -> DataFrame:
        return N.health(self._t("video_embeddings"))

    def ingest(self, events: DataFrame, at: int) -> DataFrame:
        """Store new valid events (with arrival) and the signals of the videos they touch, both or neither; the rejects are returned.

        Both are appended, so what is written follows the batch.  The latest row of a video counts.
        """
        stored, old = self._t("interaction_raw_events"), self._t("interaction_signals")
        good, bad = E.split(events)
        new = T.settled(E.first_arrivals(good, stored))  # both tables are of the same rows
        touched = E.signals(new, old).drop("last_arrival").withColumns({"updated_at": F.lit(at).cast("long"), "version": F.lit(time.time_ns())})
        rows = conform(new.withColumn("ingested_at", F.lit(at).cast("long")), "interaction_raw_events")
        added = {"interaction_raw_events": rows, "interaction_signals": conform(touched, "interaction_signals")}
        self.store.write_all(added, at, added=frozenset(added))
        return bad

    def compact(self, at: int, parts: int = 16) -> list[str]:
        """Write tables of more than so many appends as one part, of signals the latest rows only; which were."""
        done = [n for n in ("interaction_raw_events",) if self.store.compact(n, at, parts)]
        if len(self.store.version("interaction_signals") or []) > parts:
            self.store.write("interaction_signals", self._t("interaction_signals"), at)
            done.append("interaction_signals")
        if ann.StoredIndex.exists(self.store) and ann.StoredIndex(self.store).compact(at, parts):
            done.append("ann_lists")
        return done

    def block_host(self, host: str, at: int, purge: bool = False, yes: bool = False) -> DataFrame:
        """Deny a host; with purge and yes its rows go too.  The counts of what a purge concerns are returned."""
        one = self.spark.createDataFrame([(host,)], "host string").select(S.normalize_host("host").alias("host"), F.lit(1).alias("is_active"), F.lit(at).cast("long").alias("updated_at"))
        self.store.write("instance_denylist", T.upsert(self._t("instance_denylist"), one, ["host"]), at)
        left, counts = M.purge({n: self._t(n) for n in M.HOST_COLUMNS}, one, dry_run=not (purge and yes))
        counts = counts.collect()
        if purge and yes:
            self.store.write_all({**left, "similarity_items": N.purge_similar(self._t("similarity_items"), one)}, at)
        return self.spark.createDataFrame(counts, "table_name string, n long")

    def set_channels(self, changes: DataFrame, at: int) -> None:
        """Verdicts on channels (channel_id, instance_domain, status, reason, source_video_url)."""
        self.store.write("channel_moderation", M.set_status(self._t("channel_moderation"), changes, at), at)

    def moderated(self, status: str | None = None, host: str | None = None) -> DataFrame:
        return M.listed_channels(self._t("channel_moderation"), status, host)

    def act(self, user: str | None, actions: DataFrame, at: int, most: int = C.MAX_LIKES) -> DataFrame:
        """A user's actions (action_id, action, video_uuid, instance_domain) at one time: likes recorded or removed, events published and returned."""
        who = self.spark.range(1).select(S.user_or_default(F.lit(user))).first()[0]
        mine = actions.withColumns({"user_id": F.lit(who), "at": F.lit(at).cast("long"), "event_type": S.action_event("action")}).where("event_type is not null")
        known = mine.join(self._t("videos").select(*K.KEY, "video_uuid"), ["video_uuid", "instance_domain"])
        rows = known.select("user_id", *K.KEY, "video_uuid", F.col("at").alias("updated_at"), F.col("action_id").cast("string").alias("event_id"), "event_type")
        likes = self._t("likes")
        likes = E.record_likes(likes, rows.where("event_type = 'Like'").drop("event_type"), most)
        self.store.write("likes", E.remove_likes(likes, rows.where("event_type = 'UndoLike'")), at)
        return E.published(mine)

    def profile(self, user: str | None, limit: int = C.MAX_LIKES) -> DataFrame:
        """A user's likes, newest first."""
        return E.recent_likes(self._t("likes").where(F.col("user_id") == S.user_or_default(F.lit(user))), limit).orderBy("position")

    def reset_profile(self, user: str | None, at: int) -> None:
        gone = self.spark.range(1).select(S.user_or_default(F.lit(user)).alias("user_id"))
        self.store.write("likes", E.clear_likes(self._t("likes"), gone), at)

    def refresh_video(self, live: DataFrame, at: int) -> None:
        """Freshly fetched videos put into the stored ones, and their hosts' last errors cleared, both or neither."""
        instances = self._t("instances")
        touched = live.select(F.col("instance_domain").alias("host")).distinct()
        clean = touched.select("host", *[F.lit(None).cast(instances.schema[c].dataType).alias(c) for c in ("last_error", "last_error_at", "last_error_source")])
        self.store.write_all({"videos": K.refreshed(self._t("videos"), live, at), "instances": T.patch(instances, clean, ["host"], ["last_error", "last_error_at", "last_error_source"])}, at)

    def unblock_host(self, host: str, at: int) -> None:
        """The row stays, inactive."""
        one = self.spark.createDataFrame([(host,)], "host string").select(S.normalize_host("host").alias("host"), F.lit(0).alias("is_active"), F.lit(at).cast("long").alias("updated_at"))
        self.store.write("instance_denylist", T.patch(self._t("instance_denylist"), one, ["host"], ["is_active", "updated_at"]), at)

    def refresh(self, stage: dict[str, DataFrame], rules: Sequence[dict], at: int, top_k: int = C.SIMILAR_PER_LIKE, least_recall: float = 0.9, lease: Lease | None = None) -> dict[str, int]:
        """Batch refresh: deltas, merge, denylist prune, popularity, a new index, similarity by it (with the probes that reach least_recall on a sample).

        All tables become current by one commit after the last stage; a failure before leaves
        every old version current, and another call with the same ``at`` goes on after the last finished stage.
        """
        run = Run(self.store, f"refresh-{at}", lease)
        prod = {r["name"]: self._t(r["name"]) for r in rules}
        deltas = run.stage("deltas", dict, note=lambda: {r["name"]: r["n"] for r in T.delta_counts({r["name"]: (prod[r["name"]], stage[r["name"]], r["keys"]) for r in rules}).collect()})["note"]
        if run.committed:
            return deltas
        denied = self._t("instance_denylist").where("is_active = 1")

        def merged(name: str, df: DataFrame) -> dict[str, DataFrame]:
            kept = T.without_hosts(df, denied, "host" if name == "instances" else "instance_domain")
            if name == "videos":
                kept = kept.withColumn("popularity", F.when(F.coalesce("popularity", F.lit(0.0)) == 0, S.popularity("views", "likes", "published_at", self.now_ms)).otherwise(F.col("popularity")))
            return {name: kept}

        stages = {name: run.stage(f"merge-{name}", lambda name=name, df=df: merged(name, df)) for name, df in T.merge_tables(prod, stage, rules).items()}
        e = run.read(stages["video_embeddings"], "video_embeddings") if "video_embeddings" in stages else self._t("video_embeddings")

        def indexed() -> dict[str, DataFrame]:
            model, rows = ann.trained(e, least_recall, min(top_k, 10))
            return {"ann_model": model.frame(self.spark, at), "ann_lists": ann.by_list(rows)}

        def similar() -> dict[str, DataFrame]:
            model = ann.Model.of(run.read(stages["index"], "ann_model").first())
            rows = run.read(stages["index"], "ann_lists")
            near = N.ivf_knn(rows, ann.index_of(rows, model), rows, top_k, model.probes, model.shortlist)
            return {"similarity_items": near.select(F.col("src_id").alias("source_video_id"), F.col("src_host").alias("source_instance_domain"), F.col("video_id").alias("similar_video_id"), F.col("instance_domain").alias("similar_instance_domain"), "score", "rank")}

        stages["index"] = run.stage("index", indexed, {"ann_lists": ["list_id"]})
        stages["similar"] = run.stage("similar", similar)
        run.commit(list(stages.values()), at)
        return deltas
