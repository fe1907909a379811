"""Feeds: candidate layers, scoring, quota mixing, related videos."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import NEEDS_LIKES, POOL, Layer, Profile, fetch_limits, shares
from ..functions import scalars as S
from . import similarity as V
from .catalogue import KEY, capped, moderate, ranked_popular, shuffled, stable, usable, with_signals
from .tables import settled


def sampled(pool: DataFrame, limit: int, seed: str, order: list[Column]) -> DataFrame:
    """limit rows at random (by seed); a pool that is not larger stays, in its order.  The position is kept.

    One row more than the limit, by lot, tells whether the pool is larger, so no window sees more.
    """
    total = F.count("*").over(W.partitionBy())
    lot = S.seeded(seed, S.like_key("video_id", "instance_domain"))
    df = pool.orderBy(lot, *order, "video_id").limit(limit + 1).withColumn("_many", total > limit)
    pos = F.row_number().over(W.orderBy(F.when(F.col("_many"), lot), *order, "video_id"))  # limit + 1 rows
    return df.withColumn("position", pos).where(F.col("position") <= limit).drop("_many")


def in_range(rows: DataFrame, low: float | None, high: float | None) -> DataFrame:
    c = F.lit(True)
    if low is not None:
        c = c & (F.col("similarity_score") >= low)
    if high is not None:
        c = c & (F.col("similarity_score") < high)
    return rows.where(c)


class Candidates:
    """The layers over one catalogue; each gives video columns, similarity_score and position.

    ``search`` (queries, k) finds neighbours as :func:`similarity.knn` does, which it is without one.
    A pool of None is every usable video with an embedding (fresh, random and explore).
    ``base`` (usable videos with signals, and whether they have an embedding) is what
    all layers start from; a feed computes it once.
    """

    def __init__(self, videos: DataFrame, embeddings: DataFrame, signals: DataFrame, liked: DataFrame | None, seed: str, pools: dict[str, int | None] = POOL, search: Callable[[DataFrame, int], DataFrame] | None = None):
        self.embeddings, self.liked, self.seed, self.pools = embeddings, liked, seed, pools
        self.search = search or (lambda queries, k: V.knn(queries, embeddings.select(*KEY, "embedding"), k))
        known = embeddings.select(*KEY).distinct().withColumn("_embedded", F.lit(True))
        self.base = with_signals(videos.where(usable()), signals).join(known, KEY, "left")

    def _able(self) -> DataFrame:
        return self.base.where("_embedded").drop("_embedded", "adjusted_likes", "interaction_signal_score")

    def _scored(self, pool: DataFrame) -> DataFrame:
        if self.liked is None:
            return pool.withColumn("similarity_score", F.lit(0.0))
        return V.max_similarity(pool.join(self.embeddings.select(*KEY, "embedding"), KEY), self.liked).drop("embedding")

    def _random_pool(self, name: str, size: int | None) -> DataFrame:
        lot = S.seeded(f"{self.seed}:{name}", S.like_key("video_id", "instance_domain"))
        return (self._able() if size is None else shuffled(self._able(), f"{self.seed}:{name}", size)).withColumn("_lot", lot)

    def popular(self, layer: Layer, limit: int) -> DataFrame:
        ranked = ranked_popular(self.base, self.pools["popular"]).where("_embedded")
        pool = ranked.withColumnRenamed("position", "_lot").drop("_embedded", "adjusted_likes", "interaction_signal_score")
        kept = self._scored(capped(pool, [F.col("_lot")], layer.author_cap, layer.instance_cap))
        return sampled(kept, limit, f"{self.seed}:popular", [F.col("_lot")]).drop("_lot")

    def fresh(self, layer: Layer, limit: int) -> DataFrame:
        order = [F.desc_nulls_last("published_at"), F.desc("video_id")]
        pool = self._able() if self.pools["fresh"] is None else self._able().orderBy(*order).limit(self.pools["fresh"])
        kept = self._scored(capped(pool, order, layer.author_cap, layer.instance_cap))
        return sampled(kept, limit, f"{self.seed}:fresh", order)

    def random(self, layer: Layer, limit: int) -> DataFrame:
        """Below the threshold, if any is and there are likes; else the whole pool."""
        kept = self._scored(capped(self._random_pool("random", self.pools["random"]), [F.col("_lot")], layer.author_cap, layer.instance_cap))
        if self.liked is not None and layer.high is not None:
            low = F.col("similarity_score") < layer.high
            kept = kept.orderBy(F.coalesce(low, F.lit(False)).desc(), "_lot", "video_id").limit(limit + 1)  # those below come first
            kept = kept.withColumn("_any", F.count_if(low).over(W.partitionBy()) > 0).where(low | ~F.col("_any")).drop("_any")
        return sampled(kept, limit, f"{self.seed}:random", [F.col("_lot")]).drop("_lot")

    def explore(self, layer: Layer, limit: int) -> DataFrame:
        kept = self._scored(capped(self._random_pool("explore", self.pools["explore"]), [F.col("_lot")], layer.author_cap, layer.instance_cap))
        return sampled(in_range(kept, layer.low, layer.high), limit, f"{self.seed}:explore", [F.desc("similarity_score")]).drop("_lot")

    def exploit(self, layer: Layer, limit: int) -> DataFrame:
        """Similar to any like: each like's best, liked videos left out, the best score of each video counts."""
        near = self.search(self.liked.select(*KEY, "embedding"), self.pools["exploit"])
        best = near.groupBy(*KEY).agg(F.max("score").alias("similarity_score")).join(self.liked.select(*KEY), KEY, "left_anti")
        rows = self.base.drop("_embedded", "adjusted_likes", "interaction_signal_score").join(best, KEY)
        order = [F.desc("similarity_score"), F.col("video_id")]
        kept = in_range(capped(rows.orderBy(*order).limit(max(self.pools["exploit"], limit)), order, layer.author_cap, layer.instance_cap), layer.low, layer.high)
        return sampled(kept, limit, f"{self.seed}:exploit", order)


def score(rows: DataFrame, profile: Profile, now_ms: int, bonus: float = 0.0) -> DataFrame:
    """final score from similarity, freshness, popularity and the layer's bonus."""
    sim = S.clipped_similarity("similarity_score")
    fresh = S.freshness("published_at", now_ms, profile.half_life_days)
    pop = S.popularity_score("views", "likes", profile.views_weight, profile.likes_weight)
    return rows.withColumn("score", F.round(profile.similarity * sim + profile.freshness * fresh + profile.popularity * pop + bonus, 6))


def mix(layers: dict[str, DataFrame], profile: Profile, now_ms: int) -> DataFrame:
    """One page: layers meet by taken / target, then fill in layer order; a video once, layer caps, no refill.

    Targets need each layer's size, so the layers' rows (at most a fetch limit each) are counted once.
    """
    names = [n for n in profile.layers if n in layers]
    scored = None
    for k, n in enumerate(names):
        one = score(layers[n], profile, now_ms, profile.layers[n].bonus).withColumns({"layer": F.lit(n), "_k": F.lit(k)})
        scored = one if scored is None else scored.unionByName(one, allowMissingColumns=True)
    ranked = settled(scored.withColumn("rank_before", F.row_number().over(W.partitionBy("layer").orderBy(F.desc("score"), "position"))))  # a page's worth of rows
    have = {r["layer"]: r["count"] for r in ranked.groupBy("layer").count().collect()}
    want = shares(profile.batch, {n: profile.layers[n].ratio for n in names if have.get(n)})
    target = F.lit(0)
    for n, t in want.items():
        target = F.when(F.col("layer") == n, min(t, have[n])).otherwise(target)
    df = ranked.withColumn("_t", target)
    first = F.col("rank_before") <= F.col("_t")
    df = df.withColumn("_turn", F.when(first, (F.col("rank_before") - 1) / F.col("_t")))
    order = [(~first).cast("int"), F.when(first, F.col("_turn")), F.col("_k"), F.col("rank_before")]
    page = df.orderBy(*order).limit(profile.batch).withColumn("_pos", F.row_number().over(W.orderBy(*order)))
    least = {n: m for n, m in profile.min_per_layer.items() if n in names and m > 0}
    if least or any(m < profile.batch for m in profile.max_per_layer.values()):
        page = taken(page, profile.batch, least, {n: m for n, m in profile.max_per_layer.items() if n in names and m > 0})
    else:
        page = page.withColumn("_rn", F.row_number().over(W.partitionBy(*KEY).orderBy("_pos"))).where("_rn = 1").drop("_rn")
    return page.withColumn("rank_after", F.row_number().over(W.orderBy("_pos"))).drop("_k", "_t", "_turn", "_pos", "position")


def taken(page: DataFrame, batch: int, least: dict[str, int], most: dict[str, int], request: list[str] | None = None) -> DataFrame:
    """Rows of a page (layer, key, _pos) that are taken, with the _pos at which they are.

    Layers with a minimum come first, in their order, each until it has its minimum; then all rows
    in theirs.  A video is taken once, a layer most times at most, and a row that a
    cap refuses does not hide a later one of its video.  So each row depends on those taken
    before it: a fold over the page's rows, which are few (batch), as an expression of
    one row a request.  ``request`` names the columns of many requests' pages.
    """
    by, unbounded = request or [], 1 << 30
    fields = [F.col("_pos").cast("int").alias("pos"), F.col("layer").alias("layer"), S.like_key("video_id", "instance_domain").alias("key")]
    rows = page.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rows"))
    tries = lambda name, quota: F.transform(F.filter("_rows", lambda r: r["layer"] == name), lambda r: F.struct(r["pos"].alias("pos"), r["layer"].alias("layer"), r["key"].alias("key"), F.lit(quota).alias("quota")))
    quota = lambda layer: F.coalesce(*[F.when(layer == n, m) for n, m in most.items()], F.lit(unbounded))
    rest = F.transform("_rows", lambda r: F.struct(r["pos"].alias("pos"), r["layer"].alias("layer"), r["key"].alias("key"), quota(r["layer"]).alias("quota")))
    attempts = F.concat(*[tries(n, min(m, most.get(n, unbounded))) for n, m in least.items()], rest)

    def step(out, x):
        free = ~F.exists(out, lambda o: o["key"] == x["key"]) & (F.size(F.filter(out, lambda o: o["layer"] == x["layer"])) < x["quota"])
        one = F.array(F.struct(x["pos"].alias("pos"), x["layer"].alias("layer"), x["key"].alias("key")))
        return F.when((F.size(out) < batch) & free, F.concat(out, one)).otherwise(out)

    none = F.array().cast("array<struct<pos:int,layer:string,key:string>>")
    places = rows.select(*by, F.posexplode(F.aggregate(attempts, none, step)).alias("_at", "_row")).select(*by, (F.col("_at") + 1).alias("_at"), F.col("_row.pos").alias("_pos"))
    return page.join(places, [*by, "_pos"]).withColumn("_pos", F.col("_at")).drop("_at")


def feed(source: Candidates, profile: Profile, now_ms: int, denylist: DataFrame | None = None, moderation: DataFrame | None = None, custom: dict[str, Callable[[Layer, int], DataFrame]] | None = None) -> DataFrame:
    """A page for the request's likes; moderation comes last and may shorten it."""
    has_likes = source.liked is not None
    makers = {n: getattr(source, n) for n in ("popular", "fresh", "random", "explore", "exploit")} | (custom or {})
    limits = fetch_limits(profile, has_likes)
    base, source.base = source.base, source.base.persist()  # for this page only
    layers = {n: makers[n](profile.layers[n], limits[n]) for n in profile.layers if n in limits and (has_likes or n not in NEEDS_LIKES)}
    page = mix(layers, profile, now_ms)
    source.base.unpersist()
    source.base = base
    return page if denylist is None else moderate(page, denylist, moderation)


def related(candidates: DataFrame, profile: Profile, now_ms: int, limit: int) -> DataFrame:
    """A seed's similar videos by unified score, with rank."""
    scored = score(candidates, profile, now_ms).orderBy(F.desc("score"), F.desc("similarity_score"), "video_id").limit(limit)
    return scored.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.desc("similarity_score"), "video_id")))


def personalized(page: DataFrame, embeddings: DataFrame, liked: DataFrame, alpha: float, beta: float) -> DataFrame:
    """The same page in the order of alpha * score + beta * likeness to the likes."""
    liking = V.max_similarity(embeddings.join(page.select(*KEY), KEY, "left_semi"), liked).select(*KEY, F.col("similarity_score").alias("liking"))
    j = page.join(liking, KEY, "left").withColumn("final_score", F.round(alpha * F.col("score") + beta * F.coalesce("liking", F.lit(0.0)), 6))
    return j.withColumn("rank_after", F.row_number().over(W.orderBy(F.desc("final_score"), "rank")))


def interleave(rows: DataFrame, ratio: float, most: int) -> DataFrame:
    """rows (kind explore/exploit, position from 1) with slot: explore items take the slots at which the
    rounded share of slots so far steps up, exploit items the others; what finds no slot among ``most`` goes last."""
    spark = rows.sparkSession
    up = F.bround((F.col("p") + 1) * ratio) > F.bround(F.col("p") * ratio)
    slots = spark.range(most).select(F.col("id").alias("p")).withColumn("_kind", F.when(up, "explore").otherwise("exploit"))
    slots = slots.withColumn("_turn", F.row_number().over(W.partitionBy("_kind").orderBy("p")))  # most rows
    j = rows.join(slots, (F.col("kind") == F.col("_kind")) & (F.col("position") == F.col("_turn")), "left").drop("_kind", "_turn")
    return j.withColumn("slot", F.row_number().over(W.orderBy(F.asc_nulls_last("p"), "kind", "position"))).drop("p")


def jittered(rows: DataFrame, window: int, seed: str) -> DataFrame:
    """Rows (rank) shuffled inside consecutive stretches of window ranks."""
    order = [F.floor((F.col("rank") - 1) / window), S.seeded(seed, S.like_key("video_id", "instance_domain")), F.col("rank")]
    return rows.withColumn("jittered", F.row_number().over(W.orderBy(*order)))


def page_rows(page: DataFrame) -> DataFrame:
    """What a client gets: the stable columns as one JSON text a row."""
    return page.select("rank_after", F.to_json(F.struct(*stable(page).columns)).alias("row"))


def pool_stats(rows: DataFrame, column: str = "similarity_score") -> DataFrame:
    """rows with least, largest and number of the finite scores of the pool."""
    x = S.finite(column)
    every = W.partitionBy()  # a pool: POOL rows at most
    return rows.withColumns({"pool_min": F.min(x).over(every), "pool_max": F.max(x).over(every), "pool_size": F.count(x).over(every)})


DEBUG = ["score", "similarity_score", "pool_min", "pool_max", "layer", "rank_before", "rank_after"]


def with_debug(page: DataFrame, allowed: bool = True) -> DataFrame:
    """The stable columns, and a struct of what led to each row; not allowed, it raises."""
    if not allowed:
        raise PermissionError("debug columns are disabled")
    fields = [F.col(c) if c in page.columns else F.lit(None).cast("string").alias(c) for c in DEBUG]
    return page.select(*stable(page).columns, F.struct(*fields).alias("debug"))


def envelope(page: DataFrame, total: DataFrame, seed: str, at: int) -> DataFrame:
    """One row: a page as a client gets it (rows as JSON, count, total, seed, time)."""
    rows = page_rows(page).agg(F.array_sort(F.collect_list(F.struct("rank_after", "row"))).alias("r"))  # a page
    return rows.crossJoin(F.broadcast(total.agg(F.count("*").alias("total")))).select(  # one row each
        F.transform("r", lambda x: x["row"]).alias("rows"), F.size("r").alias("count"), "total", F.lit(seed).alias("seed"), F.lit(at).cast("long").alias("generated_at")
    )


def ordered_layers(profile: Profile, order: list[str] | None) -> Profile:
    """The profile's layers in another order: named ones first, the rest as they were; unknown names raise."""
    lost = [n for n in order or [] if n not in profile.layers]
    if lost:
        raise ValueError(f"no layer {lost}")
    names = [*(order or []), *[n for n in profile.layers if n not in (order or [])]]
    return replace(profile, layers={n: profile.layers[n] for n in names})
