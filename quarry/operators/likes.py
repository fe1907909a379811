"""Sources of videos similar to likes, by name, and the hooks by which a caller puts in its own."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIKES_FOR_FEED, SIMILAR_PER_LIKE, Layer, Profile
from ..functions import scalars as S
from . import similarity as N
from .catalogue import KEY, capped, shuffled
from .feeds import Candidates, feed

#: How often the random layer asks for more rows when caps have cut those it got.
REFETCHES = 5


class LikeSource(Protocol):
    """(liked, limit) -> rows with the video's key and score, liked videos left out."""

    def __call__(self, liked: DataFrame, limit: int) -> DataFrame: ...


class Strategy(Protocol):
    """(candidates, profile, now_ms) -> a page."""

    def __call__(self, source: Candidates, profile: Profile, now_ms: int) -> DataFrame: ...


def sampled_likes(liked: DataFrame, seed: str, most: int = LIKES_FOR_FEED) -> DataFrame:
    """At most so many likes of a request, by seed."""
    return shuffled(liked, f"{seed}:likes", most)


def by_like(liked: DataFrame, embeddings: DataFrame, items: DataFrame, limit: int, seed: str, policy: N.CachePolicy, per_like: int = SIMILAR_PER_LIKE, compute: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Each like's similars, from the cache or searched as the policy allows; a video once, liked ones left out, shuffled by seed."""
    some = sampled_likes(liked, seed)
    near, _ = N.similar_candidates(some.select(*KEY, "embedding"), embeddings, items, per_like, policy, compute)
    rows = near.select(F.col("similar_video_id").alias("video_id"), F.col("similar_instance_domain").alias("instance_domain"), "score")
    one = rows.groupBy(*KEY).agg(F.max("score").alias("score")).join(some.select(*KEY), KEY, "left_anti")
    return shuffled(one, f"{seed}:exploit", limit)


def like_source(name: str, embeddings: DataFrame, items: DataFrame, seed: str, overrides: dict[str, LikeSource] | None = None, allow_compute: bool = True, compute: Callable[[DataFrame, int], DataFrame] | None = None) -> LikeSource:
    """A source by name: "ann" searches (by ``compute``, if given) what the cache lacks, "cache-optimized" takes full lists only and searches if it may."""
    own: dict[str, Callable[[DataFrame, int], DataFrame]] = {
        "ann": lambda liked, limit: by_like(liked, embeddings, items, limit, seed, N.CachePolicy(require_full=True), compute=compute),
        "cache-optimized": lambda liked, limit: by_like(liked, embeddings, items, limit, seed, N.CachePolicy(allow_write=False, require_full=True, allow_compute=allow_compute), compute=compute),
    }
    known = own | (overrides or {})
    if name not in known:
        raise ValueError(f"unknown source {name}")
    return known[name]


def similar_or_random(liked: DataFrame | None, source: LikeSource, videos: DataFrame, limit: int, seed: str) -> DataFrame:
    """The source's videos, filled up with random ones where they are too few or nothing is liked."""
    found = None if liked is None else source(liked, limit).select(*KEY, F.lit(0).alias("_turn"))
    lot = shuffled(videos.select(*KEY), f"{seed}:fill", 2 * limit).withColumn("_turn", F.lit(1))
    both = lot if found is None else found.unionByName(lot)
    one = both.groupBy(*KEY).agg(F.min("_turn").alias("_turn"))
    return one.orderBy("_turn", S.seeded(seed, S.like_key("video_id", "instance_domain")), "video_id").limit(limit).withColumn("filled", F.col("_turn") == 1).drop("_turn")


def random_refetched(videos: DataFrame, seed: str, limit: int, author_cap: int, instance_cap: int, rounds: int = REFETCHES) -> DataFrame:
    """Random rows under caps: a draw of limit rows, and while caps leave too few another, the caps' counters going on.

    Draws one after the other, cut at the limit, are the same rows as drawing until
    there are enough.
    """
    key = S.like_key("video_id", "instance_domain")
    drawn = None
    for k in range(rounds):
        one = shuffled(videos, f"{seed}:{k}", limit).withColumns({"_round": F.lit(k), "_lot": S.seeded(f"{seed}:{k}", key)})
        drawn = one if drawn is None else drawn.unionByName(one)
    return capped(drawn, [F.col("_round"), F.col("_lot")], author_cap, instance_cap, limit).drop("_round", "_lot")


STRATEGIES: dict[str, Strategy] = {"mixed": lambda source, profile, now_ms: feed(source, profile, now_ms)}


def strategy(name: str, overrides: dict[str, Strategy] | None = None) -> Strategy:
    known = STRATEGIES | (overrides or {})
    if name not in known:
        raise ValueError(f"unknown strategy {name}")
    return known[name]


def exploit_by(source: LikeSource, candidates: Candidates) -> Callable[[Layer, int], DataFrame]:
    """A layer of a feed whose candidates come from a like source: for ``feed(..., custom={"exploit": ...})``."""

    def layer(options: Layer, limit: int) -> DataFrame:
        near = source(candidates.liked, candidates.pools["exploit"]).withColumnRenamed("score", "similarity_score")
        rows = candidates.base.drop("_embedded", "adjusted_likes", "interaction_signal_score").join(near, KEY)
        order = [F.desc("similarity_score"), F.col("video_id")]
        kept = capped(rows, order, options.author_cap, options.instance_cap)
        low = kept if options.low is None else kept.where(F.col("similarity_score") >= options.low)
        from .feeds import sampled

        return sampled(low, limit, f"{candidates.seed}:exploit", order)

    return layer
