"""Constants and profiles that define what the catalogue engine computes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values
DAY_MS = 86_400_000
BATCH = 48
AUTHOR_CAP, INSTANCE_CAP = 2, 5
ERROR_THRESHOLD = 3
LIKE_WEIGHT = 2.0
POPULARITY_DAYS, UNKNOWN_AGE_DAYS = 30.0, 3650.0
EXPLORE_MIN, EXPLOIT_MIN = 0.2, 0.4
POOL = {"popular": 5000, "fresh": 5000, "explore": 5000, "exploit": 2000, "random": 5000}
MAX_LIKES, LIKES_FOR_FEED, CLIENT_LIKES = 100, 10, 5
RELATED_ALPHA, RELATED_BETA = 0.2, 0.8
SIMILAR_PER_LIKE, SEARCH_LIMIT, SIMILAR_AUTHOR_CAP = 1000, 5000, 1
RANDOM_CACHE, RANDOM_AUTHOR_CAP, RANDOM_INSTANCE_CAP = 500_000, 100, 0
NPROBE = 24
RATE_LIMIT, RATE_WINDOW_S = 60, 60
NEEDS_LIKES = frozenset({"exploit", "explore"})


@dataclass(frozen=True)
class Layer:
    ratio: float
    low: float | None = None
    high: float | None = None
    author_cap: int = AUTHOR_CAP
    instance_cap: int = INSTANCE_CAP
    bonus: float = 0.0


@dataclass(frozen=True)
class Profile:
    layers: dict[str, Layer]  # in output order
    similarity: float = 1.0
    freshness: float = 0.25
    popularity: float = 0.2
    half_life_days: float = 14.0
    views_weight: float = 1.0
    likes_weight: float = 2.0
    batch: int = BATCH
    overfetch: float = 1.0
    max_per_layer: dict[str, int] = field(default_factory=dict)
    min_per_layer: dict[str, int] = field(default_factory=dict)  # taken first, in this order


HOME = Profile(
    {
        "explore": Layer(0.2, EXPLORE_MIN, EXPLOIT_MIN, bonus=0.05),
        "exploit": Layer(0.5, EXPLOIT_MIN, None, bonus=0.15),
        "popular": Layer(0.1, bonus=0.05),
        "random": Layer(0.1, None, EXPLORE_MIN),
        "fresh": Layer(0.1, bonus=0.05),
    },
    max_per_layer={"fresh": 12},
)
GUEST_HOME = Profile(
    {"popular": Layer(0.2, instance_cap=0), "random": Layer(0.6, instance_cap=0), "fresh": Layer(0.2, instance_cap=0)},
    similarity=0.2, freshness=0.35, popularity=0.45, overfetch=2.0, max_per_layer={"fresh": 12},
)
UPNEXT = Profile({}, freshness=0.1, popularity=0.1, half_life_days=30.0, likes_weight=1.0)
PROFILES = {"home": HOME, "guest_home": GUEST_HOME, "upnext": UPNEXT, "guest_upnext": UPNEXT}


def profile_for(mode: str | None, has_likes: bool, profiles: dict[str, Profile] = PROFILES) -> Profile:
    """The profile of a mode; without likes its guest twin, else the general guest profile."""
    order = [mode, "home"] if has_likes else [f"guest_{mode or 'home'}", "guest", mode, "home"]
    return next((profiles[n] for n in order if n in profiles), next(iter(profiles.values())))


def shares(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Floor shares of a total; what is left over goes one each in order; equal split if all weights are 0."""
    if not weights:
        return {}
    whole = sum(weights.values())
    even = whole <= 0
    out = {k: int(total / len(weights)) if even else int(total * w / whole) for k, w in weights.items()}
    left = total - sum(out.values())
    for k in list(out)[:left]:
        out[k] += 1
    return out


def fetch_limits(profile: Profile, has_likes: bool) -> dict[str, int]:
    active = {k: v.ratio for k, v in profile.layers.items() if has_likes or k not in NEEDS_LIKES}
    return shares(int(profile.batch * profile.overfetch), active)


def scaled(profile: Profile, explore: float, exploit: float) -> Profile:
    """The profile with other similarity thresholds (explore, exploit)."""
    bounds = {"explore": (explore, exploit), "exploit": (exploit, None), "random": (None, explore)}
    return replace(profile, layers={k: replace(v, low=bounds[k][0], high=bounds[k][1]) if k in bounds and (v.low, v.high) != (None, None) else v for k, v in profile.layers.items()})
