"""Scalar expressions; every one stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DAY_MS, LIKE_WEIGHT, POPULARITY_DAYS, UNKNOWN_AGE_DAYS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def age_days(published_at: Column | str, now_ms: int) -> Column:
    """Days since publication, 0 for the future, null if unknown (null or 0)."""
    p = _c(published_at)
    return F.when(p != 0, F.greatest(F.lit(now_ms) - p, F.lit(0)) / float(DAY_MS))


def popularity(views, likes, published_at, now_ms: int, like_weight: float = LIKE_WEIGHT) -> Column:
    seen = F.greatest(F.coalesce(_c(views), F.lit(0)), F.lit(0))
    liked = F.greatest(F.coalesce(_c(likes), F.lit(0)), F.lit(0))
    return (seen + F.lit(like_weight) * liked) / (1 + F.coalesce(age_days(published_at, now_ms), F.lit(UNKNOWN_AGE_DAYS)) / POPULARITY_DAYS)


def freshness(published_at, now_ms: int, half_life_days: float) -> Column:
    if half_life_days <= 0:
        return F.lit(0.0)
    return F.coalesce(F.pow(F.lit(0.5), age_days(published_at, now_ms) / half_life_days), F.lit(0.0))


def popularity_score(views, likes, views_weight: float = 1.0, likes_weight: float = 2.0) -> Column:
    x = F.coalesce(_c(views), F.lit(0)) * views_weight + F.coalesce(_c(likes), F.lit(0)) * likes_weight
    y = F.log1p(F.greatest(x, F.lit(0.0)))
    return F.when(x > 0, y / (y + 1)).otherwise(0.0)


def finite(x) -> Column:
    """The number, or null where it is NaN or infinite."""
    d = _c(x).try_cast("double") if hasattr(_c(x), "try_cast") else _c(x).cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def clipped_similarity(similarity, score=None, upper: bool = True) -> Column:
    """similarity, else score, at least 0 and (unless told otherwise) at most 1."""
    raw = _c(similarity) if score is None else F.coalesce(_c(similarity), _c(score))
    floor = F.greatest(F.coalesce(finite(raw), F.lit(0.0)), F.lit(0.0))
    return F.least(floor, F.lit(1.0)) if upper else floor


def like_key(video_id, host) -> Column:
    return F.concat(F.coalesce(_c(video_id), F.lit("")), F.lit("::"), F.coalesce(_c(host), F.lit("")))


def author_key(channel_id, host) -> Column:
    return F.when(_c(channel_id) != "", like_key(channel_id, host))


def clean_text(x) -> Column:
    """Trimmed, null if blank."""
    return F.nullif(F.trim(_c(x)), F.lit(""))


def normalize_host(x) -> Column:
    """Host of a host, host:port or url: lower case, no port, user info or outer dots; null if none or with blanks."""
    raw = F.lower(F.trim(_c(x)))
    bare = F.regexp_replace(raw, r"^[a-z][a-z0-9+.-]*://", "")
    name = F.regexp_replace(F.regexp_extract(bare, r"^(?:[^/?#@]*@)?([^/?#:@]*)", 1), r"^\.+|\.+$", "")
    return F.when((name != "") & ~name.rlike(r"\s"), name)


def host_token(x) -> Column:
    """Like normalize_host, but a bare host keeps its port."""
    raw = F.lower(F.trim(_c(x)))
    kept = F.regexp_replace(F.regexp_extract(raw, r"^([^/?#]*)", 1), r"^\.+|\.+$", "")
    return F.when(raw.rlike(r"^[a-z][a-z0-9+.-]*://"), normalize_host(x)).when((kept != "") & ~kept.rlike(r"\s"), kept)


def video_ref(url) -> tuple[Column, Column]:
    """(host, video id) of a page url: query key v, video, uuid or id, else the part after watch or w, else the last part."""
    u = F.trim(_c(url))
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    asked = F.coalesce(*[F.nullif(F.regexp_extract(u, rf"[?&]{k}=([^&#]+)", 1), F.lit("")) for k in ("v", "video", "uuid", "id")])
    watched = F.nullif(F.regexp_extract(path, r"/(?:watch|w)/([^/]+)", 1), F.lit(""))
    last = F.nullif(F.regexp_extract(path, r"([^/]+)/*$", 1), F.lit(""))
    return normalize_host(u), F.coalesce(asked, watched, last)


def parse_tags(x) -> Column:
    """Array of trimmed tags of a JSON list; a JSON string, or any other text, is one tag."""
    listed = F.from_json(_c(x), "array<string>")
    single = F.when(F.trim(_c(x)).rlike(r'(?s)^".*"$'), F.element_at(F.from_json(F.concat(F.lit("["), _c(x), F.lit("]")), "array<string>"), 1))
    return F.filter(F.transform(F.coalesce(listed, F.array(F.coalesce(single, _c(x)))), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))


def embedding_text(title, description, tags, category, channel, comments) -> Column:
    """The lines that are there, null if none is."""
    part = lambda label, x: F.concat(F.lit(label), clean_text(x))
    joined = F.nullif(F.array_join(_c(tags), ", "), F.lit(""))
    lines = F.concat_ws("\n", clean_text(title), clean_text(description), F.concat(F.lit("tags: "), joined), part("category: ", category), part("channel: ", channel), F.concat(F.lit("comments_count: "), _c(comments).cast("string")))
    return F.nullif(F.trim(lines), F.lit(""))


def asset_url(value, host) -> Column:
    """Absolute urls stay, a path is put on its host, nothing gives ''."""
    v = F.coalesce(_c(value), F.lit(""))
    slash = F.when(F.startswith(v, F.lit("/")), v).otherwise(F.concat(F.lit("/"), v))
    return F.when(v == "", "").when(v.rlike(r"^https?://"), v).otherwise(F.concat(F.lit("https://"), _c(host), slash))


def best_avatar(images) -> Column:
    """Url of the widest of array<struct<width, url>>, the first on ties."""
    best = F.array_max(F.transform(_c(images), lambda x, i: F.struct(F.coalesce(x["width"], F.lit(0)).alias("w"), (-i).alias("i"), x["url"].alias("url"))))
    return best["url"]


def nullable_bool(x) -> Column:
    return _c(x).cast("boolean").cast("int")


def non_negative_int(x) -> Column:
    n = F.expr(f"try_cast({x} as bigint)") if isinstance(x, str) else x.cast("long")
    return F.when(n >= 0, n)


# Change of likes, undone likes, comments and score by event type
EVENT_DELTAS = {"Like": (1, 0, 0, 1.0), "UndoLike": (-1, 1, 0, -1.0), "Comment": (0, 0, 1, 0.25)}
ACTION_EVENTS = {"like": "Like", "dislike": "UndoLike", "undo_like": "UndoLike", "comment": "Comment"}


def event_delta(event_type, k: int) -> Column:
    out = F.lit(None)
    for name, deltas in EVENT_DELTAS.items():
        out = F.when(_c(event_type) == name, F.lit(deltas[k])).otherwise(out)
    return out


def action_event(action) -> Column:
    out = F.lit(None).cast("string")
    for name, event in ACTION_EVENTS.items():
        out = F.when(F.lower(F.trim(_c(action))) == name, event).otherwise(out)
    return out


def failure_reason(message) -> Column:
    """Why a video cannot be used, null for errors that may pass."""
    m = F.lower(_c(message))
    status = F.regexp_extract(m, r"http (\d{3})", 1)
    tls = m.contains("tls") | m.contains("ssl") | m.contains("certificate")
    return (
        F.when(status.isin("404", "410"), "not_found").when(m.contains("certificate") & m.contains("expired"), "cert_expired").when(tls, "tls_error")
        .when(m.contains("timeout") | m.contains("timed out"), "timeout")
    )


def health_from_status(status) -> Column:
    s = F.lower(_c(status))
    return F.when(s == "done", "ok").when(s == "error", "error").otherwise("unknown")


def min_age_ms(days: int = 0, minutes: int = 0, seconds: int = 0) -> int:
    return max(0, days) * DAY_MS + max(0, minutes) * 60_000 + max(0, seconds) * 1000


def duration_text(seconds) -> Column:
    s = F.greatest(F.floor(_c(seconds)), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def percent_text(part, whole) -> Column:
    return F.when(_c(whole) > 0, F.format_string("%.1f%%", _c(part) * 100.0 / _c(whole))).otherwise("0.0%")


def as_ms(timestamp) -> Column:
    """Timestamps below 1e12 are seconds."""
    t = _c(timestamp)
    return F.when(t < 1_000_000_000_000, t * 1000).otherwise(t)


def seeded(seed: str, key) -> Column:
    """A reproducible random order: md5 of seed and key."""
    return F.md5(F.concat(F.lit(seed + ":"), _c(key).cast("string")))


def request_id(*parts) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *[_c(p).cast("string") for p in parts])), 1, 16)


def pick_text(*values) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*[clean_text(_c(v).cast("string")) for v in values])


def pick_number(*values) -> Column:
    """The first that reads as a number, cut to a whole one."""
    return F.coalesce(*[_c(v).cast("string").try_cast("double").cast("long") for v in values])


def tags_json(x) -> Column:
    """A JSON list of the texts in a JSON list that are not blank, trimmed; null if there are none."""
    kept = F.filter(F.transform(F.from_json(_c(x), "array<string>"), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(kept) > 0, F.to_json(kept))


def host_of(host, hostname, url, identity, name) -> Column:
    """Host of an account or channel: the first of host, hostname, url, id and name that is one (id and name only as name@host)."""
    after = lambda v: normalize_host(F.when(_c(v).contains("@"), F.regexp_extract(_c(v), r"@([^@]+)$", 1)).when(_c(v).contains("://"), _c(v)))
    return F.coalesce(normalize_host(host), normalize_host(hostname), F.when(_c(url).contains("://"), normalize_host(url)), after(identity), after(name))


def time_ago(then_ms, now_ms: int) -> Column:
    """"3 days ago" and the like; seconds are taken for what they are, the future is now."""
    s = F.greatest(F.floor((F.lit(now_ms) - as_ms(_c(then_ms))) / 1000), F.lit(0))
    out = F.lit("just now")
    for name, size in (("minute", 60), ("hour", 3600), ("day", 86_400), ("month", 30 * 86_400), ("year", 365 * 86_400)):
        n = F.floor(s / size)
        out = F.when(s >= size, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, " ago").otherwise("s ago"))).otherwise(out)
    return F.when(_c(then_ms).isNotNull(), out)


def user_or_default(user) -> Column:
    return F.coalesce(clean_text(user), F.lit("local-user"))


def log_mode(mode) -> Column:
    """Modes of logs; anything unknown is focused."""
    m = F.lower(F.trim(_c(mode)))
    return F.when(m.isin("dev", "focused", "verbose"), m).otherwise("focused")


def similar_path_id(path) -> Column:
    """The id in /videos/{id}/similar, null for other paths."""
    return clean_text(F.regexp_extract(_c(path), r"^/(?:api/)?videos/([^/?#]+)/similar/?(?:[?#].*)?$", 1))


def positive_int(x, default: int, most: int | None = None) -> Column:
    """A parameter as a number above 0, else the default; cut at most."""
    n = F.trim(_c(x).cast("string")).try_cast("bigint")
    v = F.when(n > 0, n).otherwise(default)
    return v if most is None else F.least(v, F.lit(most))


def flag(x) -> Column:
    """1, true, yes and on are true; 0, false, no and off false; else null."""
    v = F.lower(F.trim(_c(x).cast("string")))
    return F.when(v.isin("1", "true", "yes", "on"), True).when(v.isin("0", "false", "no", "off"), False)


def http_status(message) -> Column:
    return F.regexp_extract(_c(message), r"(?i)\bHTTP[ /](\d{3})\b", 1).try_cast("int")


def allowed_params(params, names) -> Column:
    """Of map<string, array<string>> the allowed keys that have one value, as map<string, string>."""
    kept = F.map_filter(_c(params), lambda k, v: k.isin(*names) & (F.size(v) == 1))
    return F.transform_values(kept, lambda k, v: v[0])


def watch_url(host, ref) -> Column:
    return F.concat(F.lit("https://"), _c(host), F.lit("/videos/watch/"), F.replace(F.url_encode(_c(ref)), F.lit("+"), F.lit("%20")))


def channel_url(host, name) -> Column:
    return F.concat(F.lit("https://"), _c(host), F.lit("/video-channels/"), F.replace(F.url_encode(_c(name)), F.lit("+"), F.lit("%20")))
