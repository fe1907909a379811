"""Reads of single documents over HTTP: details, counts, health, request bodies.

``fetch`` (url -> text) is given, so that the same code reads a server, a folder or a
test's table.  A reader runs once for each row of a table, in the tasks that hold them.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .pages import with_retry

# Fixed values
MAX_BODY = 1 << 20
TRIES = 4

Fetch = Callable[[str], str]


def http_fetch(url: str) -> str:
    return urllib.request.urlopen(url, timeout=30).read().decode()


def with_fallback(fetch: Fetch, address: str, tries: int = TRIES, sleep: Callable[[float], None] | None = None) -> str:
    """address without scheme: by https, and where that fails by http with half the tries."""
    import time

    pause = sleep or time.sleep
    try:
        return with_retry(lambda: fetch(f"https://{address}"), tries, pause)
    except urllib.error.HTTPError:
        raise
    except (urllib.error.URLError, OSError):
        return with_retry(lambda: fetch(f"http://{address}"), max(1, tries // 2), pause)


def json_body(raw: bytes, most: int = MAX_BODY) -> dict:
    """A request's body: a JSON object of bounded size; anything else raises what is wrong."""
    if len(raw) > most:
        raise ValueError(f"body of {len(raw)} bytes, {most} at most")
    try:
        body = json.loads(raw or b"{}")
    except ValueError as e:
        raise ValueError("body is no JSON") from e
    if not isinstance(body, dict):
        raise ValueError("body is no JSON object")
    return body


def total_of(text: str) -> int:
    """``total`` of a page that was asked for one row."""
    total = json.loads(text).get("total")
    if isinstance(total, bool) or not isinstance(total, int) or total < 0:
        raise ValueError(f"no valid total: {total!r}")
    return total


def read_each(rows: DataFrame, address: str, fetch: Fetch = http_fetch, tries: int = TRIES) -> DataFrame:
    """rows with body and error: the text behind each row's address (a template over the columns), or why there is none."""
    columns = rows.columns

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies, errors = [], []
            for r in pdf.to_dict("records"):
                try:
                    bodies.append(with_fallback(fetch, address.format(**r), tries, lambda s: None if fetch is not http_fetch else __import__("time").sleep(s)))
                    errors.append(None)
                except urllib.error.HTTPError as e:
                    bodies.append(None)
                    errors.append(f"HTTP {e.code}")
                except Exception as e:
                    bodies.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pdf[columns].assign(body=pd.Series(bodies, pdf.index, object), error=pd.Series(errors, pdf.index, object))

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.mapInPandas(read, StructType([*rows.schema.fields, StructField("body", StringType()), StructField("error", StringType())]))


def video_details(items: DataFrame) -> DataFrame:
    """Of one video's JSON (item) and its channel's (channel, may be null): what a detail page refreshes."""
    text = lambda c, *paths: S.pick_text(*[F.get_json_object(c, p) for p in paths])
    number = lambda c, *paths: S.pick_number(*[F.get_json_object(c, p) for p in paths])
    others = [c for c in items.columns if c not in ("item", "channel")]
    return items.select(
        *others, text("item", "$.name", "$.title").alias("title"), text("item", "$.description").alias("description"), number("item", "$.views").alias("views"), number("item", "$.likes").alias("likes"),
        number("item", "$.dislikes").alias("dislikes"), text("channel", "$.displayName", "$.name").alias("channel_name"), number("channel", "$.followersCount").alias("followers_count"),
        S.tags_json(F.get_json_object("item", "$.tags")).alias("tags_json"), text("item", "$.category.label", "$.category.name", "$.category").alias("category"),
        S.nullable_bool(F.get_json_object("item", "$.nsfw")).alias("nsfw"), number("item", "$.comments").alias("comments_count"),
    )
