"""Paged JSON catalogues: a Spark data source over an HTTP endpoint or a folder of page files.

``spark.read.format("catalogue_pages").option("hosts", "a,b").option("kind", "videos")``;
with ``folder`` the pages are files ``<folder>/<host>/<kind>-<start>.json``, with
``base`` (``https://{host}/api/v1/{kind}``) they are fetched.  A partition is a
host; a page has ``total`` and ``data``, and reading stops at the total, or after
a short page where there is none.

``spark.readStream`` of the same format is a crawl that can be stopped: its offsets are pages by
host, kept in the query's checkpoint, and its partitions single pages.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import scalars as S

PAGE = 50
SCHEMA = "host string, start int, item string"


def with_retry(fetch: Callable[[], str], tries: int = 4, sleep: Callable[[float], None] = time.sleep) -> str:
    """429 waits as told and is not counted; 5xx and broken connections wait 1 s, 2 s, ... 30 s at most; else the error is final."""
    failed = 0
    while True:
        try:
            return fetch()
        except urllib.error.HTTPError as e:
            if e.code == 429:
                sleep(min(60.0, float(e.headers.get("Retry-After") or 1)))
                continue
            if e.code < 500:
                raise
            failed += 1
            if failed >= tries:
                raise
        except urllib.error.URLError:
            failed += 1
            if failed >= tries:
                raise
        sleep(min(30.0, 2.0 ** (failed - 1)))


def read_all(get: Callable[[int], str], page: int = PAGE, known: Callable[[dict], bool] | None = None, stop_after: int = 0) -> Iterator[tuple[int, str]]:
    """(start, item as JSON) of all pages; known items are left out, and with stop_after reading ends after so many pages in a row of known items only."""
    start = full = 0
    while True:
        body = json.loads(get(start))
        data, total = body.get("data") or [], body.get("total")
        new = [item for item in data if known is None or not known(item)]
        for item in new:
            yield start, json.dumps(item, ensure_ascii=False)
        start += page
        full = 0 if new or not data else full + 1
        if not data or (stop_after and full >= stop_after) or (start >= total if isinstance(total, int) else len(data) < page):
            return


class _Host(InputPartition):
    def __init__(self, host: str):
        self.host = host


def _hosts(options: dict) -> list[str]:
    return [h.strip() for h in options["hosts"].split(",") if h.strip()]


def fetch_page(options: dict, host: str, start: int) -> str:
    kind, folder, base = options.get("kind", "videos"), options.get("folder"), options.get("base")
    if folder:
        return (Path(folder) / host / f"{kind}-{start}.json").read_text()
    url = base.format(host=host, kind=kind) + "?" + urllib.parse.urlencode({"start": start, "count": PAGE})
    return with_retry(lambda: urllib.request.urlopen(url, timeout=30).read().decode())


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Host(h) for h in _hosts(self.options)]

    def read(self, partition: _Host) -> Iterator[tuple]:
        def get(start: int) -> str:
            return fetch_page(self.options, partition.host, start)

        # options: known, a JSON list of ids that are there already; stop_after, pages; limit, items a host
        seen, stop, left = set(json.loads(self.options.get("known", "[]"))), int(self.options.get("stop_after", 0)), int(self.options.get("limit", -1))
        for start, item in read_all(get, known=(lambda x: (x.get("uuid") or x.get("id")) in seen) if seen else None, stop_after=stop):
            if not left:
                return
            left -= 1
            yield partition.host, start, item


class _Pages(InputPartition):
    """Pages from one start to another of a host (to its last one, if the number is not known), ``most`` items of them."""

    def __init__(self, host: str, start: int, stop: int | None, most: int | None):
        self.host, self.start, self.stop, self.most = host, start, stop, most


class _StreamReader(DataSourceStreamReader):
    """Offsets are, by host, the next page and the number of items the host said it has when the crawl began.

    A micro-batch takes ``pages_per_batch`` pages of every host that is not done, and ``limit`` counts
    items over all hosts, in their order.  What was read is in the query's checkpoint; as
    Spark does not tell a restarted reader where that is, what was planned last is kept beside
    it too, in ``progress``.
    """

    def __init__(self, options: dict):
        self.options = options
        self.step, self.limit = int(options.get("pages_per_batch", 10)), int(options.get("limit", -1))
        self.files, self.path = FileSystem.from_uri(options["progress"].rstrip("/"))
        self.now: dict | None = None

    def initialOffset(self) -> dict:
        return {h: {"next": 0, "total": None} for h in _hosts(self.options)}

    def _load(self) -> dict | None:
        if self.files.get_file_info(f"{self.path}/planned.json").type != FileType.File:
            return None
        with self.files.open_input_stream(f"{self.path}/planned.json") as f:
            return json.loads(f.read())

    def _keep(self, offset: dict) -> None:
        self.now = offset
        self.files.create_dir(self.path, recursive=True)
        with self.files.open_output_stream(f"{self.path}/planned.new") as f:
            f.write(json.dumps(offset).encode())
        self.files.move(f"{self.path}/planned.new", f"{self.path}/planned.json")

    def _left(self, offset: dict) -> int | None:
        """Items that the limit leaves after an offset."""
        return None if self.limit < 0 else max(0, self.limit - sum(v.get("taken", 0) for v in offset.values()))

    def latestOffset(self) -> dict:
        """One step further for every host; the first step of a host asks how many items it has."""
        before = self.now or self._load() or self.initialOffset()
        out, left = {}, self._left(before)
        for host, at in before.items():
            total = at["total"]
            if at["next"] == 0 and total is None and left != 0:
                total = json.loads(fetch_page(self.options, host, 0)).get("total")
                total = total if isinstance(total, int) else -1
            if at["next"] is None or left == 0:
                out[host] = at
                continue
            if total < 0:  # no number: the rest of the host in one go
                out[host] = {"next": None, "total": total, "from": at["next"], "taken": at.get("taken", 0), "most": left}
                continue
            stop = min(at["next"] + self.step * PAGE, -(-total // PAGE) * PAGE)
            size = min(stop, total) - min(at["next"], total)
            size = size if left is None else min(size, left)
            left = None if left is None else left - size
            out[host] = {"next": stop if stop < total else None, "total": total, "taken": at.get("taken", 0) + size}
        self.now = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._keep(end)
        out: list[InputPartition] = []
        for host, to in end.items():
            since = start.get(host) or {"next": 0}
            if since["next"] is None or since["next"] == to["next"]:
                continue
            if to["total"] < 0:
                out.append(_Pages(host, since["next"], None, to.get("most")))
                continue
            stop = to["next"] if to["next"] is not None else -(-to["total"] // PAGE) * PAGE
            left = to["taken"] - since.get("taken", 0)
            for page in range(since["next"], stop, PAGE):
                size = min(PAGE, to["total"] - page, left)
                if size > 0:
                    out.append(_Pages(host, page, page + PAGE, size))
                left -= max(size, 0)
        return out

    def read(self, partition: _Pages) -> Iterator[tuple]:
        get = lambda start: fetch_page(self.options, partition.host, start)
        if partition.stop is None:
            rows = read_all(lambda start: get(partition.start + start))
            rows = ((partition.start + start, item) for start, item in rows)
        else:
            rows = ((start, json.dumps(x, ensure_ascii=False)) for start in range(partition.start, partition.stop, PAGE) for x in json.loads(get(start)).get("data") or [])
        for n, (start, item) in enumerate(rows):
            if partition.most is not None and n >= partition.most:
                return
            yield partition.host, start, item

    def commit(self, end: dict) -> None:
        pass


class CataloguePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue_pages"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CataloguePages)


def unknown(items: DataFrame, known: DataFrame, key: str = "video_id") -> DataFrame:
    """Raw items whose id is not among known (instance_domain and key): a join, however many are known."""
    own = items.withColumn("_id", F.coalesce(F.get_json_object("item", "$.uuid"), F.get_json_object("item", "$.id")))
    there = known.select(F.col(key).cast("string").alias("_known"), F.col("instance_domain").alias("_host"))
    return own.join(there, (F.col("_id") == F.col("_known")) & (F.col("host") == F.col("_host")), "left_anti").drop("_id")


_J = lambda *paths: F.coalesce(*[S.clean_text(F.get_json_object("item", p)) for p in paths])


def video_rows(items: DataFrame, checked_at: int) -> DataFrame:
    """Typed video rows of raw JSON items; tags and comments stay null until they are fetched one by one."""
    number = lambda *p: _J(*p).cast("double").cast("long")
    when = F.unix_millis(F.try_to_timestamp(_J("$.publishedAt", "$.originallyPublishedAt")))
    return items.select(
        _J("$.uuid", "$.id").alias("video_id"), F.col("host").alias("instance_domain"), _J("$.uuid").alias("video_uuid"), number("$.id").alias("video_numeric_id"),
        _J("$.channel.name", "$.channel.id").alias("channel_id"), _J("$.channel.displayName", "$.channel.name").alias("channel_name"), _J("$.account.name").alias("account_name"),
        _J("$.name", "$.title").alias("title"), _J("$.description").alias("description"), F.lit(None).cast("string").alias("tags_json"), _J("$.category.label", "$.category.name").alias("category"),
        when.alias("published_at"), _J("$.url").alias("video_url"), number("$.duration").alias("duration"), S.asset_url(_J("$.thumbnailPath"), F.col("host")).alias("thumbnail_url"),
        number("$.views").alias("views"), number("$.likes").alias("likes"), number("$.dislikes").alias("dislikes"), F.lit(None).cast("long").alias("comments_count"),
        S.nullable_bool(_J("$.nsfw")).alias("nsfw"), F.lit(checked_at).cast("long").alias("last_checked_at"), F.lit(0).alias("error_count"),
    )


def channel_rows(items: DataFrame) -> DataFrame:
    """Typed channel rows; a channel of another host than the one read is left out."""
    own = S.normalize_host(F.coalesce(_J("$.host"), F.col("host")))
    return items.where(own == S.normalize_host("host")).select(
        _J("$.name", "$.id").alias("channel_id"), F.col("host").alias("instance_domain"), _J("$.name").alias("channel_name"), _J("$.url").alias("channel_url"), _J("$.displayName", "$.name").alias("display_name"),
        _J("$.videosCount").cast("long").alias("videos_count"), _J("$.followersCount").cast("long").alias("followers_count"),
        S.asset_url(S.best_avatar(F.from_json(F.get_json_object("item", "$.avatars"), "array<struct<width:int,url:string>>")), F.col("host")).alias("avatar_url"),
    )
