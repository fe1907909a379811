"""Vector similarity: exact search, inverted lists with product codes, caches of similar videos."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..workers import ship
from .catalogue import KEY
from .tables import settled

#: Vectors that one block of the exact join holds, and queries that travel as one broadcast matrix.
BLOCK = 1024


def valid(df: DataFrame, dim: int | None = None) -> DataFrame:
    """Rows whose embedding has the dimension (any, if None) and finite numbers only; others are skipped."""
    e = F.col("embedding")
    right = F.size(e) > 0 if dim is None else F.size(e) == dim
    return df.where(e.isNotNull() & right & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def search(embeddings: DataFrame, query: list[float], limit: int, exclude: tuple[str, str] | None = None) -> DataFrame:
    """The vectors most like one query, best first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    e = embeddings.where(V.of_dim("embedding", len(query)))
    if exclude:
        e = e.where(~((F.col("video_id") == exclude[0]) & (F.col("instance_domain") == exclude[1])))
    return e.select(*KEY, F.round(V.dot("embedding", q), 6).alias("score")).orderBy(F.desc("score"), "video_id", "instance_domain").limit(limit)


def max_similarity(candidates: DataFrame, liked: DataFrame) -> DataFrame:
    """Largest cosine of each candidate with the liked vectors, at least 0.

    The liked vectors are those of one request (CLIENT_LIKES at most), so they travel as one broadcast array.
    """
    likes = liked.select(V.normalized("embedding").alias("v")).where("v is not null").agg(F.collect_list("v").alias("_likes"))
    c = candidates.withColumn("_unit", V.normalized("embedding")).crossJoin(F.broadcast(likes))  # one row
    best = F.aggregate("_likes", F.lit(0.0), lambda m, v: F.greatest(m, V.dot("_unit", v)))
    return c.withColumn("similarity_score", F.when(F.col("_unit").isNotNull(), F.round(best, 6)).otherwise(0.0)).drop("_unit", "_likes")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list array of equal lengths."""
    lists = lists.cast(pa.large_list(pa.float64()))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _best(q_ids: list[tuple], q: np.ndarray, v_ids: list[tuple], v: np.ndarray, k: int, shown: np.ndarray | None = None) -> pa.RecordBatch:
    """The k best of v (of those shown to it) for each row of q, its own key left out; equal scores by key."""
    order = sorted(range(len(v_ids)), key=v_ids.__getitem__)
    v_ids, score = [v_ids[i] for i in order], np.round(q @ v[order].T, 6)
    if shown is not None:
        score[~shown[:, order]] = -np.inf
    at = {key: i for i, key in enumerate(v_ids)}
    picked = []
    for i, key in enumerate(q_ids):
        own = score[i]
        if key in at:
            own[at[key]] = -np.inf
        top = np.flatnonzero(own >= np.partition(own, -k)[-k]) if k < len(own) else np.arange(len(own))  # keys ascending
        top = top[np.argsort(-own[top], kind="stable")][:k]
        picked.append(top[own[top] > -np.inf])
    n = [len(p) for p in picked]
    flat = np.concatenate(picked) if picked else np.zeros(0, int)
    src = np.repeat(np.arange(len(q_ids)), n)
    columns = [pa.array([q_ids[i][j] for i in src], pa.string()) for j in (0, 1)] + [pa.array([v_ids[i][j] for i in flat], pa.string()) for j in (0, 1)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(score[src, flat], pa.float64())], _NEAR)


_NEAR = ["src_id", "src_host", "video_id", "instance_domain", "score"]
_NEAR_SQL = "src_id string, src_host string, video_id string, instance_domain string, score double"


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("src_id", "src_host").orderBy(F.desc("score"), "video_id", "instance_domain"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact k nearest by inner product for every query key, itself left out: (src_id, src_host, video_id, instance_domain, score, rank).

    Vectors that are null, not finite or of another dimension than the first query
    are skipped.  Up to BLOCK queries travel as one matrix and the vectors stay where
    they are; of each partition only the k best a query go on.  More queries are a
    job for :func:`ivf_knn`; here (as its yardstick) every query still meets every
    vector, group by stripe as :func:`scanned` deals them.
    """
    ship(queries.sparkSession)
    some = valid(queries).select(*KEY, "embedding")
    few = some.limit(BLOCK + 1).collect()
    if not few:
        return ranked(queries.sparkSession.createDataFrame([], _NEAR_SQL), k)
    dim = len(few[0]["embedding"])
    good = valid(vectors, dim).select(*KEY, "embedding")
    if len(few) <= BLOCK:
        return _knn_of_few([r for r in few if len(r["embedding"]) == dim], good, k)
    right = settled(good)
    left = right if queries is vectors else settled(valid(queries, dim).select(*KEY, "embedding"))
    return _exploded(scanned(left, right.withColumn("list_id", F.lit(0)), k, dim))


def _knn_of_few(few: list, good: DataFrame, k: int, books: np.ndarray | None = None) -> DataFrame:
    """knn of BLOCK rows at most among (key, embedding), or with ``books`` among what their codes show of the unit vectors."""
    spark = good.sparkSession
    sent = spark.sparkContext.broadcast(([(r["video_id"], r["instance_domain"]) for r in few], np.array([r["embedding"] for r in few], float)))  # BLOCK rows at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        for batch in batches:
            if batch.num_rows:
                keys, x = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), _matrix(batch.column(2))
                yield _best(ids, q, keys, x if books is None else _decoded(_encode(_units(x), books), books), k)

    return ranked(good.mapInArrow(scan, _NEAR_SQL), k)


#: Numbers that one task of a scan holds of its queries or of their best, and of its vectors.
HELD, STRIPE = 1 << 21, 1 << 23
#: Queries and vectors whose scores one step of a scan has in memory, queries whose lists it has, and pairs that are scored again or sorted at once.
STEP_QUERIES, STEP_VECTORS, STEP_LISTS, STEP_PAIRS = 512, 1024, 4096, 1 << 16
_TOP = "array<struct<away: double, video_id: string, instance_domain: string>>"
_TOP_ARROW = pa.list_(pa.struct([("away", pa.float64()), ("video_id", pa.string()), ("instance_domain", pa.string())]))


def _scan_shape(m: int, n: int, k: int, dim: int, tasks: int) -> tuple[int, int]:
    """(groups of queries, stripes of vectors): a task each pair, within HELD and STRIPE; more than tasks only where memory asks for it."""
    stripes = max(1, -(-n * dim // STRIPE))
    groups = max(1, -(-m * max(dim, k) // HELD), min(-(-m // 256), -(-tasks // stripes)))
    return groups, max(stripes, min(-(-n // BLOCK), tasks // groups))


def _dots(q: np.ndarray, row: np.ndarray, v: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rounded scores of pairs."""
    out = np.empty(len(row))
    for i in range(0, len(row), STEP_PAIRS):
        out[i : i + STEP_PAIRS] = np.einsum("ij,ij->i", q[row[i : i + STEP_PAIRS]], v[place[i : i + STEP_PAIRS]])
    return np.round(out, 6)


class _Tops:
    """The k best vectors so far for each query: rounded scores, best first, equal ones by the vectors' rank.

    A block of scores is made in single precision, if the vectors' lengths allow that.  Only what may be
    among the k best by more than its error can be waits, to be scored in double precision and
    sorted in together with what waits from other blocks.
    """

    def __init__(self, q: np.ndarray, v: np.ndarray, k: int, rank: np.ndarray, own: np.ndarray):
        self.q, self.v, self.k, self.rank, self.own = q, v, k, rank, own
        self.score, self.at = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        self.least = np.full(len(q), -np.inf)  # nothing below is among the k best
        long, self.v_long = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
        self.kind = np.float32 if max(long.max(), self.v_long.max()) < 1e18 else np.float64
        self.q_fast, self.v_fast = q.astype(self.kind, copy=False), v.astype(self.kind, copy=False)
        self.error = long * float((q.shape[1] + 4) * np.finfo(self.kind).eps)
        self.waiting, self.n = [], 0

    def meet(self, rows: np.ndarray, first: int, end: int) -> None:
        """Queries ``rows`` meet vectors first to end - 1."""
        score, own = self.q_fast[rows] @ self.v_fast[first:end].T, self.own[rows]
        here = np.flatnonzero((own >= first) & (own < end))
        score[here, own[here] - first] = -np.inf
        least, slack = self.least[rows], 1e-6 + self.error[rows] * self.v_long[first:end].max()  # rounding may lift a score by half of 1e-6
        new = np.flatnonzero(least == -np.inf)
        if self.k <= end - first and len(new):
            least[new] = np.partition(score[new], -self.k, 1)[:, -self.k] - slack[new]
            self.least[rows] = least
        floor = np.maximum(least - slack, np.finfo(self.kind).min).astype(self.kind)
        r, c = np.divmod(np.flatnonzero(score >= floor[:, None]), end - first)
        if len(r):
            self.waiting.append((rows[r], c + first))
            self.n += len(r)
            if self.n >= max(self.score.size, STEP_PAIRS):
                self.settle()

    def settle(self) -> None:
        """Sort in what waits."""
        if not self.n:
            return
        row, place = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.n = [], 0
        value = _dots(self.q, row, self.v, place)
        order = np.flatnonzero(value >= self.score[row, -1])
        order = order[np.argsort(row[order], kind="stable")]
        row, place, value = row[order], place[order], value[order]
        step = max(1, STEP_PAIRS // self.k)
        for i in range(0, len(self.q), step):
            part = slice(*np.searchsorted(row, [i, i + step]))
            if part.start < part.stop:
                self._merge(row[part], place[part], value[part])
        self.least = np.maximum(self.least, self.score[:, -1])

    def _merge(self, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        some = np.unique(row)
        i, j = np.nonzero(self.at[some] >= 0)
        row, place, value = np.concatenate([row, some[i]]), np.concatenate([place, self.at[some[i], j]]), np.concatenate([value, self.score[some[i], j]])
        order = np.lexsort((self.rank[place], -value, row))
        row, place, value = row[order], place[order], value[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < self.k
        self.score[row[keep], nth[keep]] = value[keep]
        self.at[row[keep], nth[keep]] = place[keep]

    def ranked_by(self, v: np.ndarray, k: int) -> None:
        """Of the best only the k best by other vectors for the same places."""
        score, at = np.full((len(self.q), k), -np.inf), np.full((len(self.q), k), -1)
        step = max(1, STEP_PAIRS // self.k)
        for i in range(0, len(self.q), step):
            place = self.at[i : i + step]
            value = _dots(self.q, np.repeat(np.arange(i, i + len(place)), self.k), v, place.ravel()).reshape(place.shape)
            value[place < 0] = -np.inf
            order = np.lexsort((self.rank[place], -value))[:, :k]
            score[i : i + step], at[i : i + step] = np.take_along_axis(value, order, 1), np.take_along_axis(place, order, 1)
        self.k, self.score, self.at = k, score, at


def scanned(queries: DataFrame, rows: DataFrame, k: int, dim: int, books: np.ndarray | None = None, probe: tuple[np.ndarray, int] | None = None, best: int | None = None) -> DataFrame:
    """(src_id, src_host, top): the k best rows for every query (key, embedding), nearest first; with ``probe`` (centroids, number) among that many lists.

    Rows are (list_id, key, embedding), or with ``books`` (list_id, key, code); with ``best``
    they have both, the k best are those by codes, and the best of these by their
    vectors are given.  Queries are dealt into groups and rows into stripes, and a task scans
    one stripe for one group, with the best so far of its queries.  So rows travel
    once a group, queries and their best once a stripe, and no scores but these leave a task.
    """
    spark = queries.sparkSession
    ship(spark)
    groups, stripes = _scan_shape(queries.count(), rows.count(), k, dim, 3 * spark.sparkContext.defaultParallelism)
    what = ["embedding"] if books is None else ["code"] if best is None else ["code", "embedding"]
    deal = lambda parts: F.pmod(F.xxhash64(*KEY), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asks = queries.select(deal(groups).alias("_g"), every(stripes).alias("_s"), *KEY, F.col("embedding").alias("asked"))
    held = rows.select(deal(stripes).alias("_s"), every(groups).alias("_g"), *KEY, *what, "list_id")
    cell = (F.col("_g") * stripes + F.col("_s")).cast("int").alias("cell")
    both = asks.unionByName(held, allowMissingColumns=True).select(cell, *KEY, "asked", *what, "list_id").repartitionById(groups * stripes, "cell")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [b for b in batches if b.num_rows]
        if not every:
            return
        table = pa.Table.from_batches(every)
        query = pc.is_valid(table.column("asked"))
        asks, held = table.filter(query), table.filter(pc.invert(query)).sort_by([("list_id", "ascending"), ("video_id", "ascending"), ("instance_domain", "ascending")])
        if not asks.num_rows or not held.num_rows:
            return
        q_ids, v_ids = (list(zip(t.column("video_id").to_pylist(), t.column("instance_domain").to_pylist(), strict=True)) for t in (asks, held))
        q = _matrix(asks.column("asked").combine_chunks())
        if books is None:
            v = _matrix(held.column("embedding").combine_chunks())
        else:
            v = _decoded(np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(held.num_rows, -1), books)
        rank = np.empty(len(v_ids), int)
        rank[sorted(range(len(v_ids)), key=v_ids.__getitem__)] = np.arange(len(v_ids))
        at = {key: i for i, key in enumerate(v_ids)}
        tops = _Tops(q, v, k, rank, np.array([at.get(key, -1) for key in q_ids]))
        if probe is None:
            _meet_all(tops, np.arange(len(q)), 0, len(v))
        else:
            listed = held.column("list_id").to_numpy()
            lists, begin = np.unique(listed, return_index=True)
            for i in range(0, len(q), STEP_LISTS):
                some = np.arange(i, min(len(q), i + STEP_LISTS))
                shown = np.zeros((len(probe[0]), len(some)), bool)
                shown[np.argpartition(-(q[some] @ probe[0].T), probe[1] - 1, 1)[:, : probe[1]].T, some - i] = True
                for x, first, end in zip(lists, begin, [*begin[1:], len(v)], strict=True):
                    _meet_all(tops, some[shown[x]], first, end)
        tops.settle()
        if best is not None:
            tops.ranked_by(_matrix(held.column("embedding").combine_chunks()), best)
        names = [held.column(c).combine_chunks() for c in KEY]
        for i in range(0, len(q), BLOCK):
            score, place = tops.score[i : i + BLOCK], tops.at[i : i + BLOCK]
            good = place >= 0
            entries = pa.StructArray.from_arrays([pa.array(-score[good]), *[x.take(pa.array(place[good])) for x in names]], fields=list(_TOP_ARROW.value_type))
            bounds = pa.array(np.append(0, np.cumsum(good.sum(1))).astype(np.int32))
            ids = [pa.array([key[c] for key in q_ids[i : i + BLOCK]], pa.string()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, pa.ListArray.from_arrays(bounds, entries)], ["src_id", "src_host", "top"])

    found = both.mapInArrow(scan, f"src_id string, src_host string, top {_TOP}")
    if stripes == 1:
        return found
    return found.groupBy("src_id", "src_host").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, best or k).alias("top"))


def _meet_all(tops: _Tops, rows: np.ndarray, first: int, end: int) -> None:
    for i in range(0, len(rows), STEP_QUERIES):
        for j in range(first, end, STEP_VECTORS):
            tops.meet(rows[i : i + STEP_QUERIES], j, min(end, j + STEP_VECTORS))


def _exploded(found: DataFrame) -> DataFrame:
    """Rows as :func:`ranked` gives them, of lists that are in order."""
    e = found.select("src_id", "src_host", F.posexplode("top").alias("at", "e"))
    return e.select("src_id", "src_host", "e.video_id", "e.instance_domain", (F.lit(0.0) - F.col("e.away")).alias("score"), (F.col("at") + 1).alias("rank"))


# --- approximate search: inverted lists, product codes, exact re-ranking

# Fixed values of the index: lists, parts of a vector, values of a part's code, training rows
LISTS, PARTS, CODES, TRAINING = 4096, 8, 256, 200_000
#: Training rows, 256 for each value of a code, that code books are made of.
BOOK_TRAINING = 1 << 16
#: Rows of one list that one task takes.
LIST_ROWS = 20_000


@dataclass
class Index:
    """Centroids and code books (small) and the stored rows: (list_id, part, video_id, instance_domain, code)."""

    centroids: np.ndarray  # (lists, dim)
    books: np.ndarray  # (parts, codes, dim / parts)
    rows: DataFrame
    split: dict[int, int]  # lists dealt over several parts

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def _means(x: np.ndarray, k: int, rounds: int = 10, unit: bool = False) -> np.ndarray:
    """k-means from the first k rows."""
    c = x[:k].copy()
    for _ in range(rounds):
        near = _nearest(x, c, unit)
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, col, len(c)) for col in x.T], 1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


#: Rows of x that _nearest takes at once, so that its scores stay small however many rows and centroids there are.
NEAR_ROWS = 2048


def _nearest(x: np.ndarray, c: np.ndarray, unit: bool = False) -> np.ndarray:
    """The nearest centroid of unit vectors or parts of them, in single precision."""
    x, c = x.astype(np.float32, copy=False), c.astype(np.float32, copy=False)
    out, length = np.empty(len(x), np.int64), np.float32(0) if unit else (c * c).sum(1)
    for i in range(0, len(x), NEAR_ROWS):
        near = (x[i : i + NEAR_ROWS] if unit else 2 * x[i : i + NEAR_ROWS]) @ c.T
        near -= length
        out[i : i + NEAR_ROWS] = near.argmax(1)
    return out


def _encode(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Code of each part of the vectors."""
    parts = np.split(x, len(books), axis=1)
    return np.stack([_nearest(p, b) for p, b in zip(parts, books, strict=True)], 1).astype(np.uint8)


def _decoded(code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors as their codes show them."""
    return np.concatenate([b[c] for b, c in zip(books, code.T, strict=True)], 1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def train_index(embeddings: DataFrame, lists: int = LISTS, parts: int = PARTS, sample: int = TRAINING, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and code books from a bounded, reproducible sample."""
    x = _training(embeddings, sample, seed)
    return _means(x, min(lists, len(x)), unit=True), _books(x, parts)


def _training(embeddings: DataFrame, sample: int, seed: int) -> np.ndarray:
    """Unit vectors of a bounded, reproducible sample."""
    rows = valid(embeddings).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), *KEY)), *KEY).limit(sample).select("embedding").toPandas()["embedding"]
    if not len(rows):
        raise ValueError("no embeddings to train on")
    dim = len(rows.iloc[0])
    return _units(np.array([r for r in rows if len(r) == dim], float))


def _books(x: np.ndarray, parts: int) -> np.ndarray:
    x, dim = x[:BOOK_TRAINING], x.shape[1]
    parts = next(p for p in range(min(parts, dim), 0, -1) if dim % p == 0)
    return np.stack([np.pad(b := _means(p, min(CODES, len(p))), ((0, CODES - len(b)), (0, 0)), mode="edge") for p in np.split(x, parts, axis=1)])


def fitted_index(embeddings: DataFrame, k: int, least: float, lists: int = LISTS, queries: int = 200, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and code books fine enough: twice the parts, from PARTS to a part a number, until a shortlist of 8 k by codes lacks half of what a recall of ``least`` may lack at most.

    The other half is for the lists that a search leaves out.  It is measured on a bounded
    sample of queries against all rows, in one pass for each number of parts.  Wider
    shortlists would do with coarser codes, but cost every search, so the codes grow first.
    """
    ship(embeddings.sparkSession)
    x = _training(embeddings, TRAINING, 7)
    centroids, parts, dim = _means(x, min(lists, len(x)), unit=True), PARTS, x.shape[1]
    good = valid(embeddings, dim).select(*KEY, "embedding")
    some = good.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), *KEY)), *KEY).limit(min(queries, BLOCK)).collect()  # BLOCK rows at most
    exact = settled(_knn_of_few(some, good, k))
    while True:
        books = _books(x, parts)
        if parts >= dim:
            return centroids, books
        reached = recall(_knn_of_few(some, good, 8 * k, books), exact).first()["recall"]
        if reached is None or reached >= (1 + least) / 2:
            return centroids, books
        parts *= 2


def build_index(embeddings: DataFrame, centroids: np.ndarray, books: np.ndarray) -> Index:
    """Every valid vector in its nearest list; lists of more than LIST_ROWS rows are dealt over parts."""
    ship(embeddings.sparkSession)
    dim = centroids.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _units(_matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(x, centroids, True).astype(np.int32)), batch.column(0), batch.column(1), pa.array([c.tobytes() for c in _encode(x, books)], pa.binary())], ["list_id", *KEY, "code"])

    rows = settled(valid(embeddings, dim).select(*KEY, "embedding").mapInArrow(place, "list_id int, video_id string, instance_domain string, code binary"))
    split = {r["list_id"]: -(-r["count"] // LIST_ROWS) for r in rows.groupBy("list_id").count().where(F.col("count") > LIST_ROWS).collect()}  # long lists only
    return Index(centroids, books, _dealt(rows, split, F.pmod(F.xxhash64(*KEY), F.col("_parts")).cast("int")), split)


def _dealt(rows: DataFrame, split: dict[int, int], part: Column, name: str = "part") -> DataFrame:
    """rows with their part of a list: 0, or for lists in split what ``part`` makes of ``_parts``."""
    if not split:
        return rows.withColumn(name, F.lit(0))
    parts = F.broadcast(rows.sparkSession.createDataFrame([(k, n) for k, n in split.items()], "_list int, _parts int"))  # a row a long list
    return rows.join(parts, F.col("list_id") == F.col("_list"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn(name, part).drop("_list", "_parts")


#: Queries of one list that one task takes.
LIST_QUERIES = 4096


def _shortlists(q_ids: list[tuple], q: np.ndarray, most: np.ndarray, v_ids: list[tuple], v: np.ndarray, k: int) -> pa.Table:
    """For each query the k nearest of v that are not further away than most, as one list."""
    found = _best(q_ids, q, v_ids, v, k)
    at = {key: i for i, key in enumerate(q_ids)}
    src = np.array([at[key] for key in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)], int)
    away = -found.column(4).to_numpy()
    keep = away <= most[src] if len(src) else np.zeros(0, bool)
    src, kept = src[keep], found.filter(pa.array(keep))
    some = np.unique(src)
    bounds = np.append(np.searchsorted(src, some), len(src)).astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(away[keep]), kept.column(2), kept.column(3)], fields=list(_TOP_ARROW.value_type))
    ids = [pa.array([q_ids[i][j] for i in some], pa.string()) for j in (0, 1)]
    return pa.table([*ids, pa.ListArray.from_arrays(pa.array(bounds), entries)], ["src_id", "src_host", "top"])


def shortlisted(queries: DataFrame, index: Index, wide: int, probes: int, sent: list[int] | None = None) -> DataFrame:
    """(src_id, src_host, top): by the codes, the wide nearest of the probed lists for every query, nearest first.

    Lists are probed in rounds of 1, 2, 4, ... lists, the nearest first, and the wide best so far of
    a query are a sketch that merges: what a list gives for a query is one row with
    what is not further away than the worst of a full sketch, so that rounds after the
    first give few entries.  A list's rows are dealt over parts of LIST_ROWS and its
    queries over parts of LIST_QUERIES, and each part of one meets each of the other in a
    task of its own.  ``sent`` takes the number of entries that each round shuffled.
    """
    spark = queries.sparkSession
    ship(spark)
    centroids, books, dim = index.centroids, index.books, index.dim
    probes = min(probes, len(centroids))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_matrix(batch.column(2)) @ centroids.T), 1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int32()))], ["src_id", "src_host", "qv", "lists"])

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], pa.schema([("src_id", pa.string()), ("src_host", pa.string()), ("top", _TOP_ARROW)]))
        code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
        ids = list(zip(right.column("video_id").to_pylist(), right.column("instance_domain").to_pylist(), strict=True))
        decoded = _decoded(code, books)
        most, out = left.column("most").to_numpy(), []
        for i in range(0, left.num_rows, BLOCK):
            some = left.slice(i, BLOCK)
            out.append(_shortlists(list(zip(some.column("src_id").to_pylist(), some.column("src_host").to_pylist(), strict=True)), _matrix(some.column("qv").combine_chunks()), most[i : i + BLOCK], ids, decoded, wide))
        return pa.concat_tables(out)

    asked = settled(valid(queries, dim).select(*KEY, F.col("embedding").cast("array<double>")).mapInArrow(probe, "src_id string, src_host string, qv array<double>, lists array<int>"))
    top, done, step = None, 0, 1
    while done < probes:
        now = asked.select("src_id", "src_host", "qv", F.explode(F.slice("lists", done + 1, min(step, probes - done))).alias("list_id"))
        worst = F.when(F.size("top") == wide, F.col("top")[wide - 1]["away"]).alias("most")
        now = now.withColumn("most", F.lit(float("inf"))) if top is None else now.join(top.select("src_id", "src_host", worst), ["src_id", "src_host"], "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
        many = {r["list_id"]: -(-r["count"] // LIST_QUERIES) for r in now.groupBy("list_id").count().where(F.col("count") > LIST_QUERIES).collect()}  # hot lists only
        each = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
        now = _dealt(_dealt(now, many, F.pmod(F.xxhash64("src_id", "src_host"), F.col("_parts")).cast("int"), "query_part"), index.split, each)
        rows = _dealt(index.rows, many, each, "query_part")
        by = ["list_id", "part", "query_part"]
        found = now.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(meet, f"src_id string, src_host string, top {_TOP}")
        seen = Observation()
        found = found.observe(seen, F.coalesce(F.sum(F.size("top")), F.lit(0)).alias("entries"))
        both = found if top is None else found.unionByName(top)
        top = settled(both.groupBy("src_id", "src_host").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, wide).alias("top")))
        if sent is not None:
            sent.append(seen.get["entries"])
        done, step = done + step, 2 * step
    return asked.limit(0).select("src_id", "src_host", F.lit(None).cast(_TOP).alias("top")) if top is None else top


#: Probed lists up to which queries travel once a list; beyond, a scan by groups of queries sends less.
FEW_PROBES = 8


def _scanned_lists(queries: DataFrame, index: Index, wide: int, probes: int, embeddings: DataFrame | None = None, best: int | None = None) -> DataFrame:
    """What :func:`shortlisted` gives, by one scan in which a task finds the lists of its queries; with ``embeddings`` and ``best`` the best of it by exact scores."""
    rows = index.rows
    if embeddings is not None and "embedding" not in rows.columns:
        rows = settled(rows.select("list_id", *KEY, "code").join(embeddings.select(*KEY, "embedding"), KEY))
    asked = settled(valid(queries, index.dim).select(*KEY, "embedding"))
    return scanned(asked, rows, wide, index.dim, index.books, (index.centroids, probes) if probes < len(index.centroids) else None, best)


def ivf_knn(queries: DataFrame, index: Index, embeddings: DataFrame, k: int, probes: int, shortlist: int = 8) -> DataFrame:
    """Approximate knn of many queries: codes give a shortlist of shortlist * k, which exact scores rank.

    Up to FEW_PROBES lists, shortlists are joined with the vectors.  Beyond, these travel
    with the codes, and the task that makes a shortlist also ranks it, so that k entries leave it, not shortlist * k.
    """
    wide, probes = shortlist * k, min(probes, len(index.centroids))
    if probes > FEW_PROBES:
        return _exploded(_scanned_lists(queries, index, wide, probes, embeddings, k))
    near = shortlisted(queries, index, wide, probes).select("src_id", "src_host", F.explode("top").alias("e")).select("src_id", "src_host", "e.video_id", "e.instance_domain")
    qv = valid(queries, index.dim).select(F.col("video_id").alias("src_id"), F.col("instance_domain").alias("src_host"), F.col("embedding").alias("qv"))
    exact = near.join(embeddings.select(*KEY, "embedding"), KEY).join(qv, ["src_id", "src_host"])
    return ranked(exact.select("src_id", "src_host", *KEY, F.round(V.dot("qv", "embedding"), 6).alias("score")), k)


def probed_knn(queries: list, rows: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """knn of BLOCK queries (rows with key and embedding) at most among the rows (list_id, key, embedding) of the lists that each probes.

    The lists are known before the plan is made, so of rows stored by list no other is read.
    """
    spark = rows.sparkSession
    ship(spark)
    ids = [(r["video_id"], r["instance_domain"]) for r in queries]
    q = np.array([r["embedding"] for r in queries], float).reshape(len(queries), -1)
    shown = np.zeros((len(queries), len(centroids)), bool)
    np.put_along_axis(shown, np.argsort(-(q @ centroids.T), 1, kind="stable")[:, :probes], True, 1)
    lists = np.flatnonzero(shown.any(0)).tolist()
    sent = spark.sparkContext.broadcast((ids, q, shown))  # BLOCK rows at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, may = sent.value
        for batch in batches:
            if batch.num_rows:
                keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
                yield _best(names, vectors, keys, _matrix(batch.column(3)), k, may[:, np.asarray(batch.column(0))])

    return ranked(rows.where(F.col("list_id").isin(lists)).select("list_id", *KEY, "embedding").mapInArrow(scan, _NEAR_SQL), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact neighbours that were found, and their number."""
    hits = found.select("src_id", "src_host", *KEY, F.lit(1).alias("hit"))
    return exact.join(hits, ["src_id", "src_host", *KEY], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"), F.count("*").alias("n"))


#: Widest shortlist of codes, in multiples of k, that is tried for a recall.
WIDEST = 128


def _lists_needed(queries: DataFrame, exact: DataFrame, index: Index) -> np.ndarray:
    """For each neighbour of the sample's queries, how many lists its query probes before the neighbour's."""
    held = exact.join(index.rows.select(*KEY, "list_id"), KEY).select("src_id", "src_host", "list_id").collect()  # the sample times k rows
    asked = queries.collect()
    order = np.argsort(-(np.array([r["embedding"] for r in asked], float).reshape(len(asked), -1) @ index.centroids.T), 1, kind="stable") if asked else np.zeros((0, 1), int)
    place = {(r["video_id"], r["instance_domain"]): np.argsort(o) for r, o in zip(asked, order, strict=True)}
    return np.array([place[r["src_id"], r["src_host"]][r["list_id"]] for r in held], int)


def _surely(found: DataFrame, exact: DataFrame) -> tuple[float | None, float]:
    """The recall of a sample of queries, and that less two standard errors."""
    src = ["src_id", "src_host"]
    hits = found.select(*src, *KEY, F.lit(1).alias("hit"))
    each = exact.join(hits, [*src, *KEY], "left").groupBy(*src).agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count("*").alias("n"))
    r = each.agg(F.round(F.sum("hits") / F.sum("n"), 4).alias("recall"), (F.stddev_samp(F.col("hits") / F.col("n")) / F.sqrt(F.count("*"))).alias("error")).first()
    return r["recall"], (r["recall"] or 0.0) - 2 * (r["error"] or 0.0)


def measured_probes(index: Index, embeddings: DataFrame, k: int, least: float, sample: int = 200, seed: int = 11) -> tuple[int, int, float]:
    """(probes, shortlist, recall): the fewest probes, doubling, that reach a recall on a bounded sample of queries by two standard errors.

    Where all lists do not, the codes are too coarse for the shortlist, which then grows
    fourfold; beyond WIDEST the recall itself must be reached, or it raises.
    """
    some = settled(valid(embeddings, index.dim).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), *KEY)), *KEY).limit(sample).select(*KEY, "embedding"))
    exact = settled(knn(some, embeddings, k))
    lists, shortlist = len(index.centroids), 8
    probes, shown = max(1, lists // 16), _lists_needed(some, exact, index)
    while probes < lists and len(shown) and round(float((shown < probes).mean()), 4) < least:
        probes *= 2  # so few lists do not even hold the neighbours
    while True:
        probes = min(probes, lists)
        reached, surely = _surely(ivf_knn(some, index, embeddings, k, probes, shortlist), exact)
        if reached is None or surely >= least:
            return probes, shortlist, 1.0 if reached is None else reached
        if probes < lists:
            probes *= 2
        elif shortlist < WIDEST:
            shortlist *= 4
        elif reached >= least:
            return probes, shortlist, reached
        else:
            raise ValueError(f"all {lists} lists and a shortlist of {shortlist} k reach a recall of {reached}, not {least}")


# --- caches


def valid_cache(items: DataFrame, limit: int, require_full: bool = False) -> DataFrame:
    """(source_video_id, source_instance_domain, entries, hit) of stored lists: no null score, and full if asked."""
    g = items.groupBy("source_video_id", "source_instance_domain").agg(F.count("*").alias("entries"), F.count_if(F.col("score").isNull()).alias("_nulls"))
    return g.select("source_video_id", "source_instance_domain", "entries", ((F.col("_nulls") == 0) & ((F.least("entries", F.lit(limit)) == limit) if require_full else F.lit(True))).alias("hit"))


def cached_similar(items: DataFrame, limit: int) -> DataFrame:
    """Stored similars by rank, limit for each source."""
    rn = F.row_number().over(W.partitionBy("source_video_id", "source_instance_domain").orderBy("rank", "similar_video_id"))
    return items.withColumn("_rn", rn).where(F.col("_rn") <= limit).drop("_rn")


def pending_sources(embeddings: DataFrame, sources: DataFrame) -> DataFrame:
    return embeddings.join(sources.select(*KEY), KEY, "left_anti")


@dataclass(frozen=True)
class CachePolicy:
    """What a request may do with stored lists of similar videos."""

    allow_write: bool = True
    refresh: bool = False
    require_full: bool = False
    allow_compute: bool = True


def similar_candidates(seeds: DataFrame, embeddings: DataFrame, items: DataFrame, limit: int, policy: CachePolicy, compute: Callable[[DataFrame, int], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates of every seed, new lists to store): from the cache where its list is valid, searched otherwise.

    ``compute`` may give the lists of seeds (key, embedding) that the cache lacks, as
    :func:`knn` would; a stored index's ``nearest`` is one.

    Candidates have source and similar keys, score and rank.  Only seeds without
    stored list, or all with refresh, give lists to store, and none without allow_write.
    """
    src, same = ["source_video_id", "source_instance_domain"], {"video_id": "source_video_id", "instance_domain": "source_instance_domain"}
    own = seeds.select(*[F.col(a).alias(b) for a, b in same.items()]).distinct()
    mine = items.join(own, src, "left_semi")
    hits = valid_cache(mine, limit, policy.require_full).where("hit").select(*src)
    if policy.refresh:
        hits = hits.limit(0)
    cached = cached_similar(mine.join(hits, src, "left_semi"), limit).select(*src, "similar_video_id", "similar_instance_domain", "score", "rank")
    missed = seeds.join(hits.select(*[F.col(b).alias(a) for a, b in same.items()]), KEY, "left_anti")
    if not policy.allow_compute:
        return cached, cached.limit(0)
    found = knn(missed, embeddings, limit) if compute is None else compute(missed, limit)
    found = found.select(F.col("src_id").alias(src[0]), F.col("src_host").alias(src[1]), F.col("video_id").alias("similar_video_id"), F.col("instance_domain").alias("similar_instance_domain"), "score", "rank")
    stored = items.select(*src).distinct()
    new = found.limit(0) if not policy.allow_write else found if policy.refresh else found.join(stored, src, "left_anti")
    return cached.unionByName(found), new


def store_similar(items: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with each new source's list in place of its old one."""
    src = ["source_video_id", "source_instance_domain"]
    return items.join(new.select(*src).distinct(), src, "left_anti").unionByName(new)


def purge_similar(items: DataFrame, hosts: DataFrame) -> DataFrame:
    h = hosts.select(F.col("host").alias("_h"))
    kept = items.join(h, F.col("source_instance_domain") == F.col("_h"), "left_anti")
    return kept.join(h, F.col("similar_instance_domain") == F.col("_h"), "left_anti")


def host_stats(items: DataFrame, host: str) -> DataFrame:
    """One row: lists by the host, mentions of it, and rows that a purge would delete."""
    s, t = F.col("source_instance_domain") == host, F.col("similar_instance_domain") == host
    return items.agg(F.count_if(s).alias("as_source"), F.count_if(t).alias("as_similar"), F.count_if(s | t).alias("deletable"))


def inspect(embeddings: DataFrame, count: int, values: int = 10) -> DataFrame:
    """The first embeddings by key, with their first values."""
    return embeddings.orderBy(*KEY).limit(count).select(*KEY, "embedding_dim", F.slice("embedding", 1, values).cast("array<double>").alias("head"))


def health(embeddings: DataFrame) -> DataFrame:
    """One row: how many embeddings, and a dimension and model of them."""
    return embeddings.agg(F.count("*").alias("total"), F.any_value("embedding_dim").alias("dim"), F.any_value("model_name").alias("model_name"))


def hashed_encoder(dim: int = 64):
    """A stand-in for a text encoder: signed feature hashing of words, unit length (Arrow batches)."""
    @F.pandas_udf("array<float>")
    def encode(text: pd.Series) -> pd.Series:
        import zlib

        out = []
        for t in text.fillna(""):
            v = np.zeros(dim, np.float32)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 31 else -1.0
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return encode


#: Texts that an encoder gets at once.
ENCODER_BATCH = 64


def batched_encoder(encode: Callable[[list[str]], list[list[float]]], size: int = ENCODER_BATCH):
    """A column function of any encoder of lists of texts, which gets size texts at once and is loaded once a worker if ``encode`` does so."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([list(v) for at in range(0, len(texts), size) for v in encode(texts[at : at + size])], dtype=object)

    return run


def encode_missing(texts: DataFrame, stored: DataFrame, encoder: Column | None = None, force: bool = False) -> DataFrame:
    """texts (video_id, instance_domain, text) without stored embedding (all, if force), encoded; null texts are left out."""
    new = texts if force else texts.join(stored.select(*KEY), KEY, "left_anti")
    return new.where("text is not null").withColumn("embedding", (encoder or hashed_encoder())("text"))
