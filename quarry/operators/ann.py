"""The stored index that serving reads: inverted lists as one folder a list, in versions of the store.

``ann_model`` is one row (centroids, code books, probes and the recall they reach), ``ann_lists``
has a row a vector: list, key, code and the vector itself, so a search reads the
lists it probes and nothing else.  New vectors are appended to their lists under the
stored model; a build trains a new one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TABLES
from ..sources.stores import Store
from ..workers import ship
from . import similarity as N
from .catalogue import KEY
from .tables import settled

#: Lists have no fewer vectors than this on average, and there are N.LISTS of them at most.
LIST_VECTORS = 64


@dataclass(frozen=True)
class Model:
    """What places vectors in lists, and how many lists a query probes."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int = 1
    shortlist: int = 8
    recall: float = 0.0
    recall_at: int = 10

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def frame(self, spark, at: int) -> DataFrame:
        row = (self.dim, len(self.centroids), len(self.books), self.probes, self.shortlist, float(self.recall), self.recall_at, at, self.centroids.ravel().tolist(), self.books.ravel().tolist())
        return spark.createDataFrame([row], TABLES["ann_model"])

    @staticmethod
    def of(row) -> Model:
        books = np.array(row["books"]).reshape(row["parts"], N.CODES, -1)
        return Model(np.array(row["centroids"]).reshape(row["lists"], row["dim"]), books, row["probes"], row["shortlist"], row["recall"], row["recall_at"])


def placed(embeddings: DataFrame, model: Model) -> DataFrame:
    """(list_id, key, code, embedding) of the valid vectors."""
    ship(embeddings.sparkSession)
    centroids, books = model.centroids, model.books

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = N._matrix(batch.column(2))
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                near = N._nearest(x, centroids, True).astype(np.int32)
                codes = pa.array([c.tobytes() for c in N._encode(x, books)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(near), batch.column(0), batch.column(1), codes, batch.column(2)], ["list_id", *KEY, "code", "embedding"])

    read = N.valid(embeddings, model.dim).select(*KEY, F.col("embedding").cast("array<float>").alias("embedding"))
    return read.mapInArrow(place, "list_id int, video_id string, instance_domain string, code binary, embedding array<float>")


def trained(embeddings: DataFrame, least_recall: float = 0.9, recall_at: int = 10, lists: int | None = None) -> tuple[Model, DataFrame]:
    """A model for the vectors with the fewest probes that reach the recall, and the placed rows."""
    n = N.valid(embeddings).count()
    centroids, books = N.fitted_index(embeddings, recall_at, least_recall, lists or max(1, min(N.LISTS, n // LIST_VECTORS, int(4 * n**0.5))))
    model = Model(centroids, books)
    rows = settled(placed(embeddings, model))
    probes, shortlist, recall = N.measured_probes(index_of(rows, model), rows, recall_at, least_recall)
    return Model(centroids, books, probes, shortlist, recall, recall_at), rows


def index_of(rows: DataFrame, model: Model) -> N.Index:
    """Rows (list_id, key, code) with long lists dealt over parts."""
    split = {r["list_id"]: -(-r["count"] // N.LIST_ROWS) for r in rows.groupBy("list_id").count().where(F.col("count") > N.LIST_ROWS).collect()}  # long lists only
    return N.Index(model.centroids, model.books, N._dealt(rows, split, F.pmod(F.xxhash64(*KEY), F.col("_parts")).cast("int")), split)


class StoredIndex:
    """The current version of the index in a store."""

    def __init__(self, store: Store):
        self.store = store
        row = store.read("ann_model").first()
        if row is None:
            raise LookupError("no index is stored")
        self.model = Model.of(row)

    @property
    def rows(self) -> DataFrame:
        return self.store.read("ann_lists")

    @staticmethod
    def exists(store: Store) -> bool:
        return store.version("ann_model") is not None

    @staticmethod
    def build(store: Store, embeddings: DataFrame, at: int, **options) -> StoredIndex:
        """Train, place and store; the old version stays current until both tables are written."""
        model, rows = trained(embeddings, **options)
        store.write_all({"ann_model": model.frame(store.spark, at), "ann_lists": by_list(rows)}, at, {"ann_lists": ["list_id"]})
        return StoredIndex(store)

    def add(self, embeddings: DataFrame, at: int) -> int:
        """Append vectors of keys that the index lacks to their lists; how many.  Nothing is trained, and of the lists only keys are read.

        A vector that changed keeps its old place until the next build.
        """
        new = embeddings.join(self.rows.select(*KEY), KEY, "left_anti").dropDuplicates(KEY)
        path = self.store.stage("ann_lists", by_list(placed(new, self.model)), ["list_id"])
        added = self.store._parts("ann_lists", [path]).count() if _any_file(self.store, path) else 0
        if added:
            self.store.commit({"ann_lists": path}, at, frozenset({"ann_lists"}))
        return added

    def compact(self, at: int, parts: int = 16) -> bool:
        """Write lists of more than so many appends as one version."""
        return self.store.compact("ann_lists", at, parts, ["list_id"])

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """Approximate knn as :func:`similarity.knn` gives it; up to N.BLOCK queries read the lists they probe, more meet all lists by codes."""
        probes = min(probes or self.model.probes, len(self.model.centroids))
        good = N.valid(queries, self.model.dim).select(*KEY, "embedding")
        few = good.limit(N.BLOCK + 1).collect()
        if not few:
            return N.ranked(queries.sparkSession.createDataFrame([], N._NEAR_SQL), k)
        if len(few) <= N.BLOCK:
            return N.probed_knn(few, self.rows, self.model.centroids, k, probes)
        rows = self.rows
        return N.ivf_knn(good, index_of(rows, self.model), rows, k, probes, self.model.shortlist)


def by_list(rows: DataFrame) -> DataFrame:
    """One file a list, but for long ones, which adaptive execution may split."""
    return rows.hint("rebalance", "list_id")


def _any_file(store: Store, path: str) -> bool:
    p = store.spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(store.spark._jsc.hadoopConfiguration()).listStatus(p)
    return any(f.isDirectory() for f in found)
