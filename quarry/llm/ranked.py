"""Ranked lexical search on inverted treaps.

1. One pass over the documents writes a forward index: doc_id, number of terms and, of
   the terms that some item has, their numbers and occurrences.  N, L and the document
   frequencies of the items' terms are aggregates of it.
2. A task reads its rows of the index and takes blocks of about ``BLOCK_POSTINGS``
   postings.  In a block each term's postings become a treap: a search tree by
   document (in order of doc_id), a heap by impact.  Heap keys are impacts in
   ``LEVELS`` steps, equal steps in hashed order, so that documents sorted by length
   do not make a treap a chain; with each node stands the greatest impact of its step
   in the list, which bounds its whole subtree.
3. All items walk the treaps of a block at once, many places in one vector step.  A
   place of the walk is an item, an open interval of documents and for each of the item's
   terms the highest node inside the interval.  It is dropped if the sum of the nodes'
   bounds cannot enter the item's top k found so far by the task.  Otherwise the
   document at the node with the greatest share is scored exactly and splits the
   interval in two; nodes go down their trees until they lie inside.
4. Each task gives its top k of an item; groups of tasks, then all, keep the best k.

The texts are never shuffled.  Items, a stated query set, are compiled in blocks of
``ITEM_BYTES`` of text, so that what is broadcast has this bound; a larger set
means one more pass for each block.

Cases: a null or empty text has no terms and is not counted in N; an item without terms
has no rows; equal rows of the benchmark count once, rows that share an item_id but not
the text are ranked each; an item without item_id is ranked as any other.  Repeated
documents are ranked each; a document without doc_id comes last among equal scores.
Very long texts are read whole.  Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .cluster import materialise, ship, table

TOP = 20
ITEM_BYTES = 4 << 20
BLOCK_POSTINGS = 1 << 21
#: Nodes that one vector step looks at, about.
STEP_NODES = 1 << 18
#: Tasks whose results are cut to the top k together, before all are.
GROUP_TASKS = 64
#: Impacts are below 1,000,000, so there are at most 62 steps of this many bits.
LEVEL_BITS = 14
LEVELS = (1_000_000 >> LEVEL_BITS) + 1

_U = np.uint64
_NO_ID = np.iinfo(np.int64).max


@dataclass
class Items:
    """A block of items: the distinct terms, and which terms each item has how often."""

    ids: list
    terms: W.Words  # one text of distinct terms, in order of ``number``
    hashes: np.ndarray  # sorted
    number: np.ndarray  # of the term with each of these hashes
    item: np.ndarray
    term: np.ndarray
    repeats: np.ndarray

    @property
    def n_terms(self) -> int:
        return len(self.terms.start)


def compile_items(ids: list, texts: list[str]) -> Items:
    w = W.find(*W.text_bytes(pa.array(texts, pa.large_string())), W.ALNUM, True)
    words = [w.text(i) for i in range(len(w.start))]
    numbers: dict[bytes, int] = {}
    term = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    key, repeats = np.unique(w.doc * max(1, len(numbers)) + term, return_counts=True)
    joined = np.frombuffer(b" ".join(numbers), np.uint8)
    terms = W.find(joined, np.array([0, len(joined)]), W.ALNUM)
    order = np.argsort(terms.hash, kind="stable")
    return Items(ids, terms, terms.hash[order], order, key // max(1, len(numbers)), key % max(1, len(numbers)), repeats)


def item_blocks(benchmark: DataFrame, block_bytes: int = ITEM_BYTES) -> Iterator[Items]:
    """The distinct rows in blocks of about block_bytes of text, one item at least."""
    rows = benchmark.select("item_id", F.col("text").cast("string")).where("text is not null").distinct()
    ids, texts, size = [], [], 0
    for item, text in rows.toLocalIterator():
        own = len(text.encode())
        if size and size + own > block_bytes:
            yield compile_items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += own
    if ids:
        yield compile_items(ids, texts)


def known_terms(w: W.Words, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that are terms of items, and the terms' numbers; compared byte by byte."""
    spot = np.searchsorted(items.hashes, w.hash)
    place, number = [], []
    at = np.flatnonzero(spot < len(items.hashes))
    while len(at):  # once, but for distinct terms with one hash
        at = at[items.hashes[spot[at]] == w.hash[at]]
        same = W.same_words(w, at, items.terms, items.number[spot[at]])
        place.append(at[same])
        number.append(items.number[spot[at[same]]])
        at = at[~same]
        spot[at] += 1
        at = at[spot[at] < len(items.hashes)]
    return np.concatenate(place or [np.zeros(0, np.int64)]), np.concatenate(number or [np.zeros(0, np.int64)])


def forward_index(docs: DataFrame, items) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tf of the items' terms, of documents with a term."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.slices(batch):
                w = W.find(data, offsets, W.ALNUM, True)
                place, number = known_terms(w, items.value)
                v = max(1, items.value.n_terms)
                key, tf = np.unique(w.doc[place] * v + number, return_counts=True)
                some = np.flatnonzero(w.counts)
                bounds = np.append(np.searchsorted(key, some * v), len(key)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (key % v, tf)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(w.counts[some].astype(np.int64)), *lists], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, n long, terms array<int>, tf array<int>")


@dataclass
class Treaps:
    """The treaps of a block, one after the other; node 0 is none."""

    doc: np.ndarray
    impact: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: np.ndarray  # of each term
    key: np.ndarray  # ascends with term and document
    n_docs: int


def _greater_neighbours(heap: np.ndarray, inner: np.ndarray, step: int) -> np.ndarray:
    """For each inner place the nearest one in the direction of step that is greater (to the left: or equal)."""
    near = np.arange(len(heap)) + step
    at = inner
    while len(at):
        at = at[heap[near[at]] < heap[at]] if step < 0 else at[heap[near[at]] <= heap[at]]
        near[at] = near[near[at]]  # all in between are smaller
    return near


def build(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int) -> Treaps:
    """Treaps of postings in order of (term, doc): each list is preceded by a place that is greater than all."""
    sizes = np.bincount(term, minlength=n_terms)
    head = np.cumsum(sizes + 1) - (sizes + 1)
    inner = np.arange(len(term)) + term + 1
    size = len(term) + n_terms + 1
    full = lambda values, other, kind=np.int64: _placed(size, inner, values, other, kind)
    level = impact >> LEVEL_BITS
    with np.errstate(over="ignore"):
        chance = (W.mix(doc.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(1)) >> _U(24)).astype(np.int64)
    heap = full((level << 40) | chance, _NO_ID)
    lo, hi = _greater_neighbours(heap, inner, -1), _greater_neighbours(heap, inner, 1)
    lo, hi = lo[inner], hi[inner]
    left, right, root = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(n_terms, np.int64)
    under_right = heap[hi] <= heap[lo]  # the smaller of both is the parent
    top = (heap[lo] == _NO_ID) & (heap[hi] == _NO_ID)
    root[term[top]] = inner[top]
    left[hi[under_right & ~top]] = inner[under_right & ~top]
    right[lo[~under_right]] = inner[~under_right]
    steps = np.zeros(n_terms * LEVELS, np.int64)
    np.maximum.at(steps, term * LEVELS + level, impact)
    key = full(term * (n_docs + 1) + doc + 1, 0)
    key[head], key[-1] = np.arange(n_terms) * (n_docs + 1), n_terms * (n_docs + 1)
    return Treaps(full(doc, -1), full(impact, 0), full(steps[term * LEVELS + level], 0), left, right, root, key, n_docs)


def _placed(size: int, at: np.ndarray, values: np.ndarray, other: int, kind) -> np.ndarray:
    out = np.full(size, other, kind)
    out[at] = values
    return out


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def lengths(n: np.ndarray, docs: int, all_terms: int) -> np.ndarray:
    """m of documents with n terms; beyond 64 bits in Python's integers."""
    if len(n) and 25 * int(n.max()) * docs >= 1 << 63:
        return np.array([75 + 25 * int(x) * docs // all_terms for x in n], np.int64)
    return 75 + (25 * n * docs) // all_terms


@dataclass
class Walk:
    """Places of a walk: item and interval of each, and the flat list of their nodes."""

    item: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    owner: np.ndarray  # place of each node, ascending, all places occur
    node: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.searchsorted(self.owner, np.arange(len(self.item)))

    def only(self, places: np.ndarray, nodes: np.ndarray) -> Walk:
        """The flagged nodes of flagged places; every flagged place has one."""
        number = np.cumsum(places) - 1
        return Walk(self.item[places], self.lo[places], self.hi[places], number[self.owner[nodes]], self.node[nodes], self.term[nodes], self.weight[nodes])

    def and_also(self, other: Walk) -> Walk:
        owner = np.concatenate([self.owner, other.owner + len(self.item)])
        return Walk(*(np.concatenate([getattr(self, c), getattr(other, c)]) if c != "owner" else owner for c in self.__dataclass_fields__))

    def halves(self) -> list[Walk]:
        first = np.arange(len(self.item)) < (len(self.item) + 1) // 2
        return [self.only(p, p[self.owner]) for p in (first, ~first)]


class Best:
    """The top k of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.doc = np.full((items, k), _NO_ID)
        self.unnamed = np.zeros((items, k), bool)

    def least(self, item: np.ndarray) -> np.ndarray:
        """A score that is needed to enter."""
        return np.maximum(self.score[item, -1], 1)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, unnamed: np.ndarray) -> None:
        ok = score >= self.least(item)
        if not ok.any():
            return
        touched = np.unique(item[ok])
        items = np.concatenate([np.repeat(touched, self.k), item[ok]])
        parts = [np.concatenate([old[touched].ravel(), new[ok]]) for old, new in ((self.score, score), (self.doc, doc), (self.unnamed, unnamed))]
        order = np.lexsort((parts[2], parts[1], -parts[0], items))
        first = np.searchsorted(items[order], touched)
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        keep = order[rank < self.k]
        for mine, part in zip((self.score, self.doc, self.unnamed), parts, strict=True):
            mine[touched] = part[keep].reshape(len(touched), self.k)


def _inside(t: Treaps, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The highest node below each that lies inside its open interval, 0 where there is none."""
    node = node.copy()
    at = np.arange(len(node))
    while len(at):
        own = node[at]
        before, after = t.doc[own] <= lo[at], t.doc[own] >= hi[at]
        out = (before | after) & (own > 0)
        at, own, before = at[out], own[out], before[out]
        node[at] = np.where(before, t.right[own], t.left[own])
    return node


def walk(t: Treaps, items: Items, weight: np.ndarray, best: Best, doc_id: np.ndarray, unnamed: np.ndarray) -> int:
    """Enter the block's documents into best; returns how many were scored."""
    value = weight[items.term] * items.repeats
    node = t.root[items.term]
    some = (node > 0) & (value > 0)
    place, owner = np.unique(items.item[some], return_inverse=True)
    open_walks = [Walk(place, np.full(len(place), -1), np.full(len(place), t.n_docs), owner, node[some], items.term[some], value[some])]
    scored = 0
    while open_walks:
        now = open_walks.pop()
        while open_walks and len(now.node) + len(open_walks[-1].node) <= STEP_NODES:
            now = now.and_also(open_walks.pop())
        if not len(now.item):
            continue
        if len(now.node) > STEP_NODES and len(now.item) > 1:
            open_walks.extend(reversed(now.halves()))
            continue
        share = now.weight * t.bound[now.node]
        keep = np.add.reduceat(share, now.starts) >= best.least(now.item)
        if not keep.any():
            continue
        flat = keep[now.owner]
        now, share = now.only(keep, flat), share[flat]
        greatest = np.flatnonzero(share == np.maximum.reduceat(share, now.starts)[now.owner])
        first = greatest[np.searchsorted(now.owner[greatest], np.arange(len(now.item)))]
        d = t.doc[now.node[first]]
        split = d[now.owner]
        wanted = now.term * (t.n_docs + 1) + split + 1
        found = np.searchsorted(t.key, wanted)
        score = np.add.reduceat(now.weight * np.where(t.key[found] == wanted, t.impact[found], 0), now.starts)
        best.add(now.item, score, doc_id[d], unnamed[d])
        scored += len(d)
        for lo, hi in ((now.lo, d), (d, now.hi)):
            below = _inside(t, now.node, lo[now.owner], hi[now.owner])
            nodes = below > 0
            places = np.zeros(len(now.item), bool)
            places[now.owner[nodes]] = True
            open_walks.append(Walk(now.item, lo, hi, now.owner, below, now.term, now.weight).only(places, nodes))
    return scored


def search_block(rows: pa.Table, items: Items, weight: np.ndarray, docs: int, all_terms: int, best: Best) -> int:
    """Build the treaps of rows of the forward index and let all items walk them."""
    rows = rows.combine_chunks()
    unnamed = np.asarray(rows["doc_id"].is_null())
    doc_id = np.asarray(rows["doc_id"].fill_null(_NO_ID))
    order = np.lexsort((unnamed, doc_id))
    local = np.empty(len(order), np.int64)
    local[order] = np.arange(len(order))
    terms, tfs = (rows[c].combine_chunks() for c in ("terms", "tf"))
    terms, tfs = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (terms, tfs))
    owner = np.repeat(np.arange(len(order)), np.diff(np.asarray(terms.offsets)))
    term, tf = np.asarray(terms.flatten()).astype(np.int64), np.asarray(tfs.flatten()).astype(np.int64)
    m = lengths(np.asarray(rows["n"]), docs, all_terms)
    by = np.argsort(term * len(order) + local[owner])
    t = build(term[by], local[owner[by]], impacts(tf, m[owner])[by], items.n_terms, len(order))
    return walk(t, items, weight, best, doc_id[order], unnamed[order])


def _search(index: DataFrame, sent, weight: np.ndarray, docs: int, all_terms: int, top: int) -> DataFrame:
    """task, item (number), score, doc_id: the top of each task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        best = Best(len(items.ids), top)
        held, postings = [], 0
        for batch in batches:
            at = 0
            ends = np.asarray(batch.column(2).offsets)
            while at < batch.num_rows:  # a row has no more postings than items have terms
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_POSTINGS - postings, "right")) - 1)
                held.append(batch.slice(at, upto - at))
                postings += int(ends[upto] - ends[at]) + upto - at
                at = upto
                if postings >= BLOCK_POSTINGS or at < batch.num_rows:
                    search_block(pa.Table.from_batches(held), items, weight, docs, all_terms, best)
                    held, postings = [], 0
        if held:
            search_block(pa.Table.from_batches(held), items, weight, docs, all_terms, best)
        item, place = np.nonzero(best.score)
        found = [np.full(len(item), TaskContext.get().partitionId()), item, best.score[item, place]]
        ids = pa.array(best.doc[item, place], mask=best.unnamed[item, place])
        if len(item):
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in found), ids], ["task", "item", "score", "doc_id"])

    return index.mapInArrow(each, "task long, item long, score long, doc_id long")


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's top documents."""
    spark = docs.sparkSession
    ship(spark)
    of = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", benchmark.schema["item_id"].dataType)])
    results = []
    for items in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)
        index = materialise(forward_index(docs, sent))
        docs_n, all_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(items.n_terms, np.int64)
        for term, df in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block of items
            weight[term] = math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df + 1)))
        found = _search(index, sent, weight, docs_n, all_terms, top)
        names = spark.createDataFrame(list(enumerate(items.ids)), of)
        results.append(found.join(F.broadcast(names), "item").withColumn("item", F.lit(len(results) << 32) + F.col("item")))
    if not results:
        return spark.createDataFrame([], T.StructType([of["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    place = lambda *group: F.row_number().over(Win.partitionBy("item", *group).orderBy(*best))
    few = reduce(DataFrame.unionByName, results).withColumn("group", F.floor(F.col("task") / GROUP_TASKS))
    few = few.withColumn("rank", place("group")).where(F.col("rank") <= top)
    return few.withColumn("rank", place()).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (
  SELECT doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL
), d2 AS (
  SELECT row_number() OVER () AS row, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0
), s AS (
  SELECT count(*) AS docs, sum(n) AS all_terms FROM d2
), items AS (
  SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), q AS (
  SELECT item, item_id, term, count(*) AS repeats FROM (SELECT item, item_id, unnest(w) AS term FROM items) GROUP BY ALL
), p AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(w) AS term FROM d2) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), scores AS (
  SELECT item, item_id, row, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // all_terms)))) AS score
  FROM p JOIN weights USING (term) JOIN q USING (term), s GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= {TOP}
"""
