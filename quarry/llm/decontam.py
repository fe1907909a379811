"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of 13 consecutive words of the benchmark items
(an item with fewer words, but not none, is one shorter window).  Symbols are
words, a block is two neighbouring words.  For the windows of one length:

* the shift table says, for the block that ends at a place of a document, how
  many places no window can end at, so that most places are never looked at;
* where the shift is 0, the hashes of the last and of the first block are those of a
  bucket of windows that end and begin so; inside it the hash of the whole window
  selects the one to test (so that one common pair of words at the end of many
  windows does not make all of them candidates);
* this window is compared directly, byte by byte, so that an occurrence is certain.

Equal windows, of one item or of many, are one window with a list of items.  A place of
a document is looked up once, words are counted from places and items from the distinct
windows of a document, so repetitive items and texts cost what their lengths are.

Documents are scanned in lanes of some hundred words side by side, whole texts,
one vector step for all lanes; they are never shuffled.  The benchmark, a stated
query set of at most ``MAX_BENCHMARK_BYTES`` (more is refused), travels in blocks of
``BLOCK_BYTES`` of item text each.  A task scans some ``ROUND_BYTES`` of documents
with one block after the other and holds one block at a time.

Cases: a null text has no words; a null item text gives no windows; a row of
the benchmark without item_id is searched and its words are hit, but it is not among the
items, as it cannot be named; repeated items count once; repeated documents are judged each.  An empty benchmark or
table gives no hits or no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .cluster import carried, ship, table

WINDOW = 13
BLOCK_BYTES = 8 << 20
MAX_BENCHMARK_BYTES = 1 << 30
ROUND_BYTES = 32 << 20
LANE = 512
#: Windows that are compared at once.
COMPARED = 1 << 17
_U = np.uint64
_SCHEMA = "doc_id long, n_words long, spans array<struct<first: long, last: long>>, items array<string>"


@dataclass
class _Length:
    """Wu-Manber tables for the distinct windows of one length."""

    length: int
    block: int
    shift: np.ndarray  # by the low bits of a block's hash
    keys: np.ndarray  # hashes of both ends and of the whole window, sorted
    start: np.ndarray  # first word of each window, in order of keys
    items: np.ndarray  # those of window i are items[of[i] : of[i + 1]]
    of: np.ndarray


@dataclass
class Patterns:
    """A block of benchmark items, compiled."""

    ids: list[str | None]
    words: W.Words
    lengths: list[_Length]


def compile_items(ids: list[str | None], texts: list[str], window: int = WINDOW) -> Patterns:
    w = W.find(*W.text_bytes(pa.array(texts, pa.large_string())), W.ALNUM, True)
    per_length: dict[int, list[tuple[np.ndarray, int]]] = {}
    for i, n in enumerate(w.counts):
        if n:
            length = min(int(n), window)
            per_length.setdefault(length, []).append((np.arange(w.first[i], w.first[i + 1] - length + 1), i))
    lengths = []
    for length, found in sorted(per_length.items()):
        start = np.concatenate([s for s, _ in found])
        item = np.concatenate([np.full(len(s), i) for s, i in found])
        block = min(2, length)
        h = W.chain(w.hash, block)
        keys = _window_keys(w, h, start, length, block)
        order = np.argsort(keys, kind="stable")
        keys, start, item = keys[order], start[order], item[order]
        new = np.ones(len(start), bool)
        new[1:] = keys[1:] != keys[:-1]
        again = np.flatnonzero(~new)
        new[again[~_same_windows(w, start[again], w, start[again - 1], length)]] = True
        window = np.cumsum(new) - 1
        named = np.array([i is not None for i in ids], bool)[item]
        pairs = np.unique(window[named] * len(ids) + item[named])
        start, keys = start[new], keys[new]
        bits = int(np.clip(np.ceil(np.log2(16 * len(start) * length)), 12, 24))
        shift = np.full(1 << bits, length - block + 1, np.uint8)
        mask = _U((1 << bits) - 1)
        for back in range(length - block, -1, -1):  # blocks nearer to the end overwrite
            shift[h[start + length - block - back] & mask] = back
        lengths.append(_Length(length, block, shift, keys, start, pairs % len(ids), np.searchsorted(pairs // len(ids), np.arange(len(start) + 1))))
    return Patterns(ids, w, lengths)


def _window_keys(w: W.Words, h: np.ndarray, start: np.ndarray, length: int, block: int) -> np.ndarray:
    """Hashes of windows: of the last and first block (h), and of all words."""
    with np.errstate(over="ignore"):
        key = W.mix(h[start + length - block] + W.mix(h[start]))
        for k in range(length):
            key = W.mix(key + w.hash[start + k] + _U(k + 1))
    return key


def _same_windows(a: W.Words, i: np.ndarray, b: W.Words, j: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows at words a[i] and b[j] have the same bytes."""
    same = np.ones(len(i), bool)
    for at in range(0, len(i), COMPARED):
        part = slice(at, at + COMPARED)
        for k in range(length):
            same[part] &= W.same_words(a, i[part] + k, b, j[part] + k)
    return same


def occurrences(p: Patterns, w: W.Words) -> Iterator[tuple[np.ndarray, np.ndarray, _Length]]:
    """(first words, windows, tables) of all windows found, for each length."""
    for t in p.lengths:
        h = W.chain(w.hash, t.block)  # block at words i..i+block-1
        if len(w.hash) < t.length:
            continue
        mask = _U(len(t.shift) - 1)
        # a lane looks at the last blocks of windows that begin in its stretch of words
        lanes = np.arange(0, len(w.hash) - t.length + 1, LANE)
        limit = np.minimum(lanes + LANE, len(w.hash) - t.length + 1)
        at, hits = lanes.copy(), []
        while len(at):
            jump = t.shift[h[at + t.length - t.block] & mask]
            stop = jump == 0
            hits.append(at[stop])
            at = at + np.maximum(jump, 1)
            on = at < limit
            at, limit = at[on], limit[on]
        start = np.concatenate(hits)
        start = start[w.doc[start] == w.doc[start + t.length - 1]]
        keys = _window_keys(w, h, start, t.length, t.block)
        window = np.searchsorted(t.keys, keys)
        while len(start):  # once, but for distinct windows with one hash
            on = window < len(t.keys)
            on[on] = t.keys[window[on]] == keys[on]
            start, window, keys = start[on], window[on], keys[on]
            sure = _same_windows(w, start, p.words, t.start[window], t.length)
            yield start[sure], window[sure], t
            start, window, keys = start[~sure], window[~sure] + 1, keys[~sure]


class Scan:
    """What is found so far in a slice of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = W.find(data, offsets, W.ALNUM, True)
        self.cover = np.zeros(len(self.words.hash) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in range(self.words.n)]

    def search(self, p: Patterns) -> None:
        w = self.words
        for start, window, t in occurrences(p, w):
            np.add.at(self.cover, start, 1)
            np.add.at(self.cover, start + t.length, -1)
            for pair in np.unique(w.doc[start] * len(t.start) + window).tolist():
                doc, x = divmod(pair, len(t.start))
                self.items[doc].update(p.ids[i] for i in t.items[t.of[x] : t.of[x + 1]].tolist())

    def result(self) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
        """Number of words, spans of hit words and items found, for each text."""
        w, hit = self.words, np.cumsum(self.cover[:-1]) > 0
        # maximal runs of hit words inside a text
        edge = np.ones(len(hit), bool)
        if len(hit):
            edge[1:] = (hit[1:] != hit[:-1]) | (w.doc[1:] != w.doc[:-1])
        run = np.flatnonzero(edge)
        until = np.append(run[1:], len(hit)) if len(run) else run
        keep = hit[run] if len(run) else np.zeros(0, bool)
        spans: list[list[dict]] = [[] for _ in range(w.n)]
        for a, b in zip(run[keep], until[keep], strict=True):
            doc = w.doc[a]
            spans[doc].append({"first": int(a - w.first[doc]), "last": int(b - 1 - w.first[doc])})
        return w.counts, spans, [sorted(x) for x in self.items]


def scan(data: np.ndarray, offsets: np.ndarray, blocks: Iterable[Patterns]) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
    found = Scan(data, offsets)
    for p in blocks:
        found.search(p)
    return found.result()


def compiled(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Patterns]:
    """The benchmark in blocks of about block_bytes of text (one item at least)."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > MAX_BENCHMARK_BYTES:
        raise ValueError(f"a benchmark of {total} bytes; search it in parts of {MAX_BENCHMARK_BYTES}")
    ids, texts, size = [], [], 0
    for item, text in rows.toLocalIterator():
        own = len(text.encode())
        if size and size + own > block_bytes:
            yield compile_items(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += own
    if ids:
        yield compile_items(ids, texts, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, spans of hit words (word numbers, both ends counted) and the items found; columns named in carry go along."""
    spark = docs.sparkSession
    ship(spark)
    sent = [spark.sparkContext.broadcast(p) for p in compiled(benchmark, window, block_bytes)]  # MAX_BENCHMARK_BYTES of text in all

    def blocks() -> Iterator[Patterns]:
        for b in sent:  # one alone stays; of several each is read when its turn comes and not kept
            yield b.value if len(sent) == 1 else b.load_from_path(b._path)

    types = [pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string())]

    def flush(held: list[tuple[pa.RecordBatch, Scan]]) -> Iterator[pa.RecordBatch]:
        for p in blocks():
            for _, found in held:
                found.search(p)
        for part, found in held:
            own = [pa.array(x, t) for x, t in zip(found.result(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *own, *(part.column(c) for c in carry)], ["doc_id", "n_words", "spans", "items", *carry])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part, data, offsets in W.slices(batch):
                held.append((part, Scan(data, offsets)))
                size += len(data)
                if len(sent) < 2 or size > ROUND_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[c for c in carry if c != "text"])
    return read.mapInArrow(each, _SCHEMA + carried(read, carry))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from spans and items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    others = [c for c in found.columns if c not in ("doc_id", "n_words", "spans", "items")]
    return found.select(
        *others,
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), b2 AS (
  SELECT item_id, w, least(len(w), {WINDOW}) AS l FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS s FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM b2)
), hits AS (
  SELECT p.doc_id, p.i, p.l, win.item_id
  FROM (SELECT doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS s
        FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM b2))) p
  JOIN win ON win.l = p.l AND win.s = p.s
), hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
