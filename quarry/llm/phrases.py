"""Phrase collocation mining over deduplicated pieces.

1. Texts are cut into pieces (at `.,;:!?` and line ends) of words with one space
   between them.  Identical pieces of a language become one row with a
   multiplicity, first within an Arrow batch, then by one shuffle; all later steps
   read this table, so copies of documents and shared passages cost once.
2. Phrases of 1, 2, ... 5 words are counted, one length after the other.  A batch
   adds up its own equal phrases with their multiplicities; the sums are shuffled to
   hash buckets, and DuckDB counts a bucket out of core (it spills beyond
   ``BUCKET_MB``) and gives back the phrases with ``least`` occurrences or more.
   Phrases are keyed by language and text, never by a digest.  A phrase of k words
   can only be frequent if both its phrases of k-1 words are, so those are asked
   first: a filter of ``FILTER_BITS`` bits, the same at any size, that no frequent
   phrase fails (a full filter lets more through, which are then counted and fall).
3. A candidate asks for the counts of the two parts of each cut.  The requests are
   shuffled to the buckets of the parts and joined with the counts there; as many
   candidates share a part, requests are dealt over ``SALTS`` and the counts, which
   are few, copied as often.  Every part of a frequent phrase is frequent, so every request has an answer.
4. A candidate goes if a longer one holds it as often.  If a longer one does, so
   does one that has one word more, as counts fall with length; hence each candidate
   asks for the two that it gets by leaving out its last or its first word.

Scores are exact: products are decimals of 38 digits, the division is one of integers.

Cases: a null text is empty; a null lang is `und`; a text or piece without words gives
nothing; white space inside a piece counts as one space; A-Z are lower-cased, nothing
else; very long pieces are read whole; repeated rows count as often as they stand; an
empty table gives an empty result; equal scores are ordered by a, then by the phrase's
bytes.  Other columns are not read.

DuckDB spills to a folder of the task's own that is gone when the bucket is counted,
as Spark's own sorts do; no other task reads it, and a lost task is run again.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from . import words as W
from .cluster import materialise, ship, table

LONGEST = 5
LEAST = 100
TOP = 2000
#: Bits of the filter of frequent phrases (8 MB).
FILTER_BITS = 26
#: Memory that DuckDB may use for one bucket.
BUCKET_MB = 256
#: Phrases that are added up at once in a task.
BATCH_PHRASES = 1 << 20
SALTS = 16

_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_SEPARATOR
_WORD[[0x20, 0x09]] = False
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[0x20] = False
_PIECES = pa.schema([("lang", pa.large_string()), ("piece", pa.large_string()), ("n_words", pa.int32()), ("n", pa.int64())])
_COUNTED = pa.schema([("lang", pa.large_string()), ("phrase", pa.large_string()), ("n", pa.int64())])


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    place = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[place]))


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Text number, normalised piece and number of words of every piece with a word."""
    w = W.find(data, offsets, _WORD, True)
    if not len(w.start):
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int32)
    part = W.running(_SEPARATOR[w.data])[w.start]
    begins = np.ones(len(w.start), bool)
    begins[1:] = (part[1:] != part[:-1]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(w.start)) - 1
    # a copy of the words in which each is followed by one space: pieces are ranges of it
    size = w.end - w.start
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    joined = np.full(at[-1], 0x20, np.uint8)
    owner = np.arange(at[-1] - len(size))
    joined[owner + np.repeat(np.arange(len(size)), size)] = w.data[owner + np.repeat(w.start - (at[:-1] - np.arange(len(size))), size)]
    return w.doc[first], _gather(joined, at[first], at[last] + size[last]), (last - first + 1).astype(np.int32)


def _summed(t: pa.Table, keys: list[str]) -> pa.Table:
    out = t.group_by(keys, use_threads=False).aggregate([("n", "sum")])
    return out.rename_columns([*keys, "n"])


def _batches(t: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from t.select(schema.names).cast(schema).to_batches(max_chunksize=1 << 16)


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece, n_words, n: the distinct pieces of each language with their multiplicities."""
    ship(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            for part, data, offsets in W.slices(batch):
                doc, piece, n_words = cut(data, offsets)
                lang = part.column(0).cast(pa.large_string()).take(pa.array(doc))
                held.append(_summed(pa.table({"lang": lang, "piece": piece, "n_words": n_words, "n": np.ones(len(doc), np.int64)}), ["lang", "piece", "n_words"]))
                rows += held[-1].num_rows
                if rows > BATCH_PHRASES // 2:
                    yield from _batches(_summed(pa.concat_tables(held), ["lang", "piece", "n_words"]), _PIECES)
                    held, rows = [], 0
        if held:
            yield from _batches(_summed(pa.concat_tables(held), ["lang", "piece", "n_words"]), _PIECES)

    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    found = read.mapInArrow(each, "lang string, piece string, n_words int, n long")
    return found.groupBy("lang", "piece", "n_words").agg(F.sum("n").alias("n"))


def _lang_hash(column: pa.Array) -> np.ndarray:
    """A hash of the language of each row."""
    coded = column.cast(pa.large_string()).dictionary_encode()
    data, offsets = W.text_bytes(coded.dictionary)
    return W.mix(W.hash_ranges(data, offsets[:-1], offsets[1:]) + _U(7))[np.asarray(coded.indices)]


def _phrase_hash(w: W.Words, lang: np.ndarray, k: int) -> np.ndarray:
    """Hash of the language and the k words from each word on (past a piece's end too)."""
    h = W.chain(w.hash, k)
    with np.errstate(over="ignore"):
        return W.mix(h + lang[w.doc[: len(h)]])


def phrases_of(batch: pa.RecordBatch, k: int, passed: np.ndarray | None) -> pa.Table:
    """lang, phrase, n of all k words of pieces (lang, piece, n) whose phrases of k-1 words the filter lets pass."""
    w = W.find(*W.text_bytes(batch.column(1)), _NOT_BLANK)
    n = len(w.start) - k + 1
    if n <= 0:
        return _COUNTED.empty_table()
    at = w.doc[:n] == w.doc[k - 1 :]
    if passed is not None:
        h = _phrase_hash(w, _lang_hash(batch.column(0)), k - 1) & _U((1 << FILTER_BITS) - 1)
        ok = (passed[(h >> _U(3)).astype(np.int64)] >> (h & _U(7)).astype(np.uint8)) & 1 == 1
        at &= ok[:n] & ok[1 : n + 1]
    at = np.flatnonzero(at)
    doc = pa.array(w.doc[at])
    return pa.table({"lang": batch.column(0).cast(pa.large_string()).take(doc), "phrase": _gather(w.data, w.start[at], w.end[at + k - 1]), "n": batch.column(2).take(doc)})


def count_bucket(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sums of n for each lang and phrase of a bucket, those of least or more, out of core."""
    import duckdb

    first = next(batches, None)
    if first is None:
        return

    def rows() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    with tempfile.TemporaryDirectory(prefix="quarry-bucket-") as scratch, duckdb.connect(f"{scratch}/b.db", config={"memory_limit": f"{BUCKET_MB}MB", "threads": 1, "temp_directory": scratch}) as con:
        con.register("part", pa.RecordBatchReader.from_batches(first.schema, rows()))
        found = con.sql(f"SELECT lang, phrase, CAST(sum(n) AS BIGINT) AS n FROM part GROUP BY lang, phrase HAVING sum(n) >= {least}").to_arrow_table()
    yield from _batches(found, _COUNTED)


def _filter(frequent: DataFrame, k: int) -> np.ndarray:
    """Bits of the hashes of phrases of k words: FILTER_BITS / 8 bytes, however many phrases there are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = W.find(*W.text_bytes(b.column(1)), _NOT_BLANK)
                h = _phrase_hash(w, _lang_hash(b.column(0)), k)[w.first[:-1]] & _U((1 << FILTER_BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array((h >> _U(6)).astype(np.int64)), pa.array(np.left_shift(_U(1), h & _U(63)).view(np.int64))], ["slot", "bits"])

    set_bits = frequent.select("lang", "phrase").mapInArrow(each, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), _U)
    out[set_bits["slot"].to_numpy()] = set_bits["bits"].to_numpy().view(_U)
    return out.view(np.uint8)


def counts(piece: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, n, k: all phrases of 1 to longest words that stand least times or more in the pieces."""
    spark = piece.sparkSession
    levels: list[DataFrame] = []
    for k in range(1, longest + 1):
        passed = spark.sparkContext.broadcast(_filter(levels[-1], k - 1)) if levels else None

        def each(batches: Iterator[pa.RecordBatch], k: int = k, passed=passed) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []
            rows = 0
            for batch in batches:
                for part, _, _ in W.slices(batch, "piece"):
                    held.append(phrases_of(part, k, passed.value if passed else None))
                    rows += held[-1].num_rows
                    if rows > BATCH_PHRASES:
                        held = [_summed(pa.concat_tables(held), ["lang", "phrase"])]
                        rows = 0
                        if held[0].num_rows > BATCH_PHRASES // 2:
                            yield from _batches(held[0], _COUNTED)
                            held = []
            if held:
                yield from _batches(_summed(pa.concat_tables(held), ["lang", "phrase"]), _COUNTED)

        found = piece.where(F.col("n_words") >= k).select("lang", "piece", "n").mapInArrow(each, "lang string, phrase string, n long")
        counted = found.repartition("lang", "phrase").mapInArrow(lambda b: count_bucket(b, least), "lang string, phrase string, n long")
        levels.append(materialise(counted.withColumn("k", F.lit(k))))
        if passed is not None:
            passed.unpersist()
    return reduce(DataFrame.unionByName, levels)


def _exact(name: str):
    return F.col(name).cast("decimal(17,0)")


def score(counted: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of the lowest-scoring cut of every phrase of two words or more."""
    candidates = counted.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"))
    words = F.split("phrase", " ", -1)
    asked = candidates.select("lang", "phrase", "k", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    part = lambda side, start, size: F.struct(F.lit(side).alias("side"), F.array_join(F.slice("w", start, size), " ").alias("part"))
    sides = F.explode(F.array(part("l", F.lit(1), F.col("cut")), part("r", F.col("cut") + 1, F.col("k") - F.col("cut"))))
    requests = asked.select("lang", "phrase", "k", "a", "cut", sides.alias("s"), F.pmod(F.xxhash64("phrase", "cut"), F.lit(SALTS)).alias("salt")).select("*", "s.side", "s.part").drop("s")
    known = counted.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("n").alias("f"), F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    answers = requests.join(known, (F.col("lang") == F.col("of")) & (requests["part"] == known["part"]) & (requests["salt"] == known["salt"]))
    value = lambda side: F.max(F.when(F.col("side") == side, F.col("f")))
    cuts = answers.groupBy("lang", "phrase", "k", "a", "cut").agg(value("l").alias("l"), value("r").alias("r")).join(F.broadcast(totals), "lang")
    exact = F.expr("(cast(a as decimal(17,0)) * cast(n as decimal(17,0)) * 1000) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    best = F.min(F.struct(exact.alias("score"), "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "k", "a", "n").agg(best).select("lang", "phrase", "k", "a", "best.l", "best.r", "n", "best.score")


def maximal(scored: DataFrame) -> DataFrame:
    """Without the candidates that stand in a longer one as often as by themselves."""
    words = F.split("phrase", " ", -1)
    inner = F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " ")))
    covered = scored.where("k > 2").select("lang", F.col("a").alias("as_often"), inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("as_often").alias("as_often"))
    return scored.join(covered, ["lang", "phrase"], "left").where("as_often is null or 100 * as_often < 100 * a").drop("as_often")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's top phrases."""
    found = materialise(pieces(docs))
    totals = found.groupBy("lang").agg(F.sum(F.col("n_words") * F.col("n")).alias("n"))
    scored = maximal(materialise(score(counts(found, least, longest), totals)))
    order = Win.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k))
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}
), cuts AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM f WHERE k >= 2
), cut_scores AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.c, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.c], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.c + 1 : c.k], ' ') JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, k, a, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2))
  GROUP BY ALL
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN inner_phrases i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.a IS NULL OR 100 * i.a < 100 * s.a
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) WHERE rank <= {TOP}
"""
