"""Language identification with a string kernel.

The kernel is the blended spectrum in its presence form: two texts are as alike
as the number of 1- to 3-grams that both have at all, over the geometric mean of
their numbers of grams.  Grams are of lower-cased letters, with everything else
as one blank; all grams count, as one of 2**``SLOTS`` hashes each.  ``LANDMARKS``
training texts (Nystroem) give every text a vector of kernel values; one-versus-
rest kernel ridge regression on it has a column of weights for each language.
Kernel and weights are linear in the presence of grams, so the product of the
landmarks' grams and the weights is taken once (a row for each gram that any
landmark has), and a batch is scored by the product of its presence rows, which
are sparse, with that matrix.

Training rows are a bounded sample: at most ``TRAIN_ROWS`` labelled documents and
``TRAIN_BYTES`` of text that are not held out, equal shares of both for every
language, chosen by a hash of doc_id; whole texts are learned from (one that alone
exceeds its language's share of bytes is not) and whole texts are scored.  Held out
are documents with crc32(doc_id as text) mod 4 = 2; neither they nor lang, source or
doc_id enter a prediction.

Cases: null text or one without letters is ``und`` with score 0; without any
training row every text is; a text none of whose grams any landmark has gets the
language that sorts first, with score 0; a null doc_id is not held out and not
learned from; texts of any length make one row of presence; ties go to the language
that sorts first; repeated rows are judged each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from . import words as W
from .cluster import ship, table

TRAIN_ROWS = 1600
TRAIN_BYTES = 64 << 20
LANDMARKS = 192
RIDGE = 1e-2
SLOTS = 20
TEXTS = 16  # that are looked at together
_U = np.uint64


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-cased letter of each code point, 0 for all others."""
    out = np.zeros(0x110000, np.uint32)
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    text = "".join(map(chr, points))
    for m in regex.finditer(r"\p{L}+", text):
        for p in points[m.start() : m.end()]:
            low = chr(p).lower()
            out[p] = ord(low) if len(low) == 1 else p
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, text) of every gram, and the number of letters of each text."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    letter = _letters()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    doc = np.searchsorted(offsets, first, "right") - 1
    n_letters = np.bincount(doc, letter > 0, len(offsets) - 1).astype(np.int64)
    keep = np.ones(len(letter), bool)  # of a run of others one stays
    keep[1:] = (letter[1:] > 0) | (letter[:-1] > 0) | (doc[1:] != doc[:-1])
    letter, doc = letter[keep].astype(_U), doc[keep]
    slots, docs = [], []
    with np.errstate(over="ignore"):
        code = np.zeros(len(letter), _U)
        for n in (1, 2, 3):
            if len(letter) < n:
                break
            code = code[: len(letter) - n + 1] * _U(0x110001) + letter[n - 1 :] + _U(n)
            inside = doc[: len(code)] == doc[n - 1 :]
            slots.append((W.mix(code[inside]) >> _U(64 - SLOTS)).astype(np.int64))
            docs.append(doc[: len(code)][inside])
    return (np.concatenate(slots), np.concatenate(docs), n_letters) if slots else (np.zeros(0, np.int64), np.zeros(0, np.int64), n_letters)


_places: list[np.ndarray] = []


def presence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, text) of every gram that a text has, once each, by text, and the number of letters of each text."""
    if not _places:
        _places.append(np.empty(TEXTS << SLOTS, np.int32))
    last = _places[0]  # where a (text, slot) was seen last; needs no clearing
    slots, docs, letters = [], [], []
    for at in range(0, len(offsets) - 1, TEXTS):
        cut = offsets[at : at + TEXTS + 1]
        slot, doc, own = grams(data[cut[0] : cut[-1]], cut - cut[0])
        key = (doc << SLOTS) + slot
        number = np.arange(len(key), dtype=np.int32)
        last[key] = number
        once = np.flatnonzero(last[key] == number)
        once = once[np.argsort(doc[once], kind="stable")]
        slots.append(slot[once])
        docs.append(doc[once] + at)
        letters.append(own)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(slots), np.concatenate(docs), np.concatenate(letters)) if slots else (empty, empty, empty)


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # of each slot, -1 for none
    matrix: np.ndarray  # (grams of landmarks, outputs): the landmarks' presence rows, scaled, times weights

    def product(self, slot: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Scaled presence rows times the matrix, and how many grams of each text are known."""
        size = np.sqrt(np.maximum(np.bincount(doc, minlength=texts), 1))
        col = self.column[slot]
        col, doc = col[col >= 0], doc[col >= 0]
        known = np.bincount(doc, minlength=texts)
        out = np.zeros((texts, self.matrix.shape[1]))
        full = np.flatnonzero(known)
        begin = np.cumsum(known)[full] - known[full]
        for i in range(0, len(full), 64):
            part, upto = full[i : i + 64], begin[i + 64] if i + 64 < len(full) else len(col)
            out[part] = np.add.reduceat(self.matrix[col[begin[i] : upto]], begin[i : i + 64] - begin[i], axis=0)
        return out / size[:, None], known

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        slot, doc, letters = presence(data, offsets)
        if not self.languages:
            return ["und"] * len(letters), np.zeros(len(letters))
        f, known = self.product(slot, doc, len(letters))
        best = f.argmax(1)
        score = np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1)
        return [self.languages[b] if n else "und" for b, n in zip(best, letters, strict=True)], np.where((letters > 0) & (known > 0), score, 0.0)


def train(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Texts come in a fixed order; landmarks are taken from each language in turn."""
    languages = sorted(set(langs))
    own = {g: [i for i, x in enumerate(langs) if x == g] for g in languages}
    chosen: list[int] = []
    for k in range(max(map(len, own.values()), default=0)):
        chosen += [own[g][k] for g in languages if k < len(own[g])]
    chosen = chosen[: max(landmarks, len(languages))]
    column = np.full(1 << SLOTS, -1, np.int32)
    if not chosen:
        return Model([], column, np.zeros((1, 0)))
    encode = lambda rows: W.text_bytes(pa.array(rows, pa.large_string()))
    slot, doc, _ = presence(*encode([texts[i] for i in chosen]))
    known = np.unique(slot)
    column[known] = np.arange(len(known))
    marks = np.zeros((max(1, len(known)), len(chosen)), np.float32)
    marks[column[slot], doc] = (1 / np.sqrt(np.bincount(doc, minlength=len(chosen))))[doc]
    kernel = Model(languages, column, marks)
    of = lambda rows: kernel.product(*presence(*encode(rows))[:2], len(rows))[0]
    k = np.concatenate([of(texts[i : i + 200]) for i in range(0, len(texts), 200)])
    kmm = of([texts[i] for i in chosen])
    value, vector = np.linalg.eigh((kmm + kmm.T) / 2)
    good = value > max(value.max() * 1e-6, 1e-12)
    root = vector[:, good] / np.sqrt(value[good])
    z = k @ root
    y = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    w = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y)
    return Model(languages, column, marks @ (root @ w))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> tuple[list[str], list[str]]:
    """Texts and languages of the training sample: rows and bytes in all at most, equal shares a language (one row at least)."""
    able = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    share = lambda n: most_bytes // max(1, n)
    counts = able.groupBy("lang").count()
    languages = counts.count()
    each = max(1, rows // max(1, languages))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # few more than the sample pass, of every language alike
    limit = counts.select(F.col("lang").alias("of"), F.least(F.lit(1 << 30), F.ceil(F.lit(1.5 * each * (1 << 30)) / F.col("count")) + 1).alias("below"))
    some = able.withColumn("draw", draw).join(F.broadcast(limit), F.col("lang") == F.col("of")).where(F.col("draw") < F.col("below"))  # a row a language
    some = some.withColumn("size", F.octet_length("text")).where(F.col("size") <= share(languages))
    order = Win.partitionBy("lang").orderBy("draw", "doc_id", "text_hash")
    ranked = some.withColumn("text_hash", F.xxhash64("text")).withColumns({"nth": F.row_number().over(order), "upto": F.sum("size").over(order)})
    got = ranked.where((F.col("nth") <= each) & (F.col("upto") <= share(languages))).orderBy("draw", "doc_id", "text_hash").select("text", "lang").collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # a row for each gram of the landmarks, whose texts TRAIN_BYTES bounds

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.slices(batch):
                lang, score = sent.value.predict(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(*sample(docs))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
