"""Quality rules by weak supervision.

Simple rules look at every text and vote *good* (+1), *bad* (-1) or abstain
(0).  No rule is trusted: expectation-maximisation estimates from the votes of
the whole corpus how often each rule is right about good and about bad texts,
and the posterior probability of *good* replaces "every rule must pass".

The votes of all documents are summed up as a count for each pattern of votes;
with R rules there are 3**R patterns at most (19,683 for the nine rules here),
whatever the size of the corpus, so EM runs on the driver on counts of
everything and the verdict returns by a broadcast of at most 3**R rows.

Cases: a null text has no words and fails the base rules; so does a text of
white space only.  An empty table gives an empty result (EM then keeps its
starting values).  Texts of any length are read whole.  Repeated rows are judged each.  Columns other than
``doc_id`` and ``text`` are never read here, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .cluster import carried, materialise, ship

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
REPEAT_WORDS = 5
REPEAT_PERCENT = 20

FEATURES = (
    "n_words n_chars_in_words n_symbols n_dup_lines n_repeat_words n_lines n_ended_lines n_letters n_upper n_alpha_words"
).split()
_SCHEMA = "doc_id long, " + ", ".join(f"{x} long" for x in FEATURES)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\"')")] = True


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The features of each text, over all of it."""
    w = W.find(data, offsets, W.NOT_SPACE)
    n, bytes_in = w.n, W.running((data & 0xC0) != 0x80)
    chars = bytes_in[w.end] - bytes_in[w.start]
    del bytes_in
    # words in 5-word windows that the text has twice or more
    h, doc, at = W.windows(w, REPEAT_WORDS)
    _, twice = W.seen_before(doc, h)
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT_WORDS, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    # lines: ends at \n and at the end of each text
    cut = np.flatnonzero(data == 0x0A)
    line_doc = np.concatenate([np.searchsorted(offsets, cut, "right") - 1, np.arange(n)])
    stop = np.concatenate([cut, offsets[1:]])
    order = np.lexsort((stop, line_doc))
    stop, line_doc = stop[order], line_doc[order]
    new_doc = np.ones(len(stop), bool)
    new_doc[1:] = line_doc[1:] != line_doc[:-1]
    start = np.where(new_doc, offsets[line_doc], np.concatenate([[0], stop[:-1] + 1])) if len(stop) else stop
    first_word, last_word = np.searchsorted(w.start, start), np.searchsorted(w.start, stop)
    full = last_word > first_word
    start, stop, line_doc, last_word = start[full], stop[full], line_doc[full], last_word[full]
    later, _ = W.seen_before(line_doc, W.hash_ranges(data, start, stop))
    ended = _STOP[data[w.end[last_word - 1] - 1]] if len(last_word) else np.zeros(0, bool)
    letters = W.running(_LETTER[data] | (data >= 0x80))
    alpha = letters[w.end] > letters[w.start]

    def by(doc: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weight, n).astype(np.int64)

    return {
        "n_words": w.counts,
        "n_chars_in_words": by(w.doc, chars),
        "n_symbols": W.per_text(offsets, _SYMBOL[data]),
        "n_dup_lines": by(line_doc[later]),
        "n_repeat_words": by(w.doc[repeated]),
        "n_lines": by(line_doc),
        "n_ended_lines": by(line_doc[ended]),
        "n_letters": W.per_text(offsets, _LETTER[data]),
        "n_upper": W.per_text(offsets, _UPPER[data]),
        "n_alpha_words": by(w.doc[alpha]),
    }


def _measure_batches(batches: Iterator[pa.RecordBatch], carry: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in W.slices(batch):
            got = measure(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[x]) for x in FEATURES), *(part.column(c) for c in carry)], ["doc_id", *FEATURES, *carry])


def features(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the features of every row; columns named in carry (the text may be one) go along."""
    ship(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[c for c in carry if c != "text"])
    return read.mapInArrow(partial(_measure_batches, carry=carry), _SCHEMA + carried(read, carry))


@dataclass(frozen=True)
class Rule:
    """Votes by a ratio: bad on one side, good on the other, else abstains."""

    name: str
    over: Column
    under: Column
    good: tuple[float, float]
    bad: tuple[tuple[float, float], ...]

    def vote(self) -> Column:
        x = self.over / F.when(self.under > 0, self.under)
        between = lambda r: (x >= r[0]) & (x < r[1])
        bad = F.lit(False)
        for r in self.bad:
            bad = bad | between(r)
        return F.when(x.isNull(), 0).when(bad, -1).when(between(self.good), 1).otherwise(0)


_INF = float("inf")


def default_rules() -> list[Rule]:
    """Thresholds follow common published heuristics for web text."""
    c = F.col
    one = F.lit(1)
    return [
        Rule("length", c("n_words"), one, (40, _INF), ((0, 15),)),
        Rule("word_length", c("n_chars_in_words"), c("n_words"), (3, 9), ((0, 2.2), (14, _INF))),
        Rule("symbols", c("n_symbols"), c("n_words"), (0, 0.05), ((0.3, _INF),)),
        Rule("symbol_chars", c("n_symbols"), c("n_chars_in_words"), (0, 0.02), ((0.1, _INF),)),
        Rule("dup_lines", c("n_dup_lines"), c("n_lines"), (0, 0.1), ((0.34, _INF),)),
        Rule("repeats", c("n_repeat_words"), c("n_words"), (0, 0.05), ((0.18, _INF),)),
        Rule("upper_case", c("n_upper"), c("n_letters"), (0, 0.2), ((0.5, _INF),)),
        Rule("alpha_words", c("n_alpha_words"), c("n_words"), (0.85, _INF), ((0, 0.7),)),
        Rule("line_ends", c("n_ended_lines"), c("n_lines"), (0.5, _INF), ((0, 0.1),)),
    ]


@dataclass(frozen=True)
class LabelModel:
    """P(vote is bad | class, the rule votes) for each rule; abstaining says nothing."""

    prior: float  # of good
    bad_given: np.ndarray  # [class bad/good, rule]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of good, for each row of votes (n, R)."""
        bad, good = (((votes < 0) * np.log(self.bad_given[k]) + (votes > 0) * np.log1p(-self.bad_given[k])).sum(1) for k in (0, 1))
        return 1 / (1 + np.exp(np.clip(bad + np.log1p(-self.prior) - good - np.log(self.prior), -700, 700)))


#: Before any data: a bad text is hit by a few of the rules, a good one hardly by any.
BAD_GIVEN_BAD, BAD_GIVEN_GOOD, GOOD_PRIOR = 0.35, 0.01, 0.85


#: Texts that the starting values count as, at any size of the corpus.
PRIOR_TEXTS = 50.0


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 500, tolerance: float = 1e-9, prior_texts: float = PRIOR_TEXTS) -> LabelModel:
    """EM for two classes with votes independent given the class.

    Texts are bad in different ways, so a bad text gets good votes from most
    rules; what tells is how rare a bad vote is among good texts.  The starting
    values act as prior counts of a fixed number of texts: a rule that never votes
    bad keeps a probability above 0, and the two classes do not swap.
    """
    rules = votes.shape[1]
    start = np.repeat(np.array([[BAD_GIVEN_BAD], [BAD_GIVEN_GOOD]]), rules, 1)
    model = LabelModel(GOOD_PRIOR, start)
    for _ in range(rounds):
        q = model.posterior(votes)
        new = np.empty_like(start)
        for k, weight in ((0, counts * (1 - q)), (1, counts * q)):
            bad, voted = ((votes < 0) * weight[:, None]).sum(0), ((votes != 0) * weight[:, None]).sum(0)
            new[k] = (bad + prior_texts * start[k]) / (voted + prior_texts)
        prior = float(np.clip((counts @ q + prior_texts * GOOD_PRIOR) / (counts.sum() + prior_texts), 0.05, 0.99))
        moved = max(np.abs(new - model.bad_given).max(), abs(prior - model.prior))
        model = LabelModel(prior, new)
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, threshold: float = 0.5, rules: list[Rule] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the features, each rule's vote, p_good, base_failed and kept; columns named in carry go along."""
    spark = docs.sparkSession
    rules = default_rules() if rules is None else rules
    names = [f"vote_{r.name}" for r in rules]
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    code = sum(((F.col(n) + 1) * 3**k for k, n in enumerate(names)), F.lit(0)).cast("int")
    voted = materialise(
        features(docs, carry).withColumns({n: r.vote().cast("int") for n, r in zip(names, rules, strict=True)}).withColumn("pattern", code).withColumn("base_failed", base)
    )
    counted = sorted(voted.groupBy("pattern").count().collect())  # at most 3**R rows, in one order so that sums are the same each time
    pattern = np.array([r["pattern"] for r in counted], np.int64)
    votes = np.stack([pattern // 3**k % 3 - 1 for k in range(len(rules))], 1) if len(rules) else np.zeros((len(pattern), 0), np.int64)
    model = fit(votes, np.array([r["count"] for r in counted], float))
    p = model.posterior(votes)
    verdict = spark.createDataFrame([(int(a), float(b)) for a, b in zip(pattern, p, strict=True)], "pattern int, p_good double")
    return voted.join(F.broadcast(verdict), "pattern", "left").drop("pattern").withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def query(spark, sf_dir: str) -> DataFrame:
    from .cluster import table

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.col("n_chars_in_words").alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )
