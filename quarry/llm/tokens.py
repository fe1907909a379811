"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer is two deterministic transducers in a row:

* the *splitter* reads classes of code points (12 of them) and has 12 states; a
  transition is annotated with the piece starts it emits, at the character read
  or at the one before, so that its bounded lookahead needs no second reading;
* the *counter* reads the bytes of a piece; a transition is annotated with the
  number of tokens by which the count of the prefix changes (see ``Machine``).
  It begins anew at every piece start.

Whole texts are cut into chunks of ``CHUNK`` characters.  For every chunk the
map from each start state of the splitter to its end state is found, the maps
are composed by a parallel prefix scan (log2 of the number of chunks steps), and
then all chunks run side by side from their true start states.  The counter
needs no map: the scan gives the pieces, which all run side by side, and their
counts add up.

Special tokens of the vocabulary file split a text first and count as one each,
the library's default.  Cases: null counts as empty (0 bytes, 0 tokens); very
long texts only make more chunks; repeated rows are counted each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .cluster import ship, table

TOKENIZER = "byte_bpe_50k.json"
CHUNK = 256
MAX_STATES = 1 << 17  # of the counting machine, some 2 KB each
KEPT_STATES = MAX_STATES // 8
BATCH = 1 << 18  # bytes of pieces that run side by side, so that they reach fewer new states than there is room for
FEW = 8  # pieces that are not worth a step side by side
LIMIT = 512
_SYNC = 8

# Classes of code points
SPACE, BLANK, QUOTE, LETTER, NUMBER, OTHER, STMD, R, E, V, L, END = range(12)
_LETTERS = {LETTER, STMD, R, E, V, L}
# States: start of a piece, inside letters, numbers, others; after one blank or
# several, the last a space or not; after a piece-starting quote and 'r 'v 'l
START, IN_L, IN_N, IN_O, ONE_SPACE, ONE_BLANK, MANY_SPACE, MANY_BLANK, Q, Q_R, Q_V, Q_L = range(12)
_HERE, _BEFORE = 1, 2  # marks: a piece starts at this character, at the one before


def _run(c: int, joined: bool) -> int:
    """State after a visible character that begins a run, with a space joined to it or not."""
    if c in _LETTERS:
        return IN_L
    if c == NUMBER:
        return IN_N
    return Q if c == QUOTE and not joined else IN_O


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and marks."""
    blank = {SPACE: ONE_SPACE, BLANK: ONE_BLANK}
    if c == END:
        return START, _BEFORE if state in (Q_R, Q_V, Q_L) else 0
    if state in (ONE_SPACE, ONE_BLANK, MANY_SPACE, MANY_BLANK):
        if c in blank:
            return blank[c] + 2, 0
        joined = state in (ONE_SPACE, MANY_SPACE)
        marks = (_BEFORE if state in (MANY_SPACE, MANY_BLANK) else 0) | (0 if joined else _HERE)
        return _run(c, joined), marks
    if state == Q:
        if c == STMD:
            return START, 0
        if c in (R, V, L):
            return {R: Q_R, V: Q_V, L: Q_L}[c], 0
        if c in (QUOTE, OTHER):
            return IN_O, 0
        return (blank[c], _HERE) if c in blank else (_run(c, False), _HERE)
    if state in (Q_R, Q_V, Q_L):
        if c == (L if state == Q_L else E):
            return START, 0
        after, marks = _step(IN_L, c)
        return after, marks | _BEFORE
    if c in blank:
        return blank[c], _HERE
    inside = {IN_L: _LETTERS, IN_N: {NUMBER}, IN_O: {QUOTE, OTHER}}.get(state, set())
    return (state, 0) if c in inside else (_run(c, False), _HERE)


_TABLE = np.array([[_step(s, c)[0] for s in range(12)] for c in range(12)], np.uint8).reshape(-1)
_MARKS = np.array([[_step(s, c)[1] for s in range(12)] for c in range(12)], np.uint8).reshape(-1)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    points = np.array(points)
    for pattern, kind in ((r"\s+", BLANK), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = kind
    for chars, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("e", E), ("v", V), ("l", L)):
        for c in chars:
            out[ord(c)] = kind
    return out


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Prefix compositions of maps (n, states): row i is map 0, then 1, ..., then i."""
    out, by = maps.copy(), 1
    while by < len(out):
        out[by:] = np.take_along_axis(out[by:], out[:-by], 1)
        by *= 2
    return out


def marks_of(classes: np.ndarray) -> np.ndarray:
    """Marks for every character, from START, in chunks side by side."""
    n = len(classes)
    lanes = -(-n // CHUNK)
    grid = np.full(lanes * CHUNK, END, np.int32)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T) * 12
    # maps of chunks: most forget their start state within a few characters
    states = np.repeat(np.arange(12, dtype=np.uint8)[:, None], lanes, 1)
    for k in range(_SYNC):
        states = _TABLE[grid[k] + states]
    one = (states == states[0]).all(0)
    alone = states[0].copy()
    for k in range(_SYNC, CHUNK):
        alone = _TABLE[grid[k] + alone]
    maps = np.repeat(alone[:, None], 12, 1)
    if not one.all():
        own, cells = states[:, ~one], grid[:, ~one]
        for k in range(_SYNC, CHUNK):
            own = _TABLE[cells[k] + own]
        maps[~one] = own.T
    state = np.full(lanes, START, np.uint8)
    state[1:] = compose_scan(maps)[:-1, START]
    marks = np.empty((CHUNK, lanes), np.uint8)
    for k in range(CHUNK):
        at = grid[k] + state
        marks[k] = _MARKS[at]
        state = _TABLE[at]
    return np.ascontiguousarray(marks.T).reshape(-1)[:n]


def _visible_bytes() -> dict[str, int]:
    """The byte that each character of the vocabulary file stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Merges:
    """Ranks of pairs of token numbers; numbers 0..255 are the bytes."""

    rank: dict[tuple[int, int], int]
    whole: list[int]  # the token that the pair of a rank becomes
    special: list[str]
    digest: str  # of the vocabulary file


def read_tokenizer(path: str) -> Merges:
    with open(path, "rb") as f:
        raw = f.read()
    spec = json.loads(raw)
    byte = _visible_bytes()
    number = {c: b for c, b in byte.items()}
    rank, whole = {}, []
    for k, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        whole.append(number.setdefault(a + b, 256 + k))
        rank[number[a], number[b]] = k
    return Merges(rank, whole, [t["content"] for t in spec["added_tokens"]], hashlib.sha256(raw).hexdigest())


class Machine:
    """The deterministic transducer that counts the tokens of a piece byte by byte.

    A piece's tokens are the one way to cut it in which every two neighbours are a
    pair that merging would leave alone, so the count of a prefix is the count
    before its last token plus one, and the last token is the one token that ends
    there and suits the token before it.  What the future depends on is, for every
    place from which some token still runs through the present byte: its node in
    the tree of the vocabulary's byte strings, the last token before the place, and
    how many tokens fewer were counted there.  These triples are a state; a
    transition carries the (possibly negative) number of tokens by which the count
    changes.

    States are made when first reached and kept between tasks.  Where a batch of
    pieces finds ``MAX_STATES`` or more, all but ``KEPT_STATES`` go, at the price of
    making some again: what was met first is what is met often.
    """

    def __init__(self, merges: Merges):
        self.rank, self.whole = merges.rank, merges.whole
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token = [-1]  # that ends at a node
        self.inner = [True]  # whether a node has children
        self.bytes = [bytes([k]) for k in range(256)] + [b""] * (max(self.whole, default=255) - 255)
        for (x, y), r in sorted(self.rank.items(), key=lambda e: e[1]):
            self.bytes[self.whole[r]] = self.bytes[x] + self.bytes[y]
        for number, text in enumerate(self.bytes):
            if text and self.encode(text) == [number]:  # others never come out
                node = 0
                for b in text:
                    self.inner[node] = True
                    if (node << 8 | b) not in self.child:
                        self.child[node << 8 | b] = len(self.token)
                        self.token.append(-1)
                        self.inner.append(False)
                    node = self.child[node << 8 | b]
                self.token[node] = number
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, int] = {((0, -1, 0),): 0}
        self.parts: list[tuple] = [((0, -1, 0),)]
        self._tables()

    def _tables(self) -> None:
        """By state * 256 + byte: one more than the next state, 0 where it is not made yet, and the change of the count."""
        self.next, self.emit = np.zeros(MAX_STATES << 9, np.int32), np.zeros(MAX_STATES << 9, np.int8)  # pages come as they are used

    def keep(self, states: int) -> None:
        """Forget all states but the first so many."""
        if len(self.pairs) > 8 * MAX_STATES:
            self.pairs.clear()
        for gone in self.parts[states:]:
            del self.states[gone]
        del self.parts[states:]
        kept, change = self.next[: states << 8], self.emit[: states << 8]
        self._tables()
        self.next[: len(kept)], self.emit[: len(kept)] = np.where(kept > states, 0, kept), change

    def encode(self, text: bytes) -> list[int]:
        """Tokens of a piece by its merges, lowest rank first."""
        find, whole, none, parts = self.rank.get, self.whole, len(self.whole), list(text)
        ranks = [find(p, none) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [whole[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = find((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = find((parts[i - 1], parts[i]), none)
        return parts

    def suits(self, before: int, token: int) -> bool:
        """Whether merging leaves these neighbours alone."""
        if before < 0:
            return True
        known = self.pairs.get((before, token))
        if known is None:
            known = self.pairs[before, token] = self.encode(self.bytes[before] + self.bytes[token]) == [before, token]
        return known

    def number(self, state: tuple) -> int:
        """Of a state, which may be new."""
        known = self.states.get(state)
        if known is None:
            known = self.states[state] = len(self.parts)
            self.parts.append(state)
        return known

    def make(self, spot: int) -> None:
        """The transition at state * 256 + byte."""
        byte = spot & 255
        alive, last, change = [], -1, 0
        for node, before, behind in self.parts[spot >> 8]:
            after = self.child.get(node << 8 | byte)
            if after is None:
                continue
            token = self.token[after]
            if last < 0 and token >= 0 and self.suits(before, token):
                last, change = token, behind + 1
            if self.inner[after]:
                alive.append((after, before, behind))
        state = (*((n, t, d - change) for n, t, d in alive), (0, last, 0))
        number = self.number(state)
        self.next[spot], self.emit[spot] = number + 1, change

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of the pieces data[start:end], in batches of neighbours."""
        upto = np.cumsum(end - start)
        out, i = np.empty(len(start), np.int64), 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + BATCH, "right")))
            out[i:j] = self._batch(data, start[i:j], end[i:j])
            i = j
        return out

    def _batch(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """All pieces side by side, the longest first."""
        if len(self.parts) >= MAX_STATES:
            self.keep(KEPT_STATES)
        order = np.argsort(start - end, kind="stable")
        begin, left = start[order], (end - start)[order]
        state, total = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int64)
        k, n = 0, int(np.searchsorted(-left, 0, "left"))  # n pieces have a byte k
        while n >= FEW:
            spot = (state[:n] << 8) + data[begin[:n] + k]
            state[:n] = self.next[spot]
            if not state[:n].all():
                for x in np.unique(spot[state[:n] == 0]).tolist():
                    self.make(x)
                state[:n] = self.next[spot]
            state[:n] -= 1
            total[:n] += self.emit[spot]
            k += 1
            n = int(np.searchsorted(-left, -k, "left"))
        reached = [self.parts[x] for x in state[:n]]
        for i in range(n):  # the few long ones, one by one
            at, tokens = self.number(reached[i]), 0
            for byte in data[begin[i] + k : begin[i] + left[i]].tolist():
                if len(self.parts) >= 2 * MAX_STATES - 1:
                    own = self.parts[at]
                    self.keep(KEPT_STATES)
                    at = self.number(own)
                spot = at << 8 | byte
                if not self.next[spot]:
                    self.make(spot)
                at, tokens = int(self.next[spot]) - 1, tokens + int(self.emit[spot])
            total[i] += tokens
        out = np.empty(len(begin), np.int64)
        out[order] = total
        return out

_machines: dict[str, Machine] = {}


def machine(merges: Merges) -> Machine:
    if merges.digest not in _machines:
        _machines.clear()
        _machines[merges.digest] = Machine(merges)
    return _machines[merges.digest]


def count_tokens(data: np.ndarray, offsets: np.ndarray, merges: Merges) -> np.ndarray:
    """Tokens of each text."""
    raw, n = data.tobytes(), len(offsets) - 1
    cuts, extra = offsets, np.zeros(n, np.int64)
    if merges.special:
        found = [(m.start(), m.end()) for m in re.finditer(b"|".join(re.escape(s.encode()) for s in sorted(merges.special, key=len, reverse=True)), raw)]
        if found:  # they split the text, and each counts as one token
            begin, end = np.array(found).T
            owner = np.searchsorted(offsets, begin, "right") - 1
            inside = end <= offsets[owner + 1]
            begin, end, owner = begin[inside], end[inside], owner[inside]
            np.add.at(extra, owner, 1)
            cuts = np.sort(np.concatenate([offsets, begin, end]))
            special = np.zeros(len(data) + 1, np.int64)
            np.add.at(special, begin, 1)
            np.add.at(special, end, -1)
            special = np.cumsum(special)[:-1] > 0
    if not len(data):
        return extra
    at = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
    classes = _classes()[np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    stops = np.unique(cuts[1:])
    stops = stops[stops > 0]
    marks = marks_of(np.insert(classes, np.searchsorted(at, stops), END))
    ends = np.searchsorted(at, stops) + np.arange(len(stops))  # of the END marks
    before = np.zeros(len(marks), bool)
    before[:-1] = (marks[1:] & _BEFORE) > 0
    starts = ((marks & _HERE) > 0) | before
    start = at[np.flatnonzero(np.delete(starts, ends))]
    if cuts is not offsets:
        start = start[~special[start]]
    end = np.minimum(np.append(start[1:], len(data)), stops[np.searchsorted(stops, start, "right")])
    tokens = machine(merges).count(data, start, end)
    total = np.zeros(len(start) + 1, np.int64)
    np.cumsum(tokens, out=total[1:])
    return np.diff(total[np.searchsorted(start, offsets)]) + extra


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))  # of the vocabulary's size

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.slices(batch):
                n = count_tokens(data, offsets, sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
