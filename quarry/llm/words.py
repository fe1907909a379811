"""Words of many texts at once, as numpy arrays over the UTF-8 bytes.

A text column arrives as one Arrow buffer.  Every byte of a non-ASCII code
point is 0x80 or more, so both word patterns in use (anything but ASCII white
space; ASCII letters, digits and non-ASCII) are classes of bytes, and words are
the runs of one class.  A word's 64-bit hash is a difference of prefix sums,
so the cost is a few array operations a byte and nothing runs per word or
per document in the interpreter.  Sums are taken piece by piece (``PIECE``), so
that a very long text takes some bytes of memory a byte and not some tens.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about so many bytes (one text at least).
SLICE_BYTES = 1 << 21
#: Bytes of text after which a worker gives freed memory back.
GIVE_BACK_BYTES = 1 << 24
_since = 0
#: Bytes whose prefix sums are held at once.
PIECE = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = ~SPACE
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse, for the places of a piece."""
    if not _powers:
        for base in (_BASE, _INVERSE):
            table = np.full(PIECE + 1, base, _U)
            table[0] = 1
            with np.errstate(over="ignore"):
                _powers.append(np.multiply.accumulate(table))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


@dataclass
class Words:
    """Words of texts 0..n-1: byte ranges in ``data``, grouped by text."""

    data: np.ndarray  # the bytes, lower-cased if asked for
    offsets: np.ndarray  # of the texts in data, n + 1
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # of each word
    first: np.ndarray  # words of text i: first[i]..first[i + 1]
    hash: np.ndarray  # of each word, uint64

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, word: int) -> bytes:
        return self.data[self.start[word] : self.end[word]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls."""
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def find(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    """Words are runs of bytes b with inside[b]; a text's end ends a word."""
    if lower:
        data = LOWER[data]
    n = len(data)
    good = inside[data]
    breaks = np.zeros(n + 1, bool)  # a text begins here
    breaks[offsets] = True
    begin = np.zeros(n + 1, bool)
    finish = np.zeros(n + 1, bool)
    if n:
        begin[:n] = good
        begin[1:n] &= ~good[:-1] | breaks[1:n]
        finish[1:] = good
        finish[1:n] &= ~good[1:] | breaks[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish)
    del good, breaks, begin, finish
    h = hash_ranges(data, start, end)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, doc, first, h)


def _sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomials of the bytes of ranges, all within one piece."""
    up, down = _power_tables()
    prefix = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:])
    return (prefix[end] - prefix[start]) * down[start]


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range; ranges ascend and do not overlap."""
    out = np.empty(len(start), _U)
    with np.errstate(over="ignore"):
        i = 0
        while i < len(start):
            lo = start[i]
            j = int(np.searchsorted(end, lo + PIECE, "right"))  # ranges i..j-1 end within a piece
            if j > i:
                out[i:j] = _sums(data[lo : end[j - 1]], start[i:j] - lo, end[i:j] - lo)
                i = j
                continue
            total, power, step = _U(0), _U(1), _U(pow(_BASE, PIECE, 1 << 64))  # a range longer than a piece
            for at in range(int(lo), int(end[i]), PIECE):
                part = data[at : min(at + PIECE, int(end[i]))]
                total += power * _sums(part, np.array([0]), np.array([len(part)]))[0]
                power *= step
            out[i] = total
            i += 1
        return mix(out + (end - start).astype(_U))


def running(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, in the least type that holds it."""
    total = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, out=total[1:])
    return total


def per_text(offsets: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """How many flags (one a byte) are set in each text."""
    total = running(flags)
    return np.diff(total[offsets]).astype(np.int64)


def seen_before(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items (text, hash) in order: which equal an earlier one of their text, and which have an equal one at all."""
    with np.errstate(over="ignore"):
        key = mix(h + doc.astype(_U) * _U(0xA0761D6478BD642F))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, twice = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return later, twice


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbours; entry i is of words i..i+k-1."""
    out = np.zeros(max(0, len(h) - k + 1), _U)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix(out + h[j : j + len(out)] + _U(j + 1))
    return out


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every k neighbouring words of one text."""
    h = chain(w.hash, k)
    at = np.flatnonzero(w.doc[: len(h)] == w.doc[k - 1 :]) if len(h) else np.zeros(0, np.int64)
    return h[at], w.doc[at], at


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, (i, lo[i]), ..., (i, hi[i] - 1)."""
    n = hi - lo
    owner = np.repeat(np.arange(len(lo)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether the words a[i] and b[j] have the same bytes."""
    n = a.end[i] - a.start[i]
    same = n == b.end[j] - b.start[j]
    at = np.flatnonzero(same)
    owner, place = ranges(np.zeros(len(at), np.int64), n[at])
    differ = a.data[a.start[i[at]][owner] + place] != b.data[b.start[j[at]][owner] + place]
    same[at[owner[differ]]] = False
    return same


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C library keep it for later, which adds up over idle workers."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batch with about SLICE_BYTES of text each, null as empty."""
    global _since
    text = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    if len(text) == 0:
        return
    data, offsets = text_bytes(text)
    at = 0
    while at < len(text):
        upto = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        upto = min(max(upto, at + 1), len(text))
        yield batch.slice(at, upto - at), data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto
    _since += len(data)
    if _since > GIVE_BACK_BYTES:
        del text, data, offsets
        give_back()
        _since = 0
