"""N-gram Jaccard join by T-occurrence search (DivideSkip), for components of near copies.

A document is the set of its 5-word shingles; two documents link when
100 * |intersection| >= 75 * |union|.  Documents with equal sets form a class
and are one node from here on.

1. ``sets`` - one pass over the texts gives every document its class and number
   of shingles, and every task a count sketch of its shingles' frequencies
   (fixed size).
2. ``inverted lists`` - a second pass orders each set by frequency, rarest
   first.  Linked sets of n shingles share T = ceil(0.75 n) at least, so they
   meet in ``l`` or more of the n - T + l rarest of either (l grows with n): only
   these go to inverted lists.  The lists of a bucket of shingles are merged in
   one task; a shingle that the sketch says is frequent is dealt over several.
3. ``candidates`` - pairs that meet in l short lists, counted over all lists; a
   long list names a leader for its members instead of pairs, so that a large
   group of near copies never becomes all pairs.  A pair whose first meeting is
   in a long list is found there; of two sets that are in long lists one meeting
   in a short list is enough.
4. ``T-occurrence search`` - each set is a query to the block of its candidates:
   of the lists of its shingles the short ones are heap-merged, the long ones
   (DivideSkip) binary-probed for the sets left, and those that reach the
   required overlap are links.  At first each candidate goes to one query only,
   which settles nearly all components.
5. ``the rest`` - pairs of candidates whose components still differ, and for
   every long list that holds several components the members outside its largest
   one against all members in other components, are searched the same way, so
   that no link between different components is lost.

Nothing that grows with the corpus reaches the driver or is broadcast: the
sketch has 2**SKETCH_BITS bytes and the filter that selects the sets wanted has
8 bits a set, from 2**FILTER_BITS to 2**MAX_FILTER_BITS (16 MB; full, it would
only let more sets pass).

Cases: null texts and texts without words have empty sets, n_shingles 0, and
are components of their own; rows without doc_id are linked like any, and the
component's id is the least doc_id that it has (null if none); with 1 to 4 words
the whole sequence is the one shingle.  Very long texts are sets like any.
Repeated rows get equal results, an empty table an empty one.  Other columns are
not read.
Shingles are 64-bit hashes and a class is a 128-bit digest of its set: its first
half names the class, and if sets with equal first halves differ in the second,
all digests are taken anew with other salts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .cluster import materialise, ship, table
from .graph import components

SHINGLE = 5
NUM, DEN = 75, 100  # similarity of 0.75 as whole numbers
SKETCH_BITS = 23
SLICE_BITS = 17
FILTER_BITS, MAX_FILTER_BITS = 24, 27
SHORT_LIST = 16  # members up to which a list gives pairs
PER_MEETING = 32  # shingles for each further meeting that is required
BUCKET_POSTINGS = 1 << 20  # entries of lists that one bucket holds, about (23 bytes each)
LIST_TARGET = 4096  # members of a frequent shingle's list that one task takes
CHUNK = 256  # members that a leader is compared with at once
_U = np.uint64


def shingles(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each text, and where each text's begin."""
    h, doc, _ = W.windows(w, SHINGLE)
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    at = np.searchsorted(doc, np.arange(w.n + 1))
    out, size = [], np.zeros(w.n + 1, np.int64)
    few = {}
    for i in short:
        few[i] = W.chain(w.hash[w.first[i] : w.first[i + 1]], int(counts[i])) ^ _U(counts[i])
    for i in range(w.n):
        own = few[i] if i in few else np.unique(h[at[i] : at[i + 1]])
        out.append(own)
        size[i + 1] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, _U)), np.cumsum(size)


def classes(h: np.ndarray, at: np.ndarray, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set, others in each turn."""
    out = []
    with np.errstate(over="ignore"):
        n = np.diff(at).astype(_U)
        for salt in (0x632BE59BD9B4E019, 0x9AE16A3B2F90404F):
            total = np.zeros(len(h) + 1, _U)
            np.cumsum(W.mix(h ^ (_U(salt) + _U(turn) * _U(0xD1B54A32D192ED03))), out=total[1:])
            out.append(W.mix(total[at[1:]] - total[at[:-1]] + n).view(np.int64))
    return out[0], out[1]


def required(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of linked sets of n and m shingles."""
    return -(-NUM * (n + m) // (NUM + DEN))


def compatible(n, m):
    """Whether sets of n and m shingles can link."""
    return (DEN * n >= NUM * m) & (DEN * m >= NUM * n)


def admitted(n, m, i, j, meeting: int | np.ndarray = 1):
    """Whether linked sets of n and m could have the shingle at places i and j of their orders as this meeting, or an earlier one."""
    spare = meeting - required(n, m)
    return compatible(n, m) & (i < n + spare) & (j < m + spare)


# --- 1: sets and sketch


def _sets(batches: Iterator[pa.RecordBatch], turn: int = 0) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "cls", "chk", "slice", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    mask = _U((1 << SKETCH_BITS) - 1)
    for batch in batches:
        for part, data, offsets in W.slices(batch):
            h, at = shingles(W.find(data, offsets, W.NOT_SPACE, True))
            cls, chk = classes(h, at, turn)
            np.add.at(sketch, h & mask, np.uint32(1))
            k = part.num_rows
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(cls), pa.array(chk), pa.nulls(k, types[4]), pa.nulls(k, types[5])], names)
    if sketch.any():
        rows = []
        for s, own in enumerate(sketch.reshape(-1, 1 << SLICE_BITS)):
            rows.append((s, pack_counts(own)))
        nothing = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.array([r[0] for r in rows], types[4]), pa.array([r[1] for r in rows], types[5])], names)


def pack_counts(own: np.ndarray) -> bytes:
    """Counts of a slice: a byte each for all or for those above 0, and in full those that no byte holds."""
    at, large = np.flatnonzero(own), np.flatnonzero(own >= 255).astype(np.uint32)
    small = np.minimum(own, 254).astype(np.uint8)
    rest = np.array([len(large)], np.uint32).tobytes() + large.tobytes() + (own[large] - 254).astype(np.uint32).tobytes()
    if 5 * len(at) < len(own):
        return b"s" + rest + at.astype(np.uint32).tobytes() + small[at].tobytes()
    return b"d" + rest + small.tobytes()


def add_counts(total: np.ndarray, packed: bytes) -> None:
    n = int(np.frombuffer(packed, np.uint32, 1, 1)[0])
    total[np.frombuffer(packed, np.uint32, n, 5)] += np.frombuffer(packed, np.uint32, n, 5 + 4 * n)
    at = 5 + 8 * n
    if packed[:1] == b"d":
        total += np.frombuffer(packed, np.uint8, offset=at)
    else:
        n = (len(packed) - at) // 5
        total[np.frombuffer(packed, np.uint32, n, at)] += np.frombuffer(packed, np.uint8, n, at + 4 * n)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of slices as levels: 8 * log2(1 + count), one byte each."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            add_counts(sums.setdefault(s, np.zeros(1 << SLICE_BITS, np.uint64)), packed.as_py())
    if sums:
        level = [np.minimum(255, 8 * np.log2(1.0 + x)).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(level, pa.binary())], ["slice", "level"])


# --- 2: inverted lists


def listed(n: int) -> int:
    """How many shingles of a set of n go to inverted lists."""
    return min(n, n - -(-NUM * n // DEN) + 1 + n // PER_MEETING)


def _prefix(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The n - T + l rarest shingles of an ascending set, in one order for all sets."""
    n = len(h)
    keep = listed(n)
    key = (level[h & _U(len(level) - 1)].astype(_U) << _U(56)) | (h >> _U(8))
    return h[np.argsort(key, kind="stable")[:keep]]


def _postings(level_of, buckets: int, turn: int = 0, list_target: int = LIST_TARGET):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = level_of.value
        mask = _U(len(level) - 1)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, cls, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            # members of frequent shingles are dealt over so many tasks that each has about LIST_TARGET of them
            deals = np.maximum(1, np.ceil(np.exp2(level[h & mask] / 8.0) / list_target)).astype(_U)
            salt = W.mix(cls.view(_U)) % deals
            bucket = (W.mix(h + salt * _U(0x9E3779B97F4A7C15)) % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, h, cls, n, pos, deals = bucket[order], h[order], cls[order], n[order], pos[order], deals[order]
            cut = np.flatnonzero(np.diff(bucket)) + 1
            lo, hi = np.concatenate([[0], cut]), np.append(cut, len(bucket))
            blob = [h[a:b].tobytes() + cls[a:b].tobytes() + n[a:b].tobytes() + pos[a:b].tobytes() + (deals[a:b] > 1).astype(np.uint8).tobytes() for a, b in zip(lo, hi, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(bucket[lo]), pa.array(blob, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for _, data, offsets in W.slices(batch):
                h, at = shingles(W.find(data, offsets, W.NOT_SPACE, True))
                cls, _chk = classes(h, at, turn)
                for i in np.flatnonzero(np.diff(at)):
                    if cls[i] not in seen:
                        seen.add(cls[i])
                        own = _prefix(h[at[i] : at[i + 1]], level)
                        held.append((own, np.full(len(own), cls[i]), np.full(len(own), at[i + 1] - at[i], np.int32), np.minimum(np.arange(len(own)), 65535).astype(np.uint16)))
                        size += len(own)
                if size > 2_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


_LISTS = {"list": pa.int64(), "dealt": pa.bool_(), "lead": pa.int64(), "members": pa.binary(), "sizes": pa.binary(), "places": pa.binary(), "a": pa.int64(), "b": pa.int64(), "least_n": pa.int64(), "meetings": pa.int64()}
_LISTS_SQL = "list long, dealt boolean, lead long, members binary, sizes binary, places binary, a long, b long, least_n long, meetings long"


def _unpack(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    sizes = [len(x) // 23 for x in parts]
    both = list(zip(parts, sizes, strict=True))
    h = np.concatenate([np.frombuffer(x, _U, k) for x, k in both])
    cls = np.concatenate([np.frombuffer(x, np.int64, k, 8 * k) for x, k in both])
    n = np.concatenate([np.frombuffer(x[16 * k : 20 * k], np.int32) for x, k in both])
    pos = np.concatenate([np.frombuffer(x[20 * k : 22 * k], np.uint16) for x, k in both])
    return h, cls, n, pos, np.concatenate([np.frombuffer(x, np.uint8, k, 22 * k) for x, k in both])


def _lists(batches: Iterator[pa.RecordBatch], short_list: int = SHORT_LIST) -> Iterator[pa.RecordBatch]:
    """Long lists (equal ones of a task once) with their first leader, pairs (a, b) of short lists with the number of lists, and how many shingles of a are in lists with others."""
    by_bucket: dict[int, list[bytes]] = {}
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            by_bucket.setdefault(b, []).append(blob.as_py())
    done: set[int] = set()
    for b in sorted(by_bucket):
        h, cls, n, pos, dealt = _unpack(by_bucket.pop(b))
        order = np.argsort(h, kind="stable")
        twice = np.zeros(len(h), bool)
        same = h[order][1:] == h[order][:-1]
        twice[1:] = same
        twice[:-1] |= same
        order = order[twice | (dealt[order] > 0)]  # a dealt list's other members may be in another task
        order = order[np.lexsort((cls[order], h[order]))]
        h, cls, n, pos, dealt = h[order], cls[order], n[order].astype(np.int64), pos[order].astype(np.int64), dealt[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
        h, cls, n, pos, dealt = h[first], cls[first], n[first], pos[first], dealt[first]
        if not len(h):
            continue
        cut = np.flatnonzero(h[1:] != h[:-1]) + 1
        lo, hi = np.concatenate([[0], cut]), np.append(cut, len(h))
        whole = dealt[lo] == 0
        met, times = np.unique(cls[np.repeat(~whole | (hi - lo > 1), hi - lo)], return_counts=True)
        if len(met):
            yield _list_batch(a=met, meetings=times)
        yield from _short_pairs(cls, n, pos, *(x[whole & (hi - lo > 1) & (hi - lo <= short_list)] for x in (lo, hi)))
        long = ~whole | (hi - lo > short_list)
        with np.errstate(over="ignore"):
            total = np.zeros(len(h) + 1, _U)
            np.cumsum(W.mix(W.mix(cls.view(_U) + _U(77)) + pos.astype(_U)), out=total[1:])
            signature = W.mix(total[hi] - total[lo] + (hi - lo).astype(_U)).view(np.int64)
        shingle = W.mix(h[lo] ^ _U(5)).view(np.int64)  # the members of a dealt list meet again under it
        for x, y, w, sig, own in zip(lo[long], hi[long], whole[long], signature[long], shingle[long], strict=True):
            if not w or sig not in done:
                done.add(sig)
                lead = cls[x + np.lexsort((cls[x:y], pos[x:y]))[0]]
                yield _list_batch(list=[int(sig if w else own)], dealt=[not w], lead=[int(lead)], members=[cls[x:y].tobytes()], sizes=[n[x:y].astype(np.int32).tobytes()], places=[pos[x:y].astype(np.uint16).tobytes()])


def _short_pairs(cls: np.ndarray, n: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs that can link, of the lists lo..hi, each with the number of lists."""
    left, right = [], []
    for size in np.unique(hi - lo):
        at = lo[hi - lo == size]
        i, j = np.triu_indices(int(size), 1)
        left.append((at[:, None] + i).ravel())
        right.append((at[:, None] + j).ravel())
    if not left:
        return
    left, right = np.concatenate(left), np.concatenate(right)
    able = admitted(n[left], n[right], pos[left], pos[right], 1 + np.minimum(n[left], n[right]) // PER_MEETING)
    left, right = left[able], right[able]
    if not len(left):
        return
    order = np.lexsort((cls[right], cls[left]))
    left, right = left[order], right[order]
    new = np.ones(len(left), bool)
    new[1:] = (cls[left][1:] != cls[left][:-1]) | (cls[right][1:] != cls[right][:-1])
    at = np.flatnonzero(new)
    left, right = left[at], right[at]
    yield _list_batch(a=cls[left], b=cls[right], least_n=np.minimum(n[left], n[right]), meetings=np.diff(np.append(at, len(order))))


def _list_batch(**given) -> pa.RecordBatch:
    rows = len(next(iter(given.values())))
    return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(rows, t) for k, t in _LISTS.items()], list(_LISTS))


def stars(members: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Leaders with the members that can link to them.

    The member whose order has the fewest rarer shingles leads first: among near
    copies it is the one with the fewest words of its own.
    """
    left = np.ones(len(members), bool)
    for k in np.lexsort((members, places)):
        if left[k]:
            left[k] = False
            led = left & admitted(sizes, sizes[k], places, places[k])
            if led.any():
                yield int(k), np.flatnonzero(led)
            left &= ~led


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        a, b = [], []
        for packed in zip(*batch.columns, strict=True):
            m, n, i = (np.frombuffer(x.as_py(), t).astype(np.int64) for x, t in zip(packed, (np.int64, np.int32, np.uint16), strict=True))
            for k, led in stars(m, n, i):
                lead = int(m[k])
                for x in m[led].tolist():
                    if (lead, x) not in seen:
                        seen.add((lead, x))
                        a.append(lead)
                        b.append(x)
            if len(seen) > 500_000:
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lid, *packed in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
            m, n, i = (np.frombuffer(x.as_py(), t).astype(np.int64) for x, t in zip(packed, (np.int64, np.int32, np.uint16), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), lid, np.int64)), pa.array(m), pa.array(n), pa.array(i)], ["list", "cls", "n", "place"])


# --- 3: T-occurrence search


def divide_skip(query: np.ndarray, block: list[np.ndarray], mu: float = 0.0085) -> np.ndarray:
    """Which sets of the block (ascending, distinct) link to the query set.

    T-occurrence: the inverted lists of the query's shingles over the block hold
    block numbers in ascending order.  With the L longest lists set aside, a
    member must occur T - L times at least in the others, which a heap merges;
    those that do are looked up in the long lists by binary search.
    """
    sizes = np.array([len(x) for x in block], np.int64)
    need = required(len(query), sizes)
    able = compatible(len(query), sizes)
    if not able.any() or not len(query):
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(block)), sizes)
    flat = np.concatenate(block)
    at = np.searchsorted(query, flat)
    found = (at < len(query)) & (query[np.minimum(at, len(query) - 1)] == flat) & able[owner]
    at, owner = at[found], owner[found]
    order = np.argsort(at, kind="stable")  # owners stay ascending in each list
    at, owner = at[order], owner[order]
    cut = np.searchsorted(at, np.arange(len(query) + 1))
    lists = [owner[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]
    lists.sort(key=len)
    least = int(need[able].min())
    longest = len(lists[-1]) if lists else 0
    n_long = min(least - 1, len(lists), max(0, int(least / (mu * np.log2(longest + 1) + 1)))) if longest else 0
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    count = np.zeros(len(block), np.int64)
    for k, same in groupby(heapq.merge(*(x.tolist() for x in short))):
        count[k] = sum(1 for _ in same)
    live = np.flatnonzero((count > 0) & (count >= need - n_long))
    for done, own in enumerate(long, 1):
        if not len(live):
            break
        spot = np.searchsorted(own, live)
        count[live] += (spot < len(own)) & (own[np.minimum(spot, len(own) - 1)] == live)
        live = live[count[live] + (n_long - done) >= need[live]]
    return live[count[live] >= need[live]]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lead, chunk, member or null for the leader's own set, set), the leader's first in its group."""
    key, query, block, names = None, None, [], []
    a: list[int] = []
    b: list[int] = []

    def close() -> None:
        if key is not None and block and query is not None:
            for k in divide_skip(query, block):
                a.append(key[0])
                b.append(names[k])

    for batch in batches:
        for lead, chunk, member, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if (lead, chunk) != key:
                close()
                key, query, block, names = (lead, chunk), None, [], []
            own = np.frombuffer(packed, _U)
            if member is None:
                query = own
            else:
                block.append(own)
                names.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a.clear()
        b.clear()
    close()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _spot(ids: pa.Array, bits: int) -> np.ndarray:
    return (W.mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(_U)) & _U((1 << bits) - 1)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A bit for every id, in slices."""
    own_bits = np.zeros(1 << bits, np.uint8)
    for batch in batches:
        own_bits[_spot(batch.column(0), bits)] = 1
    for s, own in enumerate(np.packbits(own_bits).reshape(-1, 1 << SLICE_BITS)):
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([own.tobytes()])], ["slice", "bits"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out.setdefault(s, np.zeros(1 << SLICE_BITS, np.uint8))
            out[s] |= np.frombuffer(own.as_py(), np.uint8)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tobytes() for x in out.values()])], ["slice", "bits"])


def _packed_sets(wanted, bits: int, turn: int = 0):
    """(doc_id, class, set) of the documents that the filter lets pass; one without doc_id by its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = wanted.value

        def passes(ids: pa.Array) -> np.ndarray:
            at = _spot(ids, bits)
            return (marks[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)

        for batch in batches:
            batch = batch.filter(pa.array(passes(batch.column(0).fill_null(0)) | batch.column(0).is_null().to_numpy(zero_copy_only=False)))
            for part, data, offsets in W.slices(batch):
                h, at = shingles(W.find(data, offsets, W.NOT_SPACE, True))
                cls, _ = classes(h, at, turn)
                packed = pa.array([h[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(cls), packed], ["doc_id", "cls", "set"])
                unnamed = part.column(0).is_null().to_numpy(zero_copy_only=False)
                yield out.filter(pa.array(~unnamed | passes(pa.array(cls)))) if unnamed.any() else out

    return run


def passing(texts: DataFrame, ids: DataFrame, turn: int = 0) -> tuple[DataFrame, Broadcast]:
    """The filter, and (doc_id, cls, set) of texts whose doc_id (or class, without one) is among ids(id), and perhaps of a few others."""
    spark = texts.sparkSession
    bits = min(MAX_FILTER_BITS, max(FILTER_BITS, (8 * ids.count()).bit_length()))
    slices = 1 << (bits - 3 - SLICE_BITS)
    found = ids.mapInArrow(partial(_marked, bits=bits), "slice int, bits binary").repartition(slices, "slice").mapInArrow(_either, "slice int, bits binary").collect()
    marks = np.zeros((slices, 1 << SLICE_BITS), np.uint8)  # 2**MAX_FILTER_BITS bits at most
    for s, own in found:
        marks[s] = np.frombuffer(own, np.uint8)
    sent = spark.sparkContext.broadcast(marks.reshape(-1))
    return texts.mapInArrow(_packed_sets(sent, bits, turn), "doc_id long, cls long, set binary"), sent


def verify(pairs: DataFrame, texts: DataFrame, stand: DataFrame, turn: int = 0, unnamed: bool = False) -> DataFrame:
    """Those of the pairs (a, b) that link; stand (k, doc) names the document whose text gives a class's set, null for any without doc_id."""
    led = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(led.withColumnRenamed("a", "lead"), F.col("a") == F.col("lead"))
    members = dealt.select(F.col("b").alias("want"), "a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.col("b").alias("member"))
    heads = led.select(F.col("a").alias("want"), "a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("member"))
    wants = materialise(members.unionByName(heads).join(stand, F.col("want") == F.col("k")).select("want", "doc", "a", "chunk", "member"))
    sets, sent = passing(texts, wants.select(F.coalesce("doc", "want").alias("id")).distinct(), turn)
    both = wants.join(sets.where("doc_id is not null"), (F.col("doc") == F.col("doc_id")) & (F.col("want") == F.col("cls"))).select("a", "chunk", "member", "set")
    if unnamed:  # classes that only rows without doc_id have
        own = sets.where("doc_id is null").dropDuplicates(["cls"])
        both = both.unionByName(wants.where("doc is null").join(own, F.col("want") == F.col("cls")).select("a", "chunk", "member", "set"))
    found = materialise(both.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("member").asc_nulls_first()).mapInArrow(_search, "a long, b long"))
    sent.destroy()
    return found


def clash(rows: DataFrame) -> bool:
    """Whether different sets of rows (n, cls, chk) have the same cls."""
    g = rows.groupBy("cls").agg(F.min("chk").alias("lo"), F.max("chk").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    return not g.where("lo <> hi or least <> most").isEmpty()


def join(docs: DataFrame, short_list: int = SHORT_LIST, list_target: int = LIST_TARGET) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    turn = 0
    while True:
        first = materialise(texts.mapInArrow(partial(_sets, turn=turn), "doc_id long, n long, cls long, chk long, slice int, counts binary"))
        rows = first.where("slice is null").select("doc_id", "n", "cls")
        if not clash(first.where("slice is null")):
            break
        turn += 1
    slices = 1 << (SKETCH_BITS - SLICE_BITS)
    merged = first.where("slice is not null").select("slice", "counts").repartition(slices, "slice").mapInArrow(_merge, "slice int, level binary").collect()  # 2**SKETCH_BITS bytes
    level = np.zeros((slices, 1 << SLICE_BITS), np.uint8)
    for s, own in merged:
        level[s] = np.frombuffer(own, np.uint8)
    level_of = spark.sparkContext.broadcast(level.reshape(-1))
    postings = rows.select(F.sum(F.expr(f"least(n, n - ceil({NUM} * n / {DEN}) + 1 + n div {PER_MEETING}L)"))).first()[0] or 0
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-postings // BUCKET_POSTINGS))
    posted = texts.mapInArrow(_postings(level_of, buckets, turn, list_target), "bucket int, blob binary").repartition(buckets, "bucket")
    merged_lists = materialise(posted.mapInArrow(partial(_lists, short_list=short_list), _LISTS_SQL))
    level_of.destroy()
    lists = merged_lists.where("list is not null").select("list", "dealt", "lead", "members", "sizes", "places")
    plain = lists.where("not dealt").dropDuplicates(["list"])
    members = materialise(plain.unionByName(lists.where("dealt")).select("list", "members", "sizes", "places").mapInArrow(_members, "list long, cls long, n long, place long"))
    met = merged_lists.where("b is not null").groupBy("a", "b").agg(F.sum("meetings").alias("meetings"), F.first("least_n").alias("least_n"))
    in_long = lambda k: members.select(F.col("cls").alias(f"h{k}")).distinct()
    both_long = met.join(in_long("a"), F.col("a") == F.col("ha"), "left").join(in_long("b"), F.col("b") == F.col("hb"), "left")
    enough = (F.col("meetings") > F.floor(F.col("least_n") / PER_MEETING)) | (F.col("ha").isNotNull() & F.col("hb").isNotNull())
    close = materialise(both_long.where(enough).select("a", "b"))
    starred = lists.select("members", "sizes", "places").mapInArrow(_stars, "a long, b long")
    # leaders of the parts of one dealt list meet as a list of their own
    parts = lists.where("dealt").select("list", F.col("lead").alias("own"))
    heads = parts.groupBy("list").agg(F.min("own").alias("lead"), F.count("*").alias("parts")).where("parts > 1")
    starred = starred.unionByName(parts.join(heads, "list").where("own <> lead").select(F.col("lead").alias("a"), F.col("own").alias("b")))
    pairs = materialise(starred.unionByName(close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct())
    # a class's least document stands for it
    stand = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc")).withColumnRenamed("cls", "k")
    unnamed = not rows.where("doc_id is null and n > 0").isEmpty()
    links = verify(pairs, texts, stand, turn, unnamed)
    comp = materialise(components(links))
    # shingles that no other class has cannot be shared: what is left bounds any overlap
    alone = f"(least(n, n - ceil({NUM} * n / {DEN}) + 1 + n div {PER_MEETING}L) - met)"
    shared = merged_lists.where("a is not null and b is null").join(members.select(F.col("cls").alias("a")).distinct(), "a", "left_semi").groupBy("a").agg(F.sum("meetings").alias("met"))
    in_comp = comp.select(F.col("node").alias("cls"), "comp")
    most = members.select("cls", "n").distinct().join(shared.withColumnRenamed("a", "cls"), "cls").select("cls", F.expr(f"n - {alone}").alias("most"))
    placed = members.join(in_comp, "cls", "left").join(most, "cls").select("list", "cls", "n", "place", "most", F.coalesce("comp", "cls").alias("comp"))
    share = placed.groupBy("list", "comp").count()
    mixed = share.groupBy("list").agg(F.count("*").alias("comps"), F.max(F.struct("count", "comp")).alias("top")).where("comps > 1").select("list", F.col("top.comp").alias("main"))
    apart = materialise(placed.join(mixed, "list"))
    query = apart.where("comp <> main").select("list", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("place").alias("ia"), F.col("most").alias("ma"), F.col("comp").alias("ca"))
    other = apart.select(F.col("list").alias("l2"), F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("place").alias("ib"), F.col("most").alias("mb"), F.col("comp").alias("cb"))
    need = f"ceil({NUM} * (na + nb) / {NUM + DEN})"
    spare = f"1 - {need}"
    able = F.expr(f"{DEN} * na >= {NUM} * nb and {DEN} * nb >= {NUM} * na and ia < na + {spare} and ib < nb + {spare} and least(ma, mb) >= {need}")
    far = query.join(other, (F.col("list") == F.col("l2")) & (F.col("ca") != F.col("cb")) & able).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    of = lambda k: in_comp.select(F.col("cls").alias(f"k{k}"), F.col("comp").alias(f"c{k}"))
    still = close.join(of("a"), F.col("a") == F.col("ka"), "left").join(of("b"), F.col("b") == F.col("kb"), "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    rest = far.union(still).distinct()
    tried = materialise(rest.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    more = verify(tried, texts, stand, turn, unnamed)
    if more.isEmpty():
        final = comp
    else:
        root = comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        final = materialise(components(root.unionByName(more.select("a", "b"))))
    least = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    by_class = least.join(final.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", F.coalesce("comp", "cls").alias("comp"))
    smallest = by_class.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = by_class.join(smallest, "comp").select("cls", "component_id")
    out = rows.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) AS i FROM d WHERE len(w) > 0)
), s AS (
  SELECT DISTINCT doc_id, s FROM g
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DEN} * c >= {NUM} * (x.n + y.n - c)
), reach AS (
  SELECT doc_id, doc_id AS low FROM d UNION SELECT link.b, reach.low FROM reach JOIN link ON link.a = reach.doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(low) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""
