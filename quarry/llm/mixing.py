"""Mixing sources to target weights by Pfair scheduling.

A source is a task, a block of its documents a subtask.  With the source's
weight w (its share of all slots, kept as an exact fraction), its block i may
not be placed before slot floor(i / w) (release) and must be placed by slot
ceil((i + 1) / w) (deadline).  Earliest deadline first among the released blocks
places one block a slot and keeps every source within less than one block of its
weight's share of all slots so far, however long the schedule is, as long as no
source has run out; then its slots stay empty and the others keep their
proportions.

The whole schedule is made on the driver, from a count for each source, in whole
numbers.  Its length is bounded: a block is a fixed part of the corpus
(1 / ``MAX_BLOCKS``, and ``BLOCK_ROWS`` rows at least), so there are MAX_BLOCKS
blocks and one more for each source at most, at any size.  Weights are given by
source, so sources are few (``MAX_SOURCES``; more are refused).  The schedule is
written to the shared folder and joined with the blocks.  All rows are placed,
each once; the mix is their order.

A source's rows are numbered in an order that follows from a hash of doc_id
(ties: doc_id, then the text), over as many tasks as its size asks for; nothing
is gathered by source.

Cases: a null source is a source of its own, apart from ''; rows without doc_id
are dealt by their place in the input, a stored table; repeated rows are placed
each; very long texts are carried along unread; an empty table gives an empty
schedule; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import materialise, table
from .numbering import BUCKET_ROWS, buckets_for, number_within

BLOCK_ROWS = 32
MAX_BLOCKS = 1 << 20
MAX_SOURCES = 1_000_000
#: Blocks (some 80 bytes each) up to which their times are broadcast; beyond, a shuffled join.
MAX_BROADCAST_BLOCKS = 200_000
#: Default weights follow row counts to this power: large sources give way a little.
TEMPERATURE = 0.7


def whole_weights(weights: Mapping[str | None, float | Fraction]) -> dict[str | None, int]:
    """The same proportions in whole numbers, exactly."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*(f.denominator for f in exact.values())) if exact else 1
    return {s: int(f * unit) for s, f in exact.items()}


def earliest_deadline_first(weights: Mapping[str | None, float | Fraction], blocks: Mapping[str | None, int]) -> Iterator[tuple[str | None, int, int, int, int]]:
    """(source, block, slot, release, deadline) of all blocks, by slot.

    Ties of deadlines go to the source named first; slots that no released block
    can take are left out.
    """
    whole = whole_weights(weights)
    total = sum(whole.values())
    names = sorted(blocks, key=lambda s: (s is not None, s))
    waiting = [(0, k, 0) for k, s in enumerate(names) if blocks[s]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []  # deadline, source, block, release
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // whole[names[k]]), k, i, release))
        deadline, k, i, release = heapq.heappop(ready)
        yield names[k], i, slot, release, deadline
        if i + 1 < blocks[names[k]]:
            heapq.heappush(waiting, ((i + 1) * total // whole[names[k]], k, i + 1))
        slot += 1


def rows_of_block(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    return max(block_rows, -(-rows // MAX_BLOCKS))


def _hash() -> Column:
    """Of doc_id, or of the place in the input of a row without one."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id"))


def schedule(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with columns q_block, q_release, q_deadline, q_slot, q_before (rows of the mix before the block) and q_place (in the block)."""
    spark = docs.sparkSession
    light = docs.select("source", _hash().alias("q_hash"))
    rows_by = light.groupBy("source").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()  # a row for each source
    if len(rows_by) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; name groups of them")
    counted = {r["source"]: r["n"] for r in rows_by}
    if weights is None:
        weights = {s: n**TEMPERATURE for s, n in counted.items()}
    given = {s: weights.get(s, 0) for s in counted}
    if any(w <= 0 for w in given.values()):
        raise ValueError("every source needs a weight above 0")
    size = rows_of_block(sum(counted.values()), block_rows)
    # sources that are not in the table keep their share of the slots
    shares = given | {s: w for s, w in weights.items() if s not in given and w > 0}
    times, before = [], 0
    for s, i, slot, release, due in earliest_deadline_first(shares, {s: -(-n // size) for s, n in counted.items()}):
        times.append((s, i, slot, release, due, before))
        before += min(size, counted[s] - i * size)
    one = materialise(spark.createDataFrame(times, "q_source string, q_b long, q_slot long, q_release long, q_deadline long, q_before long"))  # MAX_BLOCKS rows and one a source at most
    one = F.broadcast(one) if len(times) <= MAX_BROADCAST_BLOCKS else one
    buckets = buckets_for(max(counted.values(), default=0))
    hashed = docs.withColumn("q_hash", _hash())
    tie = F.xxhash64("text") if "text" in docs.columns else F.col("text_hash") if "text_hash" in docs.columns else None
    order = [F.col("q_hash"), F.col("doc_id"), *([] if tie is None else [tie])]
    numbered = number_within(hashed, ["source"], order, F.pmod(F.col("q_hash"), F.lit(buckets)), "q_index", light, buckets * len(counted)).drop("q_hash")
    placed = numbered.withColumns({"q_block": F.expr(f"q_index div {size}L"), "q_place": F.pmod("q_index", F.lit(size))})
    timed = placed.join(one, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("q_block") == F.col("q_b")), "left")
    return timed.drop("q_index", "q_source", "q_b")


#: Place of a row of a schedule in the mix: 0, 1, ...
PLACE = "q_before + q_place"


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of docs with their columns only, in the order of the mix.

    Partitions hold about BUCKET_ROWS neighbouring rows of the schedule each, in
    order, so that the files written from them, read one after the other, are
    the mixed stream.
    """
    tie = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    packed = docs.select("doc_id", "source", tie.alias("text_hash"), F.struct(*docs.columns).alias("q_row"))  # so that no column's name can clash
    placed = schedule(packed, weights, block_rows).withColumn("q_at", F.expr(PLACE))
    parts = max(1, -(-docs.count() // BUCKET_ROWS))
    return placed.repartitionById(parts, F.expr(f"cast(q_at div {BUCKET_ROWS}L as int)")).sortWithinPartitions("q_at").select("q_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, place and the gapless position in the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return schedule(docs).select(
        "doc_id", "source", F.col("q_block").alias("block"), F.col("q_release").alias("release"), F.col("q_deadline").alias("deadline"),
        F.col("q_slot").alias("slot"), F.col("q_place").cast("long").alias("place"), F.expr(PLACE).cast("long").alias("position"),
    )
