"""Sharding by a k-d tree over text metadata (DataFrame operations only).

A node of the tree is split at the weighted median (weight: bytes) of its
rows along its widest dimension, relative to the width of that dimension over
the table, until there is a leaf for every shard; how many shards there are is
given, or follows from the bytes that a leaf is to reach.  Law: ``bytes``,
shards are near equal in bytes.

Dimensions are whole numbers that follow from the text alone (bytes, lines,
bytes per 1,000 characters), so copies of a text are one point.  Rows are
ordered by (dimension, hash of the text, hash of doc_id, number of the row); a
median that falls into one value of the dimension is looked for in the text
hashes, and only a group of copies too heavy to stay whole (``GROUP_SLACK`` of a
shard) is cut by doc_id, and equal rows by their number.  So every cut is exact
to ``SLACK`` of a shard or to one row, and all groups but those at the cuts are
whole.

Medians are found without sorting: for all nodes of a level at once, histograms
of ``BINS`` bins over the key range, narrowed to the bin that holds the median.
Histograms stay distributed; the driver sees a row a node and round, and rows
are moved down a level by a join with the table of cuts (a row a node, so of the
number of shards at most).  The rows with their metadata are written once to the
shared folder, and with their node after each level; texts are read once.

Cases: a null text counts as empty (size 1, crc 0); rows without doc_id are told
apart by their number, equal rows too; very long texts are one row as any other;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from . import mixing
from .cluster import materialise, table
from .numbering import BUCKET_ROWS, buckets_for, number_within

BINS = 1024
SLACK = 0.002
GROUP_SLACK = 0.02
DIMS = ("k_bytes", "k_lines", "k_script")
#: What orders the rows after the dimension.
TIES = ("text_hash", "row_hash", "row_no")


@dataclass
class _Hunt:
    """The search for one node's median: the cut is found part by part of the key (dimension, text hash, row hash, row number)."""

    node: int  # first shard of the node
    dim: int
    target: float  # weight wanted on the left
    leaf: float  # weight of a shard
    lo: int
    hi: int
    fixed: tuple[int, ...] = ()  # parts of the key already found
    before: float = 0.0  # weight left of lo

    @property
    def width(self) -> int:
        return max(1, -(-(self.hi - self.lo + 1) // BINS))

    def row(self) -> tuple[int, ...]:
        fixed = (*self.fixed, 0, 0, 0)[:3]
        return self.node, self.dim, len(self.fixed), *fixed, self.lo, self.hi, self.width, float(self.target - self.before)

    def narrow(self, hit: tuple[int, float, float]) -> tuple[int, ...] | None:
        """The key of the first row on the right, or None with a smaller range to look at; hit is (bin, weight up to its end, its own)."""
        b, cum, own = hit
        part, single = len(self.fixed), self.width == 1
        last, cum = self.before + cum - own, self.before + cum
        edge = self.lo + b * self.width
        short, over = self.target - last, cum - self.target
        slack = self.leaf * (GROUP_SLACK if part == 1 and single else SLACK)
        if min(short, over) <= slack or (single and part == 3):
            at = edge if short <= over else edge + self.width
            return (*self.fixed, at, *(0,) * (3 - part))
        if single:
            self.fixed, self.lo, self.hi, self.before = (*self.fixed, edge), 0, (1 << 62) - 1, last
        else:
            self.lo, self.hi, self.before = edge, min(self.hi, edge + self.width - 1), last
        return None


def metadata(docs: DataFrame, *others: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chars = F.char_length(text).cast("long")
    octets = F.octet_length(text).cast("long")
    number = F.monotonically_increasing_id()
    row = F.when(F.col("doc_id").isNull(), F.xxhash64(number)).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (octets + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        octets.alias("k_bytes"),
        (chars - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("k_lines"),
        F.when(chars > 0, F.expr("octet_length(coalesce(cast(text as string), '')) * 1000L div char_length(coalesce(cast(text as string), ''))")).otherwise(0).cast("long").alias("k_script"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("text_hash"),
        F.shiftrightunsigned(row, 2).alias("row_hash"),
        number.alias("row_no"),
        *others,
    )


_HUNTS = "node bigint, dim int, part int, f0 bigint, f1 bigint, f2 bigint, lo bigint, hi bigint, width bigint, want double"
_CUTS = "node bigint, dim int, c0 bigint, c1 bigint, c2 bigint, c3 bigint, half bigint"
_DIM = f"element_at(array({', '.join(DIMS)}), dim + 1)"


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of whole numbers and doubles, from one text."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def _found(placed: DataFrame, hunts: list[_Hunt]) -> dict[int, tuple[int, float, float]]:
    """For each hunt the bin where its weight is reached (else its last one), the weight up to its end and its own."""
    spark = placed.sparkSession
    sought = F.broadcast(_small(spark, [h.row() for h in hunts], _HUNTS))  # a row a node
    key = F.expr(f"case part when 0 then {_DIM} when 1 then {TIES[0]} when 2 then {TIES[1]} else {TIES[2]} end")
    inside = F.expr(f"(part < 1 or {_DIM} = f0) and (part < 2 or {TIES[0]} = f1) and (part < 3 or {TIES[1]} = f2)")
    near = placed.join(sought, "node").where(inside).withColumn("key", key).where("key between lo and hi")
    binned = near.select("node", "want", F.expr("(key - lo) div width").alias("bin"), "size").groupBy("node", "want", "bin").agg(F.sum("size").cast("double").alias("own"))
    upto = binned.withColumn("cum", F.sum("own").over(Win.partitionBy("node").orderBy("bin")))  # BINS rows a node
    spot = F.struct("bin", "cum", "own")
    best = upto.groupBy("node").agg(F.coalesce(F.min(F.when(F.col("cum") >= F.col("want"), spot)), F.max(spot)).alias("hit"))
    return {r["node"]: (r["hit"]["bin"], r["hit"]["cum"], r["hit"]["own"]) for r in best.collect()}


def grow(rows: DataFrame, shards: int) -> DataFrame:
    """rows with column shard; rows is a stored table."""
    spark = rows.sparkSession
    bounds = [f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]
    whole = rows.agg(F.sum("size").alias("weight"), *bounds).first()
    placed = rows.withColumn("node", F.lit(0).cast("long"))
    if whole["weight"] is None:
        return placed.withColumnRenamed("node", "shard")
    spread = {d: max(1, whole[f"hi_{d}"] - whole[f"lo_{d}"]) for d in DIMS}
    leaf = whole["weight"] / shards
    level = {0: shards}  # first shard of each node: its number of shards
    while open_nodes := {start: n for start, n in level.items() if n > 1}:
        ids = _small(spark, [(start,) for start in open_nodes], "node bigint")
        stats = placed.join(F.broadcast(ids), "node", "left_semi").groupBy("node").agg(F.sum("size").alias("weight"), *bounds)
        hunts = []
        for s in stats.collect():  # a row a node
            dim = max(range(len(DIMS)), key=lambda k: (s[f"hi_{DIMS[k]}"] - s[f"lo_{DIMS[k]}"]) / spread[DIMS[k]])
            n = open_nodes[s["node"]]
            hunts.append(_Hunt(s["node"], dim, s["weight"] * (n // 2) / n, leaf, s[f"lo_{DIMS[dim]}"], s[f"hi_{DIMS[dim]}"]))
        cuts = []
        while hunts:
            found, left = _found(placed, hunts), []
            for h in hunts:
                key = h.narrow(found[h.node])
                if key is None:
                    left.append(h)
                else:
                    cuts.append((h.node, h.dim, *key, open_nodes[h.node] // 2))
            hunts = left
        table_of_cuts = F.broadcast(_small(spark, cuts, _CUTS))  # a row a node
        t0, t1, t2 = TIES
        goes_left = F.expr(f"c0 is null or {_DIM} < c0 or ({_DIM} = c0 and ({t0} < c1 or ({t0} = c1 and ({t1} < c2 or ({t1} = c2 and {t2} < c3)))))")
        moved = placed.join(table_of_cuts, "node", "left").withColumn("node", F.col("node") + F.when(goes_left, F.lit(0)).otherwise(F.col("half")))
        placed = materialise(moved.select(*placed.columns))
        level = {k: v for start, n in level.items() for k, v in (((start, n // 2), (start + n // 2, n - n // 2)) if n > 1 else ((start, n),))}
    return placed.withColumnRenamed("node", "shard")


def shard(docs: DataFrame, shards: int = 8, mixed: bool = False, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    With target_bytes there are as many shards as it takes for each to have about
    so many bytes.  Slots follow hashes of doc_id and text or, if mixed, the places
    of the rows in the mix of the sources (column source), which are looked up again.
    """
    rows = materialise(metadata(docs, *["source"] * mixed))
    known = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if target_bytes is not None:
        shards = max(1, -(-known["bytes"] // target_bytes))
    placed = grow(rows, shards)
    if mixed:
        placed = mixing.schedule(placed)
        order = [F.expr(mixing.PLACE)]
        bucket, buckets = F.expr(f"({mixing.PLACE}) div {BUCKET_ROWS}L"), buckets_for(known["n"])
    else:
        order = [F.col("row_hash"), F.col("doc_id"), F.col("text_hash")]
        buckets = buckets_for(-(-known["n"] // shards))
        bucket = F.pmod(F.col("row_hash"), F.lit(buckets))
    numbered = number_within(placed.withColumn("shard", F.col("shard").cast("int")), ["shard"], order, bucket, "slot", pairs=shards * buckets)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
