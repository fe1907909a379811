"""Gapless numbers within groups, however large a group is (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

#: Rows of one group that one window partition numbers, about.
BUCKET_ROWS = 20_000
#: Pairs of group and bucket (some 50 bytes each) up to which their counts are broadcast; beyond, a shuffled join.
MAX_BROADCAST_PAIRS = 200_000


def buckets_for(rows: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS))


def number_within(df: DataFrame, group: list[str], order: list[Column], bucket: Column, name: str, light: DataFrame | None = None, pairs: int | None = None) -> DataFrame:
    """Add column ``name``: 0, 1, ... within each group, by bucket, then by ``order``.

    ``bucket`` (a long that any rows of a group with a place in the order agree
    with) deals a group over many window partitions; what precedes a bucket is a
    prefix sum of the buckets' counts.  Two rows tie only if equal in bucket and
    order; either may come first.  ``light`` may give the rows of df with fewer
    columns for the counts, ``pairs`` a bound of the number of pairs of group and
    bucket: if they are few, rows are shuffled once, for the numbering itself.
    """
    b, before, rows = f"__{name}_bucket", f"__{name}_before", f"__{name}_rows"
    held = df.withColumn(b, bucket)
    counts = (df if light is None else light).withColumn(b, bucket).groupBy(*group, b).agg(F.count("*").alias(rows))
    upto = Win.partitionBy(*group).orderBy(b).rowsBetween(Win.unboundedPreceding, -1)
    offsets = counts.select(*group, b, F.coalesce(F.sum(rows).over(upto), F.lit(0)).alias(before))
    within = Win.partitionBy(*group, b).orderBy(*order)
    numbered = held.withColumn(name, F.row_number().over(within) - 1)
    keys = [*group, b]
    offsets = offsets.select(*[F.col(k).alias(f"__o_{i}") for i, k in enumerate(keys)], before)
    offsets = F.broadcast(offsets) if pairs is not None and pairs <= MAX_BROADCAST_PAIRS else offsets
    same = [F.col(k).eqNullSafe(F.col(f"__o_{i}")) if k in group else F.col(k) == F.col(f"__o_{i}") for i, k in enumerate(keys)]
    joined = numbered.join(offsets, same, "left")
    return joined.withColumn(name, F.col(name) + F.col(before)).drop(b, before, *[f"__o_{i}" for i in range(len(keys))])
