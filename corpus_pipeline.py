"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

``run(spark, sf_dir)`` applies STAGES in order.  Every stage but the last returns
the columns of documents; the last returns the shards.

The quality rules and decontamination take the rows along through their one pass, so a
verdict stays with its row: rows without doc_id, or with one doc_id and several texts,
are judged as any other, and nothing is joined back.  Near copies are found among
numbered rows; of each group the row with the least doc_id stays (any doc_id before
none, then the first row).

Cases: null and empty texts have no words, so the quality rules reject them; a null
source is a source of its own; equal rows are copies of each other, one stays; very
long texts are read whole; ties of slots and cuts follow from hashes of the rows; an
empty table gives an empty result; columns beside those of documents are carried
along up to the shards, whatever their names (but ``__row``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, mixing, ngram_join, quality, sharding
from quarry.llm.cluster import discard, materialise, table, written


#: What goes along with a row: its text, and its other columns as one.
CARRY = ("text", "__row")


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("__row"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text").cast(docs.schema["text"].dataType) if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _unpacked(quality.judge(_packed(docs), carry=CARRY).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least doc_id."""
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = ngram_join.join(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    named = found.join(rows.select("__row", "doc_id"), "__row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first"))
    return rows.join(first.select("first.__row"), "__row", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark go."""
    found = decontam.decontaminate(_packed(docs), table(spark, sf_dir, "benchmark"), carry=CARRY)
    return _unpacked(decontam.digest(found).where("not contaminated"), docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order in which every stretch has the sources' target weights."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shards; the slots of each are in the order of the mix."""
    return sharding.shard(docs, mixed=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shards),
]

#: The verdict of quality rules comes from expectation-maximisation, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = table(spark, sf_dir, "documents"), set(written(spark))
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialise(docs)
            discard(spark, [p for p in written(spark)[:-1] if p not in others])  # what the stage and the one before left
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
