"""Host lists: allow-list JSON, text files, host options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def from_json(spark: SparkSession, path: str, allow_empty: bool = False) -> DataFrame:
    """Hosts of {"data": [...]} or [...], entries being strings or {"host": ...}; lower case, distinct."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))
    listed = F.coalesce(F.get_json_object("value", "$.data"), F.when(F.ltrim("value").startswith("["), F.col("value")))
    entry = raw.select(F.explode(F.from_json(listed, "array<string>")).alias("e"))
    host = F.coalesce(F.get_json_object("e", "$.host"), F.when(~F.ltrim("e").startswith("{"), F.col("e")))
    out = entry.select(F.lower(F.trim(host)).alias("host")).where("host <> ''").distinct()
    if not allow_empty and out.isEmpty():
        raise ValueError(f"no hosts in {path}")
    return out


def from_text(spark: SparkSession, path: str) -> DataFrame:
    """One host a line; blank lines and # comments are skipped."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(S.host_token("value").alias("host")).where("host is not null").distinct()


def to_text(hosts: DataFrame, path: str) -> None:
    """One host a line, by name, as one text file that ``from_text`` reads."""
    hosts.select(F.col("host").alias("value")).distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)
