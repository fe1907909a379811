"""Stored tables: a folder a table, replaced or added to so that readers never see half of a write."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES


class Store:
    """Versions of tables under one folder; a small pointer table names the current ones.

    A version is the last part that replaced the table and the parts appended since.
    Pointers of several tables are added by one commit of one file, so a write of
    tables that belong together is seen whole or not at all; an append writes and names
    its own rows only.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("at long, turn long, name string, path string, added boolean").json(f"{self.folder}/_current")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def versions(self, name: str) -> list[list[str]]:
        """Paths of the parts of all versions, the current one first; what appends added belongs to the version before."""
        rows = self._pointers()
        out: list[list[str]] = []
        for r in [] if rows is None else rows.where(F.col("name") == name).orderBy("at", "turn").collect():  # a row a write
            if r["added"] and out:
                out[-1].append(r["path"])
            else:
                out.append([r["path"]])
        return out[::-1]

    def version(self, name: str) -> list[str] | None:
        return next(iter(self.versions(name)), None)

    def read(self, name: str) -> DataFrame:
        paths = self.version(name)
        if paths is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self._parts(name, paths)

    def _parts(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*paths).drop("stored")

    def stage(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """Write a part that nothing names yet; its path."""
        path = f"{self.folder}/{name}/stored=v{uuid.uuid4().hex}"
        w = df.write.option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        return path

    def commit(self, paths: dict[str, str], at: int, added: frozenset[str] = frozenset()) -> None:
        """Name staged parts together: each replaces its table, or is added to it."""
        turn = time.time_ns()
        rows = [(at, turn, n, p, n in added) for n, p in paths.items()]
        self.spark.createDataFrame(rows, "at long, turn long, name string, path string, added boolean").coalesce(1).write.mode("append").json(f"{self.folder}/_current")

    def write_all(self, tables: dict[str, DataFrame], at: int, partition_by: dict[str, list[str]] | None = None, added: frozenset[str] = frozenset()) -> None:
        """Write new parts, then name them current together; old ones stay until they are dropped."""
        self.commit({name: self.stage(name, df, (partition_by or {}).get(name)) for name, df in tables.items()}, at, added)

    def write(self, name: str, df: DataFrame, at: int, partition_by: list[str] | None = None) -> None:
        self.write_all({name: df}, at, {name: partition_by} if partition_by else None)

    def append(self, name: str, df: DataFrame, at: int, partition_by: list[str] | None = None) -> None:
        """Add rows to the current version; what is stored is neither read nor written."""
        self.write_all({name: df}, at, {name: partition_by} if partition_by else None, frozenset({name}))

    def compact(self, name: str, at: int, parts: int = 16, partition_by: list[str] | None = None) -> bool:
        """Write a version of more than so many parts as one; whether it was."""
        now = self.version(name)
        if now is None or len(now) <= parts:
            return False
        rows = self.read(name)
        self.write(name, rows.repartition(*partition_by) if partition_by else rows, at, partition_by)
        return True

    def merge(self, name: str, df: DataFrame, keys: list[str], strategy: str, at: int) -> dict[str, int]:
        """Merge rows into a table; rows before and after and those affected, as counted while the new version was written."""
        from ..operators.tables import merge_counted

        merged, seen = merge_counted(self.read(name), df, keys, strategy)
        self.write(name, merged, at)
        return dict(seen.get)

    def backup(self, name: str, folder: str) -> str | None:
        """Copy the current version elsewhere; its path there, None without a version."""
        paths = self.version(name)
        if paths is None:
            return None
        target = f"{folder.rstrip('/')}/{name}-{paths[-1].rsplit('=', 1)[-1]}"
        self._parts(name, paths).write.mode("overwrite").parquet(target)
        return target

    def drop_old(self, name: str, keep: int = 1) -> int:
        """Delete all versions but the newest ``keep``; how many parts went."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        old = [path for version in self.versions(name)[keep:] for path in version]
        for path in old:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        return len(old)


def merge_rules(text: str) -> list[dict]:
    rules = json.loads(text)["tables"]
    for r in rules:
        if not r.get("name") or not r.get("keys") or not r.get("strategy"):
            raise ValueError(f"incomplete rule: {r}")
    return rules
