"""Batch jobs that can be stopped at any place: a lease, a log of finished stages, one commit at the end."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.stores import Store


class Files:
    """Small text files in any folder that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf, self.folder = spark._jvm, spark._jsc.hadoopConfiguration(), folder.rstrip("/")

    def _at(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.conf)

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if there is one (of two writers one succeeds)."""
        path, fs = self._at(name)
        try:
            out = fs.create(path, False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str | None:
        path, fs = self._at(name)
        if not fs.exists(path):
            return None
        data = fs.open(path)
        try:
            return bytes(data.readAllBytes()).decode()
        finally:
            data.close()

    def names(self) -> list[str]:
        path, fs = self._at("")
        return sorted(f.getPath().getName() for f in fs.listStatus(path) if not f.getPath().getName().startswith(".")) if fs.exists(path) else []


class LeaseHeld(RuntimeError):
    pass


class Lease:
    """One holder at a time, until its time is over: numbered files, each made by one writer only."""

    def __init__(self, store: Store, name: str, holder: str, seconds: float, clock: Callable[[], float] = time.time):
        self.files, self.holder, self.seconds, self.clock = Files(store.spark, f"{store.folder}/_lease/{name}"), holder, seconds, clock

    def _last(self) -> tuple[int, dict | None]:
        names = self.files.names()
        if not names:
            return 0, None
        text = self.files.read(names[-1])
        # a file without text was made by a writer that died (or is still writing): its time is unknown, so it counts from now
        return int(names[-1]), json.loads(text) if text else {"holder": "?", "until": self.clock()}

    def acquire(self) -> int:
        """Take or renew the lease; its number, which grows with every holder.  LeaseHeld if another's time is not over."""
        number, last = self._last()
        if last is not None and last["holder"] != self.holder and last["until"] > self.clock():
            raise LeaseHeld(f"{last['holder']} until {last['until']}")
        if not self.files.create(f"{number + 1:012d}", json.dumps({"holder": self.holder, "until": self.clock() + self.seconds})):
            raise LeaseHeld("another holder was faster")
        return number + 1

    def held(self) -> bool:
        _, last = self._last()
        return last is not None and last["holder"] == self.holder and last["until"] > self.clock()

    def release(self) -> None:
        if self.held():
            number, _ = self._last()
            self.files.create(f"{number + 1:012d}", json.dumps({"holder": self.holder, "until": 0}))


class Run:
    """Stages of one run: what a stage wrote is logged when it is done, so a later run of the same name goes on after it.

    Nothing is current before ``commit``, which names all tables at once; a run that
    was committed does nothing again.  The inputs must be those of the first attempt.
    """

    def __init__(self, store: Store, name: str, lease: Lease | None = None):
        self.store, self.lease = store, lease
        self.log = Files(store.spark, f"{store.folder}/_runs/{name}")
        if lease is not None:
            lease.acquire()

    def done(self, stage: str) -> dict | None:
        text = self.log.read(f"{stage}.json")
        return json.loads(text) if text else None

    @property
    def committed(self) -> bool:
        return self.done("_commit") is not None

    def stage(self, name: str, make: Callable[[], dict[str, DataFrame]], partition_by: dict[str, list[str]] | None = None, note: Callable[[], object] = lambda: None) -> dict:
        """Write the tables of a stage, unless an earlier attempt did; {"paths": table -> path, "note": what note() gave}."""
        if (found := self.done(name)) is not None:
            return found
        if self.lease is not None:
            self.lease.acquire()
        found = {"paths": {table: self.store.stage(table, df, (partition_by or {}).get(table)) for table, df in make().items()}, "note": note()}
        self.log.create(f"{name}.json", json.dumps(found))
        return found

    def read(self, stage: dict, table: str) -> DataFrame:
        return self.store._parts(table, [stage["paths"][table]])

    def commit(self, stages: list[dict], at: int) -> None:
        if self.committed:
            return
        if self.lease is not None:
            self.lease.acquire()
        self.store.commit({table: path for s in stages for table, path in s["paths"].items()}, at)
        self.log.create("_commit.json", json.dumps({"at": at}))
        if self.lease is not None:
            self.lease.release()
