"""URL filters on a sorted digest array.

The rules' keys (host and path, as one string) are 64-bit xxhash digests in one
sorted array; the array, the offsets of the strings and the strings lie in
files that Spark's file server brings to every executor, which memory-maps
them.  A url's candidate keys are its parent domains of no more labels than a rule has, each with
the path cut to the lengths that rules have; all candidates of a batch are
probed by one vectorised binary search, and a hit counts only if the stored
full string is equal, whatever the digests say.  The longest rule that fits
wins (equal lengths: the one whose string sorts first).

``MAX_LIST_BYTES`` bounds what is shipped.  A larger list goes to as many digest
arrays of that size as it needs, each probed in turn by the same tasks, so that
one array is mapped at a time; memory-mapped pages are the system's to drop.

Cases: null or no "://": host and path are empty and no rule fits.  Repeated
rules count once, the first verdict in string order of (key, verdict) wins; a
rule with a null key is ignored.  Urls without rule get the default verdict:
the list names what is blocked, so anything else is allowed.  Repeated pages are
judged each, urls of any length whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import ship, table

#: Fixed rules of the registered query: (host and path, verdict)
RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]
DEFAULT = "allow"
MAX_LIST_BYTES = 256 << 20


def build(rules: list[tuple[str, str]], folder: Path, name: str) -> None:
    """name.keys (sorted digests), name.at (offsets), name.text (key, verdict strings)."""
    first: dict[str, str] = {}
    for key, verdict in sorted((k, v) for k, v in rules if k is not None):
        first.setdefault(key, verdict)
    entries = sorted((xxhash.xxh64_intdigest(k.encode()), k, v) for k, v in first.items())
    np.array([e[0] for e in entries], np.uint64).tofile(folder / f"{name}.keys")
    texts = [f"{k}\0{v}".encode() for _, k, v in entries]
    np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64).tofile(folder / f"{name}.at")
    (folder / f"{name}.text").write_bytes(b"".join(texts))


class DigestArray:
    """A built list, memory-mapped."""

    def __init__(self, keys: str, at: str, text: str):
        mapped = lambda p, t: np.memmap(p, t, "r") if Path(p).stat().st_size else np.zeros(0, t)
        self.keys, self.at, self.text = mapped(keys, np.uint64), mapped(at, np.int64), mapped(text, np.uint8)

    def find(self, candidates: list[bytes]) -> list[str | None]:
        """The verdict stored under each key, None where there is none."""
        digest = np.fromiter((xxhash.xxh64_intdigest(c) for c in candidates), np.uint64, len(candidates))
        spot = np.searchsorted(self.keys, digest)
        out: list[str | None] = [None] * len(candidates)
        possible = spot < len(self.keys)
        possible[possible] = self.keys[spot[possible]] == digest[possible]
        for i in np.flatnonzero(possible):
            k = int(spot[i])
            while k < len(self.keys) and self.keys[k] == digest[i]:  # equal digests lie together
                key, _, verdict = self.text[self.at[k] : self.at[k + 1]].tobytes().partition(b"\0")
                if key == candidates[i]:
                    out[i] = verdict.decode()
                    break
                k += 1
        return out


def candidates(host: str, path: str, lengths: list[int], most: int) -> Iterator[str]:
    """Keys of all rules that could fit: parent domains of no more labels than a rule has (most), times path starts."""
    labels = host.rsplit(".", most)[-most:]
    for k in range(len(labels)):
        domain = ".".join(labels[k:])
        for n in lengths:
            if n <= len(path):
                yield domain + path[:n]


def ship_lists(spark: SparkSession, rules: list[tuple[str, str]]) -> list[str]:
    """Build the digest arrays and bring them to every executor; their names."""
    folder, names = Path(tempfile.mkdtemp(prefix="quarry-urls-")), []
    part: list[tuple[str, str]] = []
    size = 0
    for rule in [*sorted(r for r in rules if r[0] is not None), None]:
        if rule is None or size > MAX_LIST_BYTES:
            names.append(f"urls-{uuid.uuid4().hex}")
            build(part, folder, names[-1])
            for end in ("keys", "at", "text"):
                spark.sparkContext.addFile(str(folder / f"{names[-1]}.{end}"))
            part, size = [], 0
        if rule is not None:
            part.append(rule)
            size += 16 + len(rule[0])
    return names


def split_url() -> tuple:
    """Host and path of column url by the contract's definition, as Spark expressions."""
    after = F.expr("if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')")  # null: instr is null
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    spark = pages.sparkSession
    ship(spark)
    names = ship_lists(spark, rules)
    lengths = sorted({len(k) - k.index("/") if "/" in k else 0 for k, _ in rules if k is not None})

    most = max((k.partition("/")[0].count(".") + 1 for k, _ in rules if k is not None), default=1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = [[SparkFiles.get(f"{n}.{end}") for end in ("keys", "at", "text")] for n in names]
        for batch in batches:
            hosts, routes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            owner, keys = [], []
            for i, (host, path) in enumerate(zip(hosts, routes, strict=True)):
                if host:
                    for c in candidates(host, path, lengths, most):
                        owner.append(i)
                        keys.append(c)
            best: list[tuple[int, str, str] | None] = [None] * len(hosts)
            raw = [k.encode() for k in keys]
            for files in paths:
                for i, key, verdict in zip(owner, keys, DigestArray(*files).find(raw), strict=True):
                    if verdict is not None and (best[i] is None or (-len(key), key) < best[i][:2]):
                        best[i] = (-len(key), key, verdict)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([b and b[1] for b in best], pa.string()), pa.array([b[2] if b else default for b in best], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    host, path = split_url()
    return pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path")).mapInArrow(each, "page_id long, host string, path string, rule string, verdict string")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


_VALUES = ", ".join(f"('{k}', '{k[: k.index('/')]}', '{k[k.index('/') :]}', '{v}')" for k, v in RULES)
SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rule, rule_host, rule_path, rule_verdict) AS (VALUES {_VALUES}), fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS verdict
  FROM p JOIN r ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM p LEFT JOIN fit USING (page_id)
"""
