"""Relational operators on whole tables: upserts, merges, purges, set algebra, patches."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import common_columns


def _on(keys: Sequence[str], left: str = "l", right: str = "r") -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    return out


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def insert_only(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target's rows, and source's rows with new keys; columns only one side has are null there."""
    new = source.select(common_columns(target, source)).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(new, allowMissingColumns=True)


def insert_or_replace(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source's rows, whole, and target's rows with other keys."""
    kept = target.join(source.select(*keys), list(keys), "left_anti")
    return kept.unionByName(source.select(common_columns(target, source)), allowMissingColumns=True)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None, keep_if_null: bool = False) -> DataFrame:
    """Full outer merge: ``update`` columns come from source where the key is there (unless null and keep_if_null)."""
    shared = common_columns(target, source)
    update = [c for c in (update or shared) if c not in keys]
    s, t = source.select(*shared).withColumn("_s", F.lit(True)).alias("r"), target.withColumn("_t", F.lit(True)).alias("l")
    both = t.join(s, _on(keys), "full_outer")
    out = []
    for c in target.columns:
        new, old = F.col(f"r.{c}") if c in shared else F.lit(None), F.col(f"l.{c}")
        if c in keys:
            out.append(F.coalesce(old, new).alias(c))
        elif c in update:
            out.append((F.coalesce(new, old) if keep_if_null else F.when(F.col("_s"), new).otherwise(old)).alias(c))
        else:
            out.append(F.when(F.col("_t"), old).otherwise(new).alias(c))
    return both.select(*out)


def upsert_fresh(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert of rows that were just read: every shared column is theirs, nulls too, and their errors are over."""
    clean = {"error_count": F.lit(0), "last_error": F.lit(None).cast("string")}
    for c, value in clean.items():
        if c in target.columns:
            source = source.withColumn(c, value)
    return upsert(target, source, keys)


def seeded_stage(prod: Mapping[str, DataFrame], denied: DataFrame, columns: Mapping[str, str]) -> dict[str, DataFrame]:
    """A staging copy of production tables without the rows of denied hosts (host column by table)."""
    return {n: without_hosts(df, denied, columns[n]) if n in columns else df for n, df in prod.items()}


STRATEGIES = {"INSERT_ONLY": insert_only, "INSERT_OR_REPLACE": insert_or_replace, "UPSERT": upsert}


def merge_counted(target: DataFrame, source: DataFrame, keys: Sequence[str], strategy: str, update: Sequence[str] | None = None) -> tuple[DataFrame, Observation]:
    """The merged rows and what is counted while they are written: rows before and after, and those that are new or changed.

    Both sides have a key once.  One outer join gives rows and counts, so nothing is scanned again for a report.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    shared = common_columns(target, source)
    s, t = source.select(*shared).withColumn("_s", F.lit(True)).alias("r"), target.withColumn("_t", F.lit(True)).alias("l")
    both = t.join(s, _on(keys), "full_outer")
    there, given = F.coalesce("_t", F.lit(False)), F.coalesce("_s", F.lit(False))
    values = {}
    for c in target.columns:
        new, old = F.col(f"r.{c}") if c in shared else F.lit(None).cast(target.schema[c].dataType), F.col(f"l.{c}")
        if c in keys:
            values[c] = F.coalesce(old, new)
        elif strategy == "INSERT_ONLY" or (strategy == "UPSERT" and c not in (update or shared)):
            values[c] = F.when(there, old).otherwise(new)
        else:
            values[c] = F.when(given, new).otherwise(old)
    changed = ~F.struct(*[values[c].alias(c) for c in target.columns]).eqNullSafe(F.struct(*[F.col(f"l.{c}") for c in target.columns]))
    flagged = both.select(*[v.alias(c) for c, v in values.items()], there.alias("_there"), (given & (~there | changed)).alias("_affected"))
    seen = Observation()
    counted = flagged.observe(seen, F.count_if("_there").alias("before"), F.count(F.lit(1)).alias("after"), F.count_if("_affected").alias("affected"))
    return counted.drop("_there", "_affected"), seen


def merge_tables(prod: Mapping[str, DataFrame], stage: Mapping[str, DataFrame], rules: Sequence[Mapping]) -> dict[str, DataFrame]:
    """Merged tables by rules {name, strategy, keys, update_columns}; bad rules raise before anything is read."""
    out = {}
    for rule in rules:
        name, strategy, keys = rule["name"], rule["strategy"], rule["keys"]
        if strategy not in STRATEGIES:
            raise ValueError(f"{name}: unknown strategy {strategy}")
        lost = [k for k in keys if k not in prod[name].columns or k not in stage[name].columns]
        if lost:
            raise ValueError(f"{name}: no key column {lost}")
        extra = {"update": rule["update_columns"]} if strategy == "UPSERT" and rule.get("update_columns") else {}
        out[name] = STRATEGIES[strategy](prod[name], stage[name], keys, **extra)
    return out


def delta_counts(pairs: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]]) -> DataFrame:
    """(name, n): rows of stage whose key prod lacks, for each (prod, stage, keys)."""
    out = None
    for name, (prod, stage, keys) in pairs.items():
        one = stage.join(prod.select(*keys), list(keys), "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def changed_rows(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys in both whose columns differ, nulls being equal."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return before.alias("l").join(after.alias("r"), _on(keys)).where(~same).select(*[F.col(f"l.{k}") for k in keys])


def patch(target: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], only_if_null: bool = False) -> DataFrame:
    """Target with columns set from changes where the key is there; not-null old values stay if only_if_null."""
    c = changes.select(*keys, *columns).withColumn("_p", F.lit(True)).alias("r")
    j = target.alias("l").join(c, _on(keys), "left")
    value = lambda x: F.coalesce(F.col(f"l.{x}"), F.col(f"r.{x}")) if only_if_null else F.when(F.col("_p"), F.col(f"r.{x}")).otherwise(F.col(f"l.{x}"))
    return j.select(*[(value(x) if x in columns else F.col(f"l.{x}")).alias(x) for x in target.columns])


def count_errors(target: DataFrame, failures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Failures (keys, message; any number a key): error_count + their number, and the last_error that sorts last."""
    f = failures.where("message is not null").groupBy(*keys).agg(F.max("message").alias("_m"), F.count("*").cast("int").alias("_n")).alias("r")
    j = target.alias("l").join(f, _on(keys), "left")
    hit = F.col("r._m").isNotNull()
    new = {"error_count": F.coalesce(F.col("l.error_count"), F.lit(0)) + F.col("r._n"), "last_error": F.coalesce(F.col("r._m"), F.col("l.last_error") if "last_error" in target.columns else F.lit(None))}
    return j.select(*[F.when(hit, new[c]).otherwise(F.col(f"l.{c}")).alias(c) if c in new else F.col(f"l.{c}") for c in target.columns])


def without_hosts(df: DataFrame, hosts: DataFrame, column: str = "instance_domain") -> DataFrame:
    """Rows whose normalised host is not among hosts(host)."""
    h = hosts.select(S.normalize_host("host").alias("_h")).where("_h is not null").distinct()
    return df.join(h, S.normalize_host(column) == F.col("_h"), "left_anti")


def only_hosts(df: DataFrame, hosts: DataFrame, column: str = "instance_domain") -> DataFrame:
    h = hosts.select(S.normalize_host("host").alias("_h")).where("_h is not null").distinct()
    return df.join(h, S.normalize_host(column) == F.col("_h"), "left_semi")


def host_counts(tables: Mapping[str, tuple[DataFrame, str]], hosts: DataFrame) -> DataFrame:
    """(table_name, n): rows of each (table, host column) that belong to hosts."""
    out = None
    for name, (df, column) in tables.items():
        one = only_hosts(df, hosts, column).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def reconcile_hosts(prod: DataFrame, joined: DataFrame, denied: DataFrame) -> DataFrame:
    """(host, state): effective hosts are joined less denied; new, kept, or stale against prod."""
    norm = lambda df: df.select(F.lower(F.trim("host")).alias("host")).where("host <> ''").distinct()
    effective = norm(joined).join(norm(denied), "host", "left_anti").withColumn("e", F.lit(True))
    both = norm(prod).withColumn("p", F.lit(True)).join(effective, "host", "full_outer")
    return both.select("host", F.when(F.col("p").isNull(), "new").when(F.col("e").isNull(), "stale").otherwise("kept").alias("state"))


def compare_hosts(local: DataFrame, remote: DataFrame, denied: DataFrame) -> DataFrame:
    """One row: totals, hosts missing locally, and how many of these are denied."""
    r = remote.select(F.lower(F.trim("host")).alias("host")).distinct()
    missing = r.join(local.select(F.lower(F.trim("host")).alias("host")).distinct().withColumn("here", F.lit(1)), "host", "left").join(denied.select(F.lower(F.trim("host")).alias("host")).distinct().withColumn("no", F.lit(1)), "host", "left")
    counts = missing.agg(F.count("*").alias("remote_hosts"), F.count_if(F.col("here").isNull()).alias("missing"), F.count_if(F.col("here").isNull() & F.col("no").isNotNull()).alias("missing_denied"))
    return local.agg(F.countDistinct(F.lower(F.trim("host"))).alias("local_hosts")).crossJoin(counts)  # one row each


def rebuild_content(channels: DataFrame, videos: DataFrame, embeddings: DataFrame, hosts: DataFrame) -> dict[str, DataFrame]:
    """Channels of kept hosts, videos of kept channels, embeddings of kept videos."""
    c = only_hosts(channels, hosts)
    v = videos.join(c.select("channel_id", "instance_domain"), ["channel_id", "instance_domain"], "left_semi")
    e = embeddings.join(v.select("video_id", "instance_domain"), ["video_id", "instance_domain"], "left_semi")
    return {"channels": c, "videos": v, "embeddings": e}


def sample_content(channels: DataFrame, videos: DataFrame, embeddings: DataFrame, hosts: DataFrame, per_host: int, per_channel: int) -> dict[str, DataFrame]:
    """A small catalogue: of the hosts' channels the first so many a host, of theirs the first videos, and what belongs to them."""
    some = only_hosts(channels, hosts).withColumn("_n", F.row_number().over(W.partitionBy("instance_domain").orderBy("channel_id"))).where(F.col("_n") <= per_host).drop("_n")
    few = videos.withColumn("_n", F.row_number().over(W.partitionBy("channel_id", "instance_domain").orderBy("video_id"))).where(F.col("_n") <= per_channel).drop("_n")
    return rebuild_content(some, few, embeddings, hosts)


def drop_unhealthy(stage: DataFrame, prod: DataFrame) -> DataFrame:
    """Stage instances but those that prod has with a health other than ok."""
    bad = prod.where(~F.lower(F.trim(F.coalesce("health_status", F.lit("")))).eqNullSafe(F.lit("ok"))).select(F.lower(F.trim("host")).alias("_h"))
    return stage.join(bad, F.lower(F.trim("host")) == F.col("_h"), "left_anti")


def new_only(found: DataFrame, keys: Sequence[str], *known: DataFrame) -> DataFrame:
    for k in known:
        found = found.join(k.select(*keys), list(keys), "left_anti")
    return found


def edges(found: DataFrame) -> DataFrame:
    """Distinct directed edges without loops."""
    return found.select("source_host", "target_host").where("source_host <> target_host").distinct()


def settled(df: DataFrame) -> DataFrame:
    """df, written once to the folder that driver and executors share, so that what follows neither computes it again nor grows its plan."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return df.checkpoint()


def reachable(edge_table: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, depth) by breadth-first rounds from seeds(host), until no new host is found; each round is settled."""
    edge_table = settled(edge_table.select("source_host", "target_host").distinct())
    frontier = settled(seeds.select("host").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(edge_table, F.col("host") == F.col("source_host")).select(F.col("target_host").alias("host")).distinct()
        frontier = settled(step.join(seen.select("host"), "host", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier) if depth % 10 else settled(seen.unionByName(frontier))
    return seen
