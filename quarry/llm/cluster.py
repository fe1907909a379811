"""What every operator of this subpackage needs from the session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor.

    Spark's own file server delivers a small archive of the sources, once per
    application, so that no executor needs the repository on its disk.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="quarry-src-"))
    archive = folder / "quarry_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(archive))
    sc._quarry_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine (tests) is one made;
    on a cluster a folder of the driver's machine would lose what executors write.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(sc, "_quarry_own_dir", None):
        sc._quarry_own_dir = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
    return sc._quarry_own_dir


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what is read later survives the loss of any executor,
    and nothing above is computed twice.  The files go when the driver's JVM ends
    in order, as results may be read until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    written = spark._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(written)
    sc = spark.sparkContext
    sc._quarry_written = [*getattr(sc, "_quarry_written", []), path]
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def written(spark: SparkSession) -> list[str]:
    """Paths of the tables written so far."""
    return list(getattr(spark.sparkContext, "_quarry_written", []))


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        gone = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    spark.sparkContext._quarry_written = [p for p in written(spark) if p not in set(paths)]


def carried(read: DataFrame, names: tuple[str, ...]) -> str:
    """DDL of further columns that rows of ``read`` take along."""
    return "".join(f", `{n}` {read.schema[n].dataType.simpleString()}" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
