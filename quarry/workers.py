"""Make this package importable in the Python workers of every executor."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Spark's own file server delivers a small archive of the sources, once per
    application, so that no executor needs the repository on its disk."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="quarry-src-")) / "quarry_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(archive))
    sc._quarry_shipped = True
