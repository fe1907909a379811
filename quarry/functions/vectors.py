"""Vectors as arrays of numbers: declarative forms, and Arrow blocks for many pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v) -> Column:
    """Unit vector of doubles; null for zero or non-finite length, [] for []."""
    n = norm(v)
    ok = (n > 0) & ~F.isnan(n) & (n != float("inf"))
    return F.when(F.size(_c(v)) == 0, _c(v).cast("array<double>")).when(ok, F.transform(_c(v), lambda x: x.cast("double") / n))


def parse_vector(x) -> Column:
    """Numbers of a JSON list or of a list with blanks or commas; what is no finite number is left out."""
    parts = F.split(F.regexp_replace(F.trim(_c(x)), r"^\[|\]$", ""), r"[\s,]+")
    numbers = F.transform(parts, lambda p: F.when(p.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), p.cast("double")))
    return F.filter(numbers, lambda d: d.isNotNull() & (F.abs(d) != float("inf")))


def of_dim(v, dim: int) -> Column:
    return F.size(_c(v)) == dim
