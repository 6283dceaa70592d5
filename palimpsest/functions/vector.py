"""Vector arithmetic as column expressions: JVM-side, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """Cosine similarity; 0 where the lengths differ or a vector is empty or zero. Pass stored norms where there are any."""
    under = (norm(a) if na is None else na) * (norm(b) if nb is None else nb)
    return F.when((F.size(a) == F.size(b)) & (under > 0), dot(a, b) / under).otherwise(0.0)


def unit(x: Column) -> Column:
    """Cut to [0, 1]."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
