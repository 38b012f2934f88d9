"""Vector column expressions (JVM-side, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(v) -> Column:
    """Euclidean norm of an array column, computed in double."""
    v = F.col(v) if isinstance(v, str) else v
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(v) -> Column:
    """Unit-length copy of an array column (float); a zero vector stays zero."""
    v = F.col(v) if isinstance(v, str) else v
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n)
                       .otherwise(F.lit(0.0)).cast("float"))


def inner_product(a, b) -> Column:
    """Sum of element products in array order, in double (cosine on unit vectors)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)
