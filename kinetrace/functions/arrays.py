"""Vector algebra on ARRAY<DOUBLE> columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def scaled(a: Column, by: Column) -> Column:
    """a / by; by is bound once, not recomputed for each element."""
    return F.transform(F.array(by), lambda n: F.transform(a, lambda x: x / n))[0]


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return scaled(a, F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 if either is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def soap_distance(a: Column, b: Column) -> Column:
    """sqrt(2 - 2 cos): cosine held to [-1, 1]; a zero vector is at sqrt(2) from everything."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * c))


def kernel(a: Column, b: Column, n: int = 1) -> Column:
    return F.pow(cosine(a, b), F.lit(n)) if n != 1 else cosine(a, b)


def kernel_distance(a: Column, b: Column, n: int = 1) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * kernel(a, b, n)))


def unit_distance(a: Column, b: Column) -> Column:
    """Distance of vectors that have unit length already."""
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * dot(a, b)))


DISTANCES = {"soap": soap_distance, "simple": kernel_distance, "normalized": unit_distance}
