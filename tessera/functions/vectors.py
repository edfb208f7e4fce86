"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is zero or the lengths differ, null of a null."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / size)
