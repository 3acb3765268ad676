"""Dense vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector divided by its length; unchanged if that is 0."""
    # The length goes along as an array, so that it is taken once and not for every place.
    lengths = F.array_repeat(F.sqrt(dot(a, a)), F.size(a))
    return F.zip_with(a, lengths, lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
