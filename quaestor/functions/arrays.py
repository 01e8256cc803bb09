"""Array functions that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zip_shortest(a: Column, b: Column) -> Column:
    """``ARRAY<STRUCT<a, b>>`` of elements at the same place, as long as the shorter array; null if either is null."""
    n = F.least(F.size(a), F.size(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("a"), y.alias("b"))))


def slices(a: Column, size: int) -> Column:
    """``ARRAY<ARRAY>``: consecutive parts of at most ``size`` elements; empty for empty and null arrays."""
    n = F.coalesce(F.size(a), F.lit(0))
    starts = F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / size).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.slice(a, i * size + 1, F.lit(size)))
