"""Vector expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null or zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def usable(v: Column, dimensions: int) -> Column:
    """As many finite numbers as dimensions, not all of them zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimensions) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_sql(e: str, dimensions: int) -> str:
    return f"coalesce(len({e}) = {dimensions} and list_count(list_filter({e}, lambda x: isfinite(x))) = {dimensions} and list_count(list_filter({e}, lambda x: x <> 0)) > 0, false)"
