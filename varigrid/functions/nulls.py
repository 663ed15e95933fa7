"""Missing values are NULL everywhere in this library; these functions make them so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x``, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def denan(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with NaN turned to null in ``columns``, or in all float and double columns."""
    kinds = dict(df.dtypes)
    names = columns or [n for n, kind in kinds.items() if kind in ("float", "double")]
    return df.withColumns({n: F.nanvl(F.col(n), F.lit(None).cast(kinds[n])) for n in names})


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` in doubles; null where ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def masked(x: Column, mean: Column, low: float, high: float) -> Column:
    """``x`` where ``mean`` lies in the admissible range, ends included."""
    return F.when(mean.between(low, high), x)
