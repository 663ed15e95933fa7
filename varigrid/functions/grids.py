"""Cells and indices of grids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_assign(value: Column, low: float, cell: float, n: int) -> Column:
    """The cell of ``value`` on an axis of ``n`` cells from ``low``; values beyond the ends go to the end cells."""
    at = F.floor((value.cast("double") - F.lit(float(low))) / F.lit(float(cell))).cast("long")
    return F.when(at < 0, F.lit(0).cast("long")).when(at > n - 1, F.lit(n - 1).cast("long")).otherwise(at)


def unravel(index: Column, n_columns: int | Column) -> tuple[Column, Column]:
    """Row and column of a flat index in a grid of ``n_columns``, a number or each row's own."""
    index, n = index.cast("long"), (n_columns if isinstance(n_columns, Column) else F.lit(n_columns)).cast("long")
    return F.floor(index / n).cast("long"), F.pmod(index, n)


def flat(row: Column, column: Column, n_columns: int) -> Column:
    return row.cast("long") * n_columns + column.cast("long")


def axis_distance(a: Column, b: Column, n: int | None = None) -> Column:
    """Cells between two places on an axis; the short way round if the axis has ``n`` cells and wraps."""
    straight = F.abs(a - b)
    return F.least(straight, n - straight) if n else straight
