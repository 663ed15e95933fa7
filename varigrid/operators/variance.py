"""Exact split of a field's variance at a block size (law of total variance)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.functions.nulls import finite, ratio
from varigrid.operators.quantiles import percentiles


def _block(c: str, factor: Column | int) -> Column:
    return F.floor(F.col(c) / (factor if isinstance(factor, Column) else F.lit(factor))).cast("long")


def block_mean(cells: DataFrame, row: str, col: str, value: str, factor: int, n_rows: int, n_cols: int, keys: Sequence[str] = ()) -> DataFrame:
    """``n, mean`` of the finite values in whole ``factor`` x ``factor`` blocks that have one."""
    v = finite(F.col(value))
    inside = (F.col(row) < n_rows // factor * factor) & (F.col(col) < n_cols // factor * factor)
    some = cells.where(inside & v.isNotNull())
    return some.groupBy(*keys, _block(row, factor).alias("block_row"), _block(col, factor).alias("block_col")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"))


def variance_split(cells: DataFrame, row: str, col: str, value: str, factors: Sequence[int], n_rows: int, n_cols: int, keys: Sequence[str] = ()) -> DataFrame:
    """``n, between, within, total`` of the population for each block size, by ``keys``.

    The window is trimmed to whole blocks; blocks weigh as their finite samples. All sizes are done together:
    samples are read once and reduced to a block's n, mean and variance; blocks are then summed up.
    """
    v = finite(F.col(value)).alias("_v")
    some = cells.select(*keys, row, col, v).where("_v is not null").withColumn("factor", F.explode(F.array(*map(F.lit, factors))))
    trim = lambda c, n: F.col(c) < F.floor(F.lit(n) / F.col("factor")) * F.col("factor")
    some = some.where(trim(row, n_rows) & trim(col, n_cols))
    blocks = some.groupBy(*keys, "factor", _block(row, F.col("factor")).alias("_r"), _block(col, F.col("factor")).alias("_c")).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("m"), F.var_pop("_v").alias("s2"))
    out = blocks.groupBy(*keys, "factor").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_g"), (F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("n")).alias("_q"), (F.sum(F.col("n") * F.col("s2")) / F.sum("n")).alias("_within")
    )
    spread = F.greatest(F.col("_q") - F.col("_g") * F.col("_g"), F.lit(0.0))
    one = F.col("factor") == 1
    total = spread + F.col("_within")
    return out.select(*keys, "factor", "n", F.when(one, total).otherwise(spread).alias("between"), F.when(one, F.lit(0.0)).otherwise(F.col("_within")).alias("within"), total.alias("total"))


def variance_ladder(cells: DataFrame, row: str, col: str, scalars: Mapping[str, str], factors: Sequence[int], n_rows: int, n_cols: int, keys: Sequence[str] = (), min_finite: int = 480) -> DataFrame:
    """Shares between and within cells for every scalar and block size; fields too small or flat are left out."""
    named = F.array(*(F.struct(F.lit(name).alias("scalar"), finite(F.col(c)).alias("v")) for name, c in scalars.items()))
    long = cells.select(*keys, row, col, F.explode(named).alias("s")).select(*keys, row, col, "s.scalar", "s.v")
    fields = long.groupBy(*keys, "scalar").agg(F.count("v").alias("n_finite"), F.var_pop("v").alias("total_variance")).where((F.col("n_finite") >= min_finite) & (F.col("total_variance") > 0))
    split = variance_split(long, row, col, "v", factors, n_rows, n_cols, [*keys, "scalar"])
    share = ratio(F.col("between"), F.col("total"))
    return split.join(fields, [*keys, "scalar"]).select(*keys, "scalar", "factor", "n_finite", "total_variance", share.alias("between_cell_fraction"), (1 - share).alias("within_cell_fraction"))


def centre_window(cells: DataFrame, row: str, col: str, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """``row0, col0``: the first row and column of the window about the median row and column that hold a cell."""
    medians = lambda c, name: cells.select(*keys, c).distinct().groupBy(*keys).agg(F.greatest(F.floor(F.median(c)) - size // 2, F.lit(0)).cast("long").alias(name))
    rows, cols = medians(row, "row0"), medians(col, "col0")
    return rows.join(cols, list(keys)) if keys else rows.join(F.broadcast(cols), F.lit(True))  # one row each


def stretch(df: DataFrame, value: str, low: float = 0.08, high: float = 0.92, keys: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles for a display stretch."""
    return percentiles(df.select(*keys, finite(F.col(value)).alias("_value")), keys, "_value", {"low": low, "high": high}).drop("n")
