"""Agreement of two sensors: correlation, slope and spread by band, and the gate over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.config import GateConfig
from varigrid.functions.nulls import finite, ratio


def pair_stats(df: DataFrame, fine: str, coarse: str, keys: Sequence[str] = (), min_pairs: int = 20) -> DataFrame:
    """``n, correlation, slope`` (of fine on coarse), deviations, medians and their ratio, from complete pairs."""
    pairs = df.select(*keys, finite(F.col(fine)).alias("_t"), finite(F.col(coarse)).alias("_c")).where("_t is not null and _c is not null")
    out = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr("_t", "_c").alias("correlation"), F.regr_slope("_t", "_c").alias("slope"), F.stddev_pop("_t").alias("sd_fine"), F.stddev_pop("_c").alias("sd_coarse"), F.median("_t").alias("fine_median"), F.median("_c").alias("coarse_median")
    )
    return out.where(F.col("n") >= min_pairs).withColumn("ratio_of_medians", ratio(F.col("fine_median"), F.col("coarse_median")))


def nearest_band(bands: DataFrame, targets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """For each target ``nm``, the ``band_index`` and ``wavelength_nm`` nearest to it; ties go to the first band.

    Band lists are metadata, a few hundred rows a scene, and a target list is shorter still.
    """
    met = bands.join(F.broadcast(targets), F.lit(True))
    best = F.min_by(F.struct("band_index", "wavelength_nm"), F.struct(F.abs(F.col("wavelength_nm") - F.col("nm")), F.col("band_index")))
    return met.groupBy(*keys, "nm").agg(best.alias("b")).select(*keys, "nm", "b.band_index", "b.wavelength_nm")


def band_match(bands: DataFrame, targets: DataFrame, within: float = 3.0, keys: Sequence[str] = ()) -> DataFrame:
    """For each target ``nm``, the first band in order within ``within`` nm, ends included; others have none."""
    met = bands.join(F.broadcast(targets), F.abs(F.col("wavelength_nm") - F.col("nm")) <= within)
    return met.groupBy(*keys, "nm").agg(F.min_by(F.struct("band_index", "wavelength_nm"), F.col("band_index")).alias("b")).select(*keys, "nm", "b.band_index", "b.wavelength_nm")


def first_column(df: DataFrame, names: Sequence[str]) -> str:
    """The first of ``names`` that is a column of ``df``."""
    for name in names:
        if name in df.columns:
            return name
    raise KeyError(f"none of {list(names)} among {df.columns}")


def furthest_from_one(factor: Column) -> Column:
    """The positive factor furthest from 1 on a log scale, its direction kept; the larger of equals."""
    positive = F.when(factor > 0, factor)
    return F.max_by(positive, F.when(factor > 0, F.struct(F.abs(F.ln(positive)), positive)))


def worst_spread(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``worst_correlation, worst_spread`` over the rows (bands) of ``stats``."""
    return stats.groupBy(*keys).agg(F.min("correlation").alias("worst_correlation"), furthest_from_one(F.col("slope")).alias("worst_spread"))


def spectral_agreement(df: DataFrame, fine: dict[float, str], coarse: dict[float, str], keys: Sequence[str] = (), min_pairs: int = 20, within: float = 3.0) -> DataFrame:
    """:func:`pair_stats` by ``wavelength_nm`` for each coarse band that a fine one matches within ``within`` nm."""
    pairs = [(nm, next((f for w, f in fine.items() if abs(w - nm) <= within), None), c) for nm, c in coarse.items()]
    rows = F.array(*(F.struct(F.lit(float(nm)).alias("wavelength_nm"), F.col(f).alias("t"), F.col(c).alias("c")) for nm, f, c in pairs if f))
    long = df.select(*keys, F.explode(rows).alias("b")).select(*keys, "b.*")
    return pair_stats(long, "t", "c", [*keys, "wavelength_nm"], min_pairs)


def agreement_gate(stats: DataFrame, config: GateConfig = GateConfig(), keys: Sequence[str] = ()) -> DataFrame:
    """``worst_correlation, worst_spread, passes`` over the gated bands of :func:`spectral_agreement`."""
    gated = stats.where(F.col("wavelength_nm").isin(*map(float, config.gated_bands)))
    out = worst_spread(gated, keys)
    import math

    ok = (F.col("worst_correlation") >= config.min_correlation) & (F.abs(F.ln("worst_spread")) <= math.log(config.max_spread))
    return out.withColumn("passes", F.coalesce(ok, F.lit(False)))
