"""Binning of fine samples into coarse cells: bounded nearest-centre join and grouped moments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varigrid.functions.nulls import finite, ratio
from varigrid.operators import nearest, quantiles
from varigrid.sources.fixtures import scratch


def nearest_join(points: DataFrame, centres: DataFrame, spacing: float | Column, *, x: str = "x", y: str = "y", cx: str = "cx", cy: str = "cy", index: str = "coarse_index", keys: Sequence[str] = ()) -> DataFrame:
    """``points`` with ``index`` and ``distance`` of the nearest centre within ``spacing``, ends included; others go.

    Both sides are bucketed by cells as wide as ``spacing``; a centre stands in the nine buckets around its own,
    so the nearest within reach is always in a point's bucket and the join is one equi-join, exact. A bucket's
    centres are gathered to an array first (a few on a grid of this spacing), so each point meets one row and no
    shuffle by point follows. Ties go to the lowest index. ``keys`` (a scene, say) must agree.

    ``spacing`` may be a column that both tables have, one value for all rows of a key. It should be the centres' real
    spacing: a bucket holds the centres of nine cells of that width.
    """
    s = spacing if isinstance(spacing, Column) else F.lit(float(spacing))
    around = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    dealt = centres.where(finite(F.col(cx)).isNotNull() & finite(F.col(cy)).isNotNull())
    dealt = dealt.groupBy(*keys, s.alias("_s"), F.col(cx).alias("_cx"), F.col(cy).alias("_cy")).agg(F.min(index).alias("_index"))
    dealt = dealt.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    dealt = dealt.withColumns({"_bx": (F.floor(F.col("_cx") / F.col("_s")) + F.col("_dx")).cast("long"), "_by": (F.floor(F.col("_cy") / F.col("_s")) + F.col("_dy")).cast("long")})
    buckets = dealt.groupBy(*keys, "_bx", "_by").agg(F.collect_list(F.struct("_index", "_cx", "_cy")).alias("_centres"))
    placed = points.withColumns({"_bx": F.floor(F.col(x) / s).cast("long"), "_by": F.floor(F.col(y) / s).cast("long")})
    met = placed.join(buckets, [*keys, "_bx", "_by"])
    near = F.array_min(F.transform("_centres", lambda c: F.struct((F.pow(F.col(x) - c["_cx"], 2) + F.pow(F.col(y) - c["_cy"], 2)).alias("d2"), c["_index"].alias("i"))))
    met = met.withColumn("_near", near).where(F.sqrt("_near.d2") <= s)
    return met.withColumns({index: F.col("_near.i"), "distance": F.sqrt("_near.d2")}).drop("_bx", "_by", "_centres", "_near")


def median_spacing(centres: DataFrame, *, x: str = "x", y: str = "y", reach: float, keys: Sequence[str] = ()) -> DataFrame:
    """``spacing``: the median distance from each centre to its nearest other one, of those within ``reach``.

    Centres that have no other within it are counted in ``n_alone`` and left out of the median. Centres at one place have
    distance 0.
    """
    keys = list(keys)
    near = _stored(nearest_others(centres, x=x, y=y, keys=keys), "near")  # read for both columns
    alone = near.groupBy(*keys).agg(F.sum(F.when(F.col("d") <= reach, 0).otherwise(F.col("n"))).alias("n_alone"))
    spacing = quantiles.weighted(near.where(F.col("d") <= reach), keys, "d", "n", {"spacing": 0.5}).drop("n")
    both = alone.join(spacing, keys, "left") if keys else alone.join(F.broadcast(spacing), F.lit(True), "left")  # one row each
    return both.select(*keys, "spacing", "n_alone")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that what it comes from is not computed by each step that reads it."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nearest_others(centres: DataFrame, *, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """``keys, d, n``: the distance from a place to the nearest other centre (0 if it has several, null if its key has but one),
    and its number of centres. Cells follow the centres' density (:mod:`varigrid.operators.nearest`). The centres, which may
    come from many more samples, are computed once."""
    places = _stored(centres.groupBy(*keys, F.col(x).alias("px"), F.col(y).alias("py")).agg(F.count(F.lit(1)).alias("n")), "places")
    own = nearest.flat(places, "px", "py", keys)
    met = nearest.nearest(own, own, nearest.PLANE, keys)
    others = F.filter("_items", lambda o: (o["px"] != F.col("px")) | (o["py"] != F.col("py")))
    d2 = F.array_min(F.transform(others, lambda o: F.pow(F.col("px") - o["px"], 2) + F.pow(F.col("py") - o["py"], 2)))
    return met.select(*keys, F.when(F.col("n") > 1, F.lit(0.0)).otherwise(F.sqrt(d2)).alias("d"), "n")


def granule_spacing(centres: DataFrame, keys: Sequence[str], *, x: str = "x", y: str = "y") -> DataFrame:
    """``keys, spacing``: the median, over a key's centres, of the distance to the nearest other one. A key of one centre has
    none. Spacings may differ by any factor from key to key and from region to region."""
    return quantiles.weighted(nearest_others(centres, x=x, y=y, keys=keys), keys, "d", "n", {"spacing": 0.5}).drop("n")


def bin_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``n, mean, std`` (of the population) of the finite values by ``keys``; std 0 for one sample."""
    v = finite(F.col(value))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def within_cv(mean: Column, std: Column) -> Column:
    """std / |mean|; null at mean 0."""
    return ratio(std, F.abs(mean))


def water_fraction(df: DataFrame, keys: Sequence[str], water: str = "water", valid: str | None = None) -> DataFrame:
    """``n_water, n_valid, frac_water`` by ``keys``; null where nothing is valid."""
    is_valid = F.col(valid) if valid else F.lit(True)
    out = df.groupBy(*keys).agg(F.count_if(F.col(water) & is_valid).alias("n_water"), F.count_if(is_valid).alias("n_valid"))
    return out.withColumn("frac_water", ratio(F.col("n_water"), F.col("n_valid")))


def band_moments(df: DataFrame, keys: Sequence[str], bands: Mapping[float, str], low: float = float("-inf"), high: float = float("inf")) -> DataFrame:
    """Long moments: ``band, n, mean, std`` by ``keys`` for the bands from ``low`` to ``high`` nm, ends included.

    Bands stay rows, so the aggregate keeps a few columns whatever their number.
    """
    pairs = [F.struct(F.lit(float(nm)).alias("band"), finite(F.col(c)).alias("v")) for nm, c in sorted(bands.items()) if low <= nm <= high]
    long = df.select(*keys, F.explode(F.array(*pairs)).alias("b")).select(*keys, "b.band", "b.v")
    return long.groupBy(*keys, "band").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def array_moments(df: DataFrame, keys: Sequence[str], spectrum: str, bands: Sequence[float], low: float = float("-inf"), high: float = float("inf")) -> DataFrame:
    """:func:`band_moments` for a spectrum kept as an array column, in the order of ``bands``."""
    chosen = [(i, float(nm)) for i, nm in enumerate(bands) if low <= nm <= high]
    pairs = [F.struct(F.lit(nm).alias("band"), finite(F.get(F.col(spectrum), i)).alias("v")) for i, nm in chosen]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("b")).select(*keys, "b.*").groupBy(*keys, "band").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def aggregate_scene(pixels: DataFrame, keys: Sequence[str], bands: Mapping[float, str], ratios: Mapping[str, tuple[str, str]], water: str = "water") -> DataFrame:
    """A row per coarse cell with water: counts, ``rrs_mean_<nm>``/``rrs_std_<nm>``, ``<ratio>_{mean,std,cv,n}``.

    Ratios are of samples, before the means. Samples are read once; counts, bands and ratios are aggregated long
    and turned wide at the end. A sample whose ``water`` is null counts as dry.
    """
    names = {f"{nm:.0f}": c for nm, c in bands.items()}
    values = [F.struct(F.lit(f"rrs_{n}").alias("what"), finite(F.col(c)).alias("v")) for n, c in names.items()]
    values += [F.struct(F.lit(n).alias("what"), finite(ratio(F.col(a), F.col(b))).alias("v")) for n, (a, b) in ratios.items()]
    px = lambda v: F.struct(F.lit("px").alias("what"), v.cast("double").alias("v"))  # noqa: E731  every sample counts, a dry one only here
    each = F.explode(F.when(F.col(water), F.array(*values, px(F.lit(1)))).otherwise(F.array(px(F.lit(None)))))
    long = pixels.select(*keys, each.alias("b")).select(*keys, "b.*").groupBy(*keys, "what").agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    pick = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))  # noqa: E731  one row each
    columns = [e for n in names for e in (pick(f"rrs_{n}", "mean").alias(f"rrs_mean_{n}"), pick(f"rrs_{n}", "std").alias(f"rrs_std_{n}"))]
    for n in ratios:
        columns += [pick(n, "mean").alias(f"{n}_mean"), pick(n, "std").alias(f"{n}_std"), within_cv(pick(n, "mean"), pick(n, "std")).alias(f"{n}_cv"), pick(n, "n").alias(f"{n}_n")]
    wide = long.groupBy(*keys).agg(pick("px", "n").alias("n_water"), pick("px", "rows").alias("n_valid"), ratio(pick("px", "n"), pick("px", "rows")).alias("frac_water"), *columns)
    return wide.where("n_water > 0")


def scene_ledger(frame: DataFrame, keys: Sequence[str] = (), usable: float = 0.9) -> DataFrame:
    """Counts of cells with water and usable ones, assigned samples, and the median samples of a usable cell."""
    good = F.col("frac_water") >= usable
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_coarse_with_water"), F.count_if(good).alias("n_coarse_usable"), F.sum("n_water").cast("long").alias("px_assigned"), F.coalesce(F.median(F.when(good, F.col("n_water"))), F.lit(0.0)).alias("median_px_per_coarse"))


def bucket_rank(df: DataFrame, bucket: Column, order: Sequence[Column], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``: ranks from 0 by bucket, then ``order``, with no window over all rows.

    Rows are ranked within their bucket; buckets are offset by running counts, a row for each bucket.
    """
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).drop("_n")
    ranked = marked.withColumn(name, F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    return ranked.join(before, [*keys, "_bucket"]).withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_before")
