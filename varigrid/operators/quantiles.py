"""Exact percentiles over any number of rows: a sketch proposes, counts decide."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varigrid.functions.nulls import finite
from varigrid.sources.fixtures import scratch

#: A sketch's rank error is one in so many; about four in so many rows of a key are looked at by value for each share.
ACCURACY = 2000
#: Rows by value up to which they are ranked by key; more are ranked by value range, so that no task holds a key's.
RANKED = 200_000


def _ends(value: Column, shares: Sequence[float], accuracy: int) -> Column:
    """Values below and above each share's rank, from a mergeable sketch."""
    places = [min(1.0, max(0.0, s + d / accuracy)) for s in shares for d in (-2, 2)]
    return F.percentile_approx(value, F.array(*map(F.lit, places)), F.lit(accuracy))


def of_columns(df: DataFrame, columns: Mapping[str, str], name: str, shares: Mapping[str, float], keys: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """:func:`percentiles` of the finite values of several columns: a row for each of ``columns``, named in column ``name``."""
    keys, names = list(keys), list(columns)
    wide = df.select(*keys, *(finite(F.col(c)).cast("double").alias(f"_{i}") for i, c in enumerate(columns.values())))
    told = wide.groupBy(*keys).agg(*(F.struct(F.count(f"_{i}").alias("n"), _ends(F.col(f"_{i}"), list(shares.values()), accuracy).alias("ends")).alias(f"_{i}") for i in range(len(names))))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("_i"), F.col(f"_{i}.n").alias("_n"), F.col(f"_{i}.ends").alias("_ends")) for i in range(len(names))))).alias("e")
    limits = told.select(*keys, each).select(*keys, "e.*").where("_n > 0")
    long = wide.select(*keys, F.posexplode(F.array(*(F.col(f"_{i}") for i in range(len(names))))).alias("_i", "_v")).where("_v is not null")
    label = F.element_at(F.array(*map(F.lit, names)), F.col("_i") + 1)
    return _selected(long, [*keys, "_i"], shares, limits).withColumn(name, label).select(*keys, name, "n", *shares)


def percentiles(long: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """``n`` and a column for each of ``shares`` (its name and a number from 0 to 1), by ``keys``.

    Values are finite doubles; nulls don't count, and a key without values has no row. A percentile lies at
    ``share * (n - 1)`` between the two values of the ranks beside it, as in exact linear interpolation. A sketch by key gives
    two ends about each rank. Rows outside are counted, and those between are counted by distinct value: a few thousandths of
    the rows, however far apart the values lie, and equal values are one. The counts tell whether the ends hold the rank; if
    not (a sketch promises, it is not trusted), the key's rows are all counted by value. Rows are read twice and reduced
    before each exchange; ranks come from value ranges, so no task holds a key's values.
    """
    keys = list(keys)
    some = long.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    limits = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), _ends(F.col("_v"), list(shares.values()), accuracy).alias("_ends")).where("_n > 0")
    return _selected(some, keys, shares, limits).select(*keys, "n", *shares)


def _selected(long: DataFrame, keys: list[str], shares: Mapping[str, float], limits: DataFrame) -> DataFrame:
    """``keys, n`` and the shares of ``long`` (``keys, _v``), given ``keys, _n, _ends``."""
    spark, base = long.sparkSession, scratch(long.sparkSession)

    def stored(df: DataFrame, name: str) -> DataFrame:  # a table's size is known, so the optimizer chooses how to join it
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    limits = stored(limits, "limits")
    found = _placed(long, keys, shares, limits, lambda df: stored(df, "values"), lambda df: stored(df, "ranges"))
    missed = found.where("not _sure")
    if not missed.isEmpty():  # the sketch's ends do not hold a rank
        every = F.array(*(F.lit(e) for _ in shares for e in (float("-inf"), float("inf"))))
        held = stored(missed.select(*keys).distinct(), "missed") if keys else None
        of = lambda df, how: df if held is None else df.join(held, keys, how)
        more = _placed(of(long, "left_semi"), keys, shares, of(limits, "left_semi").withColumn("_ends", every), lambda df: stored(df, "all-values"), lambda df: stored(df, "all-ranges"))
        found = more.unionByName(of(found, "left_anti")) if keys else more
    return _wide(found, keys, shares)


def _placed(long: DataFrame, keys: list[str], shares: Mapping[str, float], limits: DataFrame, values_in, ranges_in) -> DataFrame:
    """``keys, _s`` (the share's number), ``_n, _low, _high`` (values of the ranks beside it), ``_part`` between them, ``_sure``."""
    met = long.join(limits, keys) if keys else long.join(F.broadcast(limits), F.lit(True))  # without keys one row
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("_s"), F.col("_ends")[2 * s].alias("a"), F.col("_ends")[2 * s + 1].alias("b")) for s in range(len(shares))))).alias("e")
    sided = met.select(*keys, "_v", each).withColumn("_side", F.when(F.col("_v") < F.col("e.a"), -1).when(F.col("_v") > F.col("e.b"), 1).otherwise(0))
    counts = sided.groupBy(*keys, F.col("e._s").alias("_s"), "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_at")).agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    return _ranked(values_in(counts), keys, shares, limits, ranges_in)


def weighted(df: DataFrame, keys: Sequence[str], value: str, weight: str, shares: Mapping[str, float]) -> DataFrame:
    """:func:`percentiles` of rows that count ``weight`` times each; distinct values are ranked by value range."""
    spark, base, keys = df.sparkSession, scratch(df.sparkSession), list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_at")).agg(F.sum(weight).alias("_k"))
    every = F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1)))
    counts.select(*keys, every.alias("_s"), F.lit(0).alias("_side"), "_at", "_k", F.col("_at").alias("_least"), F.col("_at").alias("_most")).write.parquet(f"{base}/values")
    stored = spark.read.parquet(f"{base}/values")
    limits = stored.where("_s = 0").groupBy(*keys).agg(F.sum("_k").alias("_n")).where("_n > 0")

    def ranges_in(ranges: DataFrame) -> DataFrame:
        ranges.write.parquet(f"{base}/ranges")
        return spark.read.schema(ranges.schema).parquet(f"{base}/ranges")

    return _wide(_ranked(stored, keys, shares, limits, ranges_in), keys, shares).select(*keys, "n", *shares)


def _wide(found: DataFrame, keys: list[str], shares: Mapping[str, float]) -> DataFrame:
    value = lambda s: F.max(F.when(F.col("_s") == s, F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")))
    return found.groupBy(*keys).agg(F.max("_n").alias("n"), *(value(s).alias(name) for s, name in enumerate(shares)))


def _ranked(counts: DataFrame, keys: list[str], shares: Mapping[str, float], limits: DataFrame, ranges_in) -> DataFrame:
    """:func:`_placed`, from counts by value."""
    own = [*keys, "_s"]
    if counts.count() > RANKED:
        ranges = ranges_in(counts.repartitionByRange(*own, "_side", "_at").withColumn("_range", F.spark_partition_id()))
        sizes = ranges.groupBy(*own, "_range").agg(F.sum("_k").alias("_all"))  # a row a key and range that holds it
        before = sizes.withColumn("_before", F.sum("_all").over(W.partitionBy(*own).orderBy("_range")) - F.col("_all")).drop("_all")
        ranked = ranges.join(before, [*own, "_range"]).withColumn("_to", F.col("_before") + F.sum("_k").over(W.partitionBy(*own, "_range").orderBy("_side", "_at")))
    else:
        ranked = counts.withColumn("_to", F.sum("_k").over(W.partitionBy(*own).orderBy("_side", "_at")))
    ranked = ranked.join(limits.select(*keys, "_n"), keys) if keys else ranked.join(F.broadcast(limits.select("_n")), F.lit(True))
    share = F.element_at(F.array(*(F.lit(float(s)) for s in shares.values())), F.col("_s") + 1)
    place, first = share * (F.col("_n") - 1), F.col("_to") - F.col("_k")
    rank = {"_low": F.floor(place), "_high": F.ceil(place)}
    holds = {c: (r >= first) & (r < F.col("_to")) for c, r in rank.items()}
    sure = {c: (F.col("_side") == 0) | ((F.col("_side") < 0) & (r == F.col("_to") - 1)) | ((F.col("_side") > 0) & (r == first)) for c, r in rank.items()}
    value = F.when(F.col("_side") < 0, F.col("_most")).otherwise(F.col("_least"))
    beside = ranked.where(holds["_low"] | holds["_high"]).groupBy(*own).agg(
        F.max("_n").alias("_n"), *(F.max(F.when(holds[c], value)).alias(c) for c in rank), F.max(place - F.floor(place)).alias("_part"),
        F.min(F.when(holds["_low"], sure["_low"]).otherwise(True) & F.when(holds["_high"], sure["_high"]).otherwise(True)).alias("_sure"),
    )
    return beside
