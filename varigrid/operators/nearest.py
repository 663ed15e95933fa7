"""Nearest items, on the globe or in a plane, without meeting all of them: cells of points and of items descend together.

Cells halve the space level by level. Of a cell of points and a cell of items, the distance between the boxes about their
rows is a lower bound, and the far corner of the points' box from one of the items is an upper bound. A cell of points
keeps the cells of items whose lower bound is not above its least upper bound; once these hold few items together it is
done, or both sides go one level down. Cells are as small as their surroundings are dense, region by region. Only cells
meet cells: each point is shuffled once, to the few items that its cell kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varigrid.sources.fixtures import scratch

#: Items up to which a cell of points is done.
MET = 64


@dataclass(frozen=True)
class Space:
    """Axes, levels of halving, where cells begin and how wide the first is, and what rounding may take from a bound."""

    axes: str
    bits: int
    low: float
    wide: float
    slack: float

    def working(self) -> list[str]:
        return [f"_{p}{a}" for p in ("", "i") for a in self.axes]

    def code(self, level: int) -> Column:
        """The number of a row's cell at ``level``."""
        parts = [F.shiftright(f"_i{a}", self.bits - level).cast("long") for a in self.axes]
        return reduce(lambda high, low: F.shiftleft(high, self.bits) + low, parts)

    def parent(self, cell: Column) -> Column:
        """The number of a cell's parent."""
        parts = [F.shiftright(F.shiftright(cell, self.bits * k).bitwiseAND(F.lit((1 << self.bits) - 1)), 1) for k in reversed(range(len(self.axes)))]
        return reduce(lambda high, low: F.shiftleft(high, self.bits) + low, parts)

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``_x, _y, ...``) with the whole numbers of its finest cells, ``_ix, _iy, ...``."""
        top = F.lit((1 << self.bits) - 1)
        whole = lambda a: F.greatest(F.lit(0), F.least(top, F.floor((F.col(f"_{a}") - self.low) / self.wide * (1 << self.bits)).cast("int")))
        return df.withColumns({f"_i{a}": whole(a) for a in self.axes})


#: Unit vectors, so that neither poles nor the antimeridian are special: cells from the cube about the sphere down to 195 m,
#: distances are chords, and 1e-7 is 0.6 m. In a plane, a square about all rows of a key is the unit.
GLOBE, PLANE = Space("xyz", 16, -1.0, 2.0, 1e-7), Space("xy", 28, 0.0, 1.0, 1e-12)


def known(c: Column) -> Column:
    """Whether a coordinate is there and finite."""
    return F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))


def placed(df: DataFrame, lon: Column, lat: Column) -> DataFrame:
    """``df`` on the globe, ready for :func:`nearest`; rows without a finite position go."""
    u, v = F.radians(lon), F.radians(lat)
    return GLOBE.cut(df.where(known(lon) & known(lat)).withColumns({"_x": F.cos(v) * F.cos(u), "_y": F.cos(v) * F.sin(u), "_z": F.sin(v)}))


def flat(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """``df`` in a plane for each of ``keys``, ready for :func:`nearest`; rows without a finite position go."""
    own = df.where(known(F.col(x)) & known(F.col(y)))
    ends = own.groupBy(*keys).agg(F.min(x).alias("_x0"), F.min(y).alias("_y0"), F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("_side"))
    met = own.join(ends, list(keys)) if keys else own.join(F.broadcast(ends), F.lit(True))  # without keys one row
    side = F.when(F.col("_side") > 0, F.col("_side")).otherwise(1.0)
    return PLANE.cut(met.withColumns({"_x": (F.col(x) - F.col("_x0")) / side, "_y": (F.col(y) - F.col("_y0")) / side}).drop("_x0", "_y0", "_side"))


def candidates(points: DataFrame, items: DataFrame, space: Space = GLOBE, keys: Sequence[str] = (), met: int = MET, levels: int | None = None) -> tuple[DataFrame, int]:
    """``keys, _level, _q, _items``: cells of points, each point in one, with the rows of ``items`` that may be nearest to its
    points; and the deepest level.

    Both are from :func:`placed` or :func:`flat`; ``items`` also has ``_r``, how far an item may reach from its position. If
    both are the same table (of distinct positions), the nearest other item is meant. An array has ``met`` items at most,
    or those that cells of the finest level keep. Each level is written to the shared folder, so a lost executor repeats that
    level's tasks only; it ends with the first level at which all cells are done.
    """
    spark, axes, keys = points.sparkSession, space.axes, list(keys)
    levels = levels or space.bits
    base = scratch(spark)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    ends = [(a, k, f) for a in axes for k, f in (("0", F.min), ("1", F.max))]
    cells = stored(points.groupBy(*keys, *(f"_i{a}" for a in axes)).agg(*(f(f"_{a}").alias(f"_{a}{k}") for a, k, f in ends)), "cells")
    alike = items is points
    items = stored(items.withColumn("_r", F.lit(0.0)) if alike else items, "items")
    content = [c for c in items.columns if c not in {*space.working(), *keys}]
    one = F.min(F.struct(*(f"_{a}" for a in axes), "_r")).alias("_one")
    length = lambda side: F.sqrt(sum((side(a) * side(a) for a in axes), F.lit(0.0)))
    apart = length(lambda a: F.greatest(F.lit(0.0), F.col(f"_q{a}0") - F.col(f"_n{a}1"), F.col(f"_n{a}0") - F.col(f"_q{a}1"))) - F.col("_far")
    reach = length(lambda a: F.greatest(F.abs(F.col(f"_q{a}0") - F.col(f"_one._{a}")), F.abs(F.col(f"_q{a}1") - F.col(f"_one._{a}")))) + F.col("_one._r")
    if alike:  # of two items in one cell, either is within the box of the other
        inside = F.when(F.col("_k") > 1, length(lambda a: F.col(f"_q{a}1") - F.col(f"_q{a}0"))).otherwise(float("inf"))
        reach = F.when(F.col("_c") == F.col("_m"), inside).otherwise(reach)
    own = W.partitionBy(*keys, "_q")
    zero = F.lit(0).cast("long")
    rest = cells.select(*keys).distinct().select(*keys, zero.alias("_q"), zero.alias("_n")) if keys else spark.range(1).select(zero.alias("_q"), zero.alias("_n"))
    done: list[DataFrame] = []
    for level in range(1, levels + 1):
        ours = cells.groupBy(*keys, space.code(level).alias("_c")).agg(*(f(f"_{a}{k}").alias(f"_q{a}{k}") for a, k, f in ends)).withColumn("_q", space.parent(F.col("_c")))
        theirs = items.groupBy(*keys, space.code(level).alias("_m")).agg(*(f(f"_{a}").alias(f"_n{a}{k}") for a, k, f in ends), one, F.max("_r").alias("_far"), F.count(F.lit(1)).alias("_k")).withColumn("_n", space.parent(F.col("_m")))
        pairs = rest.join(ours, [*keys, "_q"]).join(theirs, [*keys, "_n"])
        bounds = pairs.select(*keys, F.col("_c").alias("_q"), F.col("_m").alias("_n"), "_k", apart.alias("_low"), reach.alias("_high"))
        kept = bounds.withColumn("_best", F.min("_high").over(own)).where(F.col("_low") <= F.col("_best") + space.slack)
        kept = kept.withColumn("_all", F.sum("_k").over(own)).select(*keys, "_q", "_n", (F.lit(level == levels) | (F.col("_all") <= met)).alias("_done"))
        if level > 2:  # the first levels have a few cells
            kept = stored(kept, f"level-{level}")
        ready, rest = kept.where("_done").drop("_done"), kept.where("not _done").drop("_done")
        rows = ready.join(items.select(*keys, space.code(level).alias("_n"), F.struct(*content).alias("_item")), [*keys, "_n"])
        done.append(rows.groupBy(*keys, F.lit(level).alias("_level"), "_q").agg(F.collect_list("_item").alias("_items")))
        if level > 2 and rest.isEmpty():
            break
    return reduce(DataFrame.unionByName, done), level


def nearest(points: DataFrame, items: DataFrame, space: Space = GLOBE, keys: Sequence[str] = (), met: int = MET, levels: int | None = None) -> DataFrame:
    """``points`` with ``_items``, the rows of ``items`` among which the nearest is (:func:`candidates`)."""
    found, deepest = candidates(points, items, space, keys, met, levels)
    number = reduce(lambda other, k: F.when(F.col("_level") == k, space.code(k)).otherwise(other), range(1, deepest + 1), F.lit(-1).cast("long"))
    dealt = points.withColumn("_level", F.explode(F.sequence(F.lit(1), F.lit(deepest)))).withColumn("_q", number)
    return dealt.join(found, [*keys, "_level", "_q"]).drop("_level", "_q", *space.working())
