"""Binned moments and distinct entities over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.functions.nulls import finite


def stream_moments(samples: DataFrame, keys: Sequence[str], value: str, time: str | None = None, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``n, mean, std`` by ``keys`` and, with ``time``, by event-time window; state is a few sums a group.

    With ``time``, samples later than ``late`` behind the newest are dropped and windows close, so state stays
    bounded; without it the query runs in complete or update mode over a bounded set of cells.
    """
    v = finite(F.col(value))
    out = samples.withWatermark(time, late) if time else samples
    groups = [*keys, *([F.window(time, window).alias("window")] if time else [])]
    return out.groupBy(*groups).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def stream_distinct(points: DataFrame, keys: Sequence[str], id: str, time: str, late: str = "1 hour") -> DataFrame:
    """First sightings of each id in each group: ids are remembered within the watermark, repeats are dropped."""
    return points.withWatermark(time, late).dropDuplicatesWithinWatermark([*keys, id]).select(*keys, id, time)
