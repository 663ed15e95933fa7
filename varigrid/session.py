"""Sessions with the settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC timestamps, ANSI arithmetic, and plans that adapt to what the shuffles show.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "varigrid", **settings: str) -> SparkSession:
    """The active session or a new one; ``settings`` (dots as double underscores) go before the defaults."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
