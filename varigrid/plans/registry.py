"""Where the queries of all families and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.sources.fixtures import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, fx: Sequence[str] = (), ctes_: str = "", recursive: bool = False):
    """Registers ``f(t)``, where ``t(name)`` is a view; ``sql`` runs after the views ``fx`` and the expressions ``ctes_``."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))
        if sql:
            head = ",\n".join(x for x in (ctes(*fx), ctes_) if x)
            ORACLE[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{head}\n{sql}" if head else sql
        return f

    return add


def rounded(digits: int, *columns: str) -> list[Column]:
    return [F.round(F.col(c), digits).alias(c) for c in columns]


def as_rrs(digits: int, *columns: str) -> list[Column]:
    """Reflectances over pi, rounded: the tables' values have few decimals, so their own means often end in a tie."""
    return [F.round(F.col(c) / F.pi(), digits).alias(c) for c in columns]
