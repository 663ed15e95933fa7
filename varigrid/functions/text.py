"""Small text functions of the ledger and the index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_token(x: Column) -> Column:
    """The first word of a text; null for a null or blank text."""
    return F.nullif(F.regexp_extract(x, r"^\s*(\S+)", 1), F.lit(""))


def squeezed(x: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def flag_contains(x: Column, part: str) -> Column:
    """Whether a text holds ``part``; false for null."""
    return F.coalesce(x.contains(part), F.lit(False))
