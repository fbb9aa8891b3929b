"""Missing values: NULL throughout, never NaN, and comparisons that are false where a side is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing_as_null(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def differs(a: Column, b: Column) -> Column:
    """a != b, true where a side is missing."""
    return F.coalesce(a != b, F.lit(True))
