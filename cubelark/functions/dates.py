"""Scalar expressions shared by queries and the cube."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year(d: Column) -> Column:
    return F.year(d.cast("date")).cast("long")


def year_month(d: Column) -> Column:
    """yyyymm as an integer."""
    d = d.cast("date")
    return (F.year(d) * 100 + F.month(d)).cast("int")


def year_prefix(d: Column) -> Column:
    """The first four characters of a date as text, as an integer."""
    return F.substring(d.cast("string"), 1, 4).cast("int")


def recode(value: Column, default: object, **cases: object) -> Column:
    """DECODE: the result for the matching case, else the default."""
    out = F.lit(default)
    for match, result in reversed(cases.items()):
        out = F.when(value == F.lit(match), F.lit(result)).otherwise(out)
    return out
