"""Text expressions shared by queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(text: Column) -> Column:
    """Characters of a text; null for null."""
    return F.char_length(text).cast("long")


def insert(text: Column, at: int, count: int, new: str) -> Column:
    """`text` with `count` characters from place `at` (1 is the first) replaced by `new`; unchanged if the place is outside."""
    inside = (F.lit(at) >= 1) & (F.lit(at) <= F.char_length(text))
    return F.when(inside, F.overlay(text, F.lit(new), F.lit(at), F.lit(count))).otherwise(text)
