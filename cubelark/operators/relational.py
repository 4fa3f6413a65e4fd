"""Projection, joins and grouping over DataFrames; Catalyst plans them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """The named columns, renamed with a prefix; an unknown name is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select([F.col(c).alias(prefix + c) for c in columns])


def join(
    left: DataFrame, right: DataFrame, key: str, left_columns: list[str], right_columns: list[str],
    left_filter: Column | None = None, right_filter: Column | None = None, left_prefix: str = "", right_prefix: str = "", strategy: str = "auto",
) -> DataFrame:
    """Inner equi-join on one column of both sides, filtered and projected before it.

    Output is the left projection, then the right one; the key only if projected.
    `auto` leaves the choice to the optimizer and the session's broadcast limit;
    `merge` forces a repartition join. `broadcast` is for a side that the caller
    has checked to be small: the right one.
    """
    left = left if left_filter is None else left.filter(left_filter)
    right = right if right_filter is None else right.filter(right_filter)
    a = left.select(F.col(key).alias("_key"), *[F.col(c).alias(left_prefix + c) for c in left_columns])
    b = right.select(F.col(key).alias("_right_key"), *[F.col(c).alias(right_prefix + c) for c in right_columns])
    if strategy == "broadcast":
        b = F.broadcast(b)
    elif strategy == "merge":
        a = a.hint("merge")
    elif strategy != "auto":
        raise ValueError(f"no such strategy: {strategy}")
    return a.join(b, F.col("_key") == F.col("_right_key")).drop("_key", "_right_key")


def volume(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """price * (1 - discount) in exact decimals."""
    money = "decimal(15,2)"
    return F.col(price).cast(money) * (F.lit(1).cast(money) - F.col(discount).cast(money))


def group_sum(df: DataFrame, keys: list[Column | str], value: Column, name: str, where: Column | None = None) -> DataFrame:
    """Sum by any keys; partial sums are combined before the shuffle."""
    df = df if where is None else df.filter(where)
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def with_labels(df: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """Left-join a lookup table; rows without a label stay."""
    return df.join(labels, on, "left")


def share(df: DataFrame, keys: list[Column | str], value: Column, where: Column, name: str) -> DataFrame:
    """The part of the keys' sum that comes from rows that satisfy a condition."""
    part = F.sum(F.when(where, value).otherwise(0)).cast("double") / F.sum(value).cast("double")
    return df.groupBy(*keys).agg(part.alias(name))
