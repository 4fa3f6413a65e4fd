"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import durable


def _mark(edges: DataFrame) -> tuple:
    """Count and two hashes of a set of pairs, to tell whether a round changed it."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that has a link; component is the smallest id reachable.

    Large-star steps hang each larger neighbour of a node on the smallest one,
    small-star steps do so with the smaller neighbours; both only keep a table of
    pairs and end, after about log rounds, in stars around the smallest ids. Each
    round is a partial aggregate and a join on the node id, so a hub's rows can be
    split; each round's table is durable. Empty links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = durable(edges)
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = durable(small.where("u <> v").distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    tops = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tops)
