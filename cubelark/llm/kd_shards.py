"""Sharding by a k-d tree over document metadata.

A node is split along its widest dimension (its range against the whole table's)
at the weighted median, weights being bytes, until every leaf holds the target
bytes. All nodes of a level are split together. A dimension's value and a hash of
doc_id form one 62-bit coordinate, so that a value which many rows share, such as
a hot source, can be cut as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import durable, numbered

#: Bits of a coordinate that one pass of the median search settles, and the passes.
DIGIT, PASSES = 16, 4
_HALF = 1 << 31
#: Leaves of a tree at most; a row for each is kept by the driver and broadcast.
MOST_LEAVES = 1 << 18


def _code(value: Column) -> Column:
    """A category's place on its axis."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value), F.lit(_HALF)))


def _medians(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """(node, cut) so that the coordinates up to `cut` weigh as near as may be to the node's `want` bytes.

    Each pass sums bytes by the next 16 bits of the coordinate, within the prefix
    found so far, and settles the digit in which the wanted weight is reached.
    """
    state = splits.select("node", "want", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for p in range(PASSES):
        shift = DIGIT * (PASSES - 1 - p)
        own = rows.join(F.broadcast(state), "node")
        if p:  # a shift by all 64 bits would be none
            own = own.where(F.shiftrightunsigned("at", shift + DIGIT) == F.col("prefix"))
        sums = own.groupBy("node", "want", "prefix", "below", F.shiftrightunsigned("at", shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")).agg(F.sum("size").alias("bytes"))
        sums = sums.withColumn("upto", F.col("below") + F.expr("sum(bytes) over (partition by node order by digit)"))
        reached = F.struct(F.when(F.col("upto") >= F.col("want"), F.col("digit")).otherwise((1 << DIGIT) + 0 * F.col("digit")).alias("d"), "digit", "bytes", "upto")
        found = sums.groupBy("node", "want", "prefix").agg(F.min(reached).alias("r"))
        state = found.select("node", "want", (F.col("prefix") * (1 << DIGIT) + F.col("r.digit")).alias("prefix"), (F.col("r.upto") - F.col("r.bytes")).alias("below"), F.col("r.bytes").alias("bytes"))
        state = durable(state)  # one row a node
        last = state
        state = state.drop("bytes")
    over = (F.col("below") + F.col("bytes") - F.col("want")) > (F.col("want") - F.col("below"))
    return last.select("node", F.when(over, F.col("prefix") - 1).otherwise(F.col("prefix")).alias("cut"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    Leaves are numbered 0.. in tree order; give their number or the bytes of one.
    Dimensions are source, lang and the text's length in characters; missing
    columns and nulls count as one value. A place on the axes source and lang is a hash of the
    name, so their width tells only whether a node has one name or several. size is the text's UTF-8 bytes plus 1
    (null: 1). slot numbers a shard's rows from 0 by doc_id, ties in any order. The
    law is `bytes`: grown_shard is null. Each row is placed by itself: rows with equal texts are alike in
    size and text_crc32, and may be in different shards, as a group of copies may outweigh a
    shard. Rows that repeat a doc_id go together unless they differ on the axes; null doc_ids come first. A leaf may stay
    empty when single rows outweigh it; an empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = set(docs.columns)
    dims = [_code(F.col(c)) if c in names else F.lit(0) for c in ("source", "lang")] + [F.least(F.length(text).cast("long"), F.lit(_HALF - 1))]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(_HALF)).alias("tie"), *(d.cast("long").alias(f"d{i}") for i, d in enumerate(dims)), F.lit(1).cast("long").alias("node"),
    )
    rows = durable(rows)
    low = [F.min(f"d{i}").alias(f"lo{i}") for i in range(3)] + [F.max(f"d{i}").alias(f"hi{i}") for i in range(3)]
    whole = rows.agg(F.sum("size").alias("bytes"), *low).first()
    total = whole["bytes"] or 0
    leaves = shards or max(1, round(total / target_bytes))
    ranges = [max(1, (whole[f"hi{i}"] or 0) - (whole[f"lo{i}"] or 0)) for i in range(3)]
    if leaves > MOST_LEAVES:
        raise ValueError(f"{leaves} leaves; a tree has at most {MOST_LEAVES}")
    spark, quota = docs.sparkSession, {1: leaves}
    for _ in range(math.ceil(math.log2(leaves)) if leaves > 1 else 0):
        open_nodes = {n: k for n, k in quota.items() if k > 1}
        parts = spark.createDataFrame(list(open_nodes.items()), "node long, leaves long")  # at most one row a leaf
        stats = rows.join(F.broadcast(parts), "node").groupBy("node", "leaves").agg(F.sum("size").alias("bytes"), *low)
        width = [(F.col(f"hi{i}") - F.col(f"lo{i}")) / ranges[i] for i in range(3)]
        axis = F.when((width[0] >= width[1]) & (width[0] >= width[2]), 0).when(width[1] >= width[2], 1).otherwise(2)
        splits = durable(stats.select("node", axis.alias("axis"), F.floor(F.col("bytes") * F.expr("leaves div 2") / F.col("leaves")).alias("want")))
        chosen = rows.join(F.broadcast(splits.select("node", "axis")), "node", "left")
        at = F.when(F.col("axis") == 0, F.col("d0")).when(F.col("axis") == 1, F.col("d1")).otherwise(F.col("d2")) * _HALF + F.col("tie")
        cuts = _medians(chosen.where("axis is not null").withColumn("at", at).select("node", "at", "size"), splits)
        child = F.when(F.col("axis").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(at > F.col("cut"), 1).otherwise(0))
        rows = chosen.join(F.broadcast(cuts), "node", "left").withColumn("node", child).drop("axis", "cut")
        quota = {n: k for n, k in quota.items() if k == 1} | {2 * n + side: (k - k // 2 if side else k // 2) for n, k in open_nodes.items() for side in (0, 1)}
    order = sorted(quota, key=lambda n: bin(n)[3:])
    names = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "node long, shard int")
    placed = rows.join(F.broadcast(names), "node").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard")
    out = numbered(placed, ["shard", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
