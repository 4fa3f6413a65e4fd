"""A Bloom bitmap of bounded size, built by Spark and tested in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits in one row of a bitmap (Spark's bitmap_* functions use 4096 bytes).
ROW_BITS = 32768


def bits_for(rows: int, per_row: int = 16, least: int = 1 << 18, most: int = 1 << 28) -> int:
    """A power of two of about `per_row` bits a row; at most 32 MB by default."""
    bits = least
    while bits < min(rows * per_row, most):
        bits *= 2
    return bits


def positions(key: Column, bits: int, hashes: int = 2) -> list[Column]:
    """Bit numbers from 1 on, as the bitmap functions count them."""
    return [F.pmod(F.xxhash64(F.lit(k), key), F.lit(bits)) + 1 for k in range(hashes)]


def bitmap(set_bits: DataFrame, column: str) -> DataFrame:
    """(bucket, bitmap): one row of 4096 bytes for each 32768 bits with any bit set."""
    return set_bits.groupBy(F.bitmap_bucket_number(F.col(column)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(column))).alias("bitmap"))


def keep_possible(df: DataFrame, bits_set: DataFrame, key: Column, bits: int, hashes: int = 2) -> DataFrame:
    """Add boolean _maybe: whether all of the key's bits are set.

    The bitmap is at most bits / 8 bytes whatever the data, so it may be broadcast,
    as words of four bytes that a row's bits are looked up in.
    """
    probe = df
    hit = F.lit(True)
    words = F.expr("transform(sequence(0, 1023), i -> cast(conv(hex(substring(bitmap, i * 4 + 1, 4)), 16, 10) as bigint))")
    for k, position in enumerate(positions(key, bits, hashes)):
        side = F.broadcast(bits_set.select(F.col("bucket").alias(f"_b{k}"), words.alias(f"_m{k}")))
        probe = probe.withColumn(f"_p{k}", position).join(side, F.bitmap_bucket_number(F.col(f"_p{k}")) == F.col(f"_b{k}"), "left")
        at = f"bitmap_bit_position(_p{k})"  # bits of a byte count from its lowest one, bytes of a word from its highest
        hit = hit & F.coalesce(F.expr(f"(shiftright(_m{k}[cast({at} div 32 as int)], cast((3 - ({at} div 8) % 4) * 8 + {at} % 8 as int)) & 1) = 1"), F.lit(False))
    drop = [f"_{x}{k}" for x in "pbm" for k in range(hashes)]
    return probe.withColumn("_maybe", hit).drop(*drop)
