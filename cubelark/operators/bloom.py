"""Bloom-filter semi-join reduction.

The filter is a bit vector of fixed length over a linear hash of the key; vectors
of parts of the data are combined by OR. It has no false negatives, so the exact
join that follows decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the hash: factor, summand, and the default number of bits (a prime); other primes in use are 11447 and 31567.
FACTOR, SUMMAND, BITS = 107, 1009, 99881
#: Bits for each key that a join's vector holds, and the most bits of a vector (16 MB), which bounds what is broadcast.
KEY_BITS, MOST_BITS = 16, 1 << 27


def bloom_hash(key: Column, bits: int = BITS) -> Column:
    return F.pmod(key.cast("long") * FACTOR + SUMMAND, F.lit(bits))


def build_bits(df: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """(bucket, bitmap): at most one row of 4096 bytes for each 32768 bits; null keys set no bit."""
    h = bloom_hash(F.col(key), bits) + 1  # bitmap positions count from 1
    return df.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(h).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bitmap"))


def or_bits(*vectors: DataFrame) -> DataFrame:
    """The OR of vectors with the same number of bits."""
    out = vectors[0]
    for v in vectors[1:]:
        out = out.unionByName(v)
    return out.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bits_set(vector: DataFrame) -> DataFrame:
    return vector.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("long").alias("bits_set"))


def probe(df: DataFrame, key: str, vector: DataFrame, bits: int = BITS, where: Column | None = None) -> DataFrame:
    """Rows whose key's bit is set and, if given, that satisfy `where`.

    The vector is at most bits / 8 bytes (12 KB by default), so it is broadcast, as
    words of four bytes that a row's bit is looked up in without copying.
    """
    df = df if where is None else df.filter(where)
    h = bloom_hash(F.col(key), bits) + 1
    marked = df.withColumn("_bucket", F.bitmap_bucket_number(h)).withColumn("_bit", F.bitmap_bit_position(h))
    words = F.expr("transform(sequence(0, 1023), i -> cast(conv(hex(substring(bitmap, i * 4 + 1, 4)), 16, 10) as bigint))")
    held = F.broadcast(vector.select(F.col("bucket").alias("_b"), words.alias("_w")))
    # Bits of a byte are counted from its lowest one, bytes of a word from its highest.
    hit = F.expr("(shiftright(_w[cast(_bit div 32 as int)], cast((3 - (_bit div 8) % 4) * 8 + _bit % 8 as int)) & 1) = 1")
    return marked.join(held, (F.col("_bucket") == F.col("_b")) & hit, "left_semi").drop("_bucket", "_bit")


def bits_for(keys: int) -> int:
    """The least prime of KEY_BITS bits a key, neither below BITS nor above MOST_BITS."""
    n = min(max(BITS, keys * KEY_BITS) | 1, MOST_BITS - 1)
    while any(n % d == 0 for d in range(3, math.isqrt(n) + 1, 2)):
        n += 2 if n < MOST_BITS - 1000 else -2
    return n


def _kept(vector: DataFrame) -> DataFrame:
    """The vector computed now, as rows of the driver: at most MOST_BITS / 8 bytes."""
    return vector.sparkSession.createDataFrame(vector.collect(), vector.schema)


def bloom_join(big: DataFrame, big_key: str, small: DataFrame, small_key: str, bits: int | None = None, where: Column | None = None) -> DataFrame:
    """Inner join; `big` is first reduced to the rows that may have a partner in `small`, where it is scanned.

    The vector comes from the filtered `small` side. Without `bits`, one of the default
    length is tried first; if more than an eighth of its bits are set, the keys are counted
    and a longer one is made. With more keys than the longest vector can tell apart it
    lets more through, and the join decides all the same.
    """
    small = small if where is None else small.filter(where)
    vector = _kept(build_bits(small, small_key, bits or BITS))
    if not bits:
        bits = BITS
        if 8 * bits_set(vector).first()[0] > BITS:
            bits = bits_for(small.count())
            vector = _kept(build_bits(small, small_key, bits))
    return probe(big, big_key, vector, bits).join(small, F.col(big_key) == F.col(small_key))
