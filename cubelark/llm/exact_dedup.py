"""Exact dedup in two Bloom passes: only possibly repeated hashes are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom_bits import bitmap, bits_for, keep_possible, positions
from .store import durable, join_hot, unused, written

#: Fixed value: the whitespace runs that count as one space.
WHITESPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null counts as empty; every whitespace run becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256.

    Pass 1 counts, for two hash functions, how many texts fall on each bit and
    makes a bitmap of the bits that took several; a hot text's rows are combined
    before they move. Pass 2 tests every fingerprint against that bitmap, which
    has at most 32 MB. A text whose bits were not both hit again occurs once: its
    row goes straight to the result. Only the others are shuffled and grouped by
    the whole SHA-256, so false positives cost time and change nothing.

    The row with the smallest doc_id of equal texts stays; of rows that repeat
    that doc_id all are marked kept, as they are one document. A row without doc_id
    is kept only if no equal text has one. Empty and null texts are equal. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    seen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    seen = durable(seen)
    bits = bits_for(seen.count())
    hits = seen.select(F.explode(F.array(*positions(F.col("text_sha256"), bits))).alias("p")).groupBy("p").count()
    marked = keep_possible(seen, bitmap(hits.where("count > 1"), "p"), F.col("text_sha256"), bits)
    alone = marked.where("not _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = written(marked.where("_maybe").drop("_maybe"))
    groups = written(maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).withColumn("n", F.col("group_size")))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    found = join_hot(maybe, groups, "text_sha256", "n").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    return alone.union(found)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns kept.

    Rows without doc_id all stay; rows that repeat a doc_id with other texts stay or go each by its own text.
    """
    own, sha = unused(docs, "own"), unused(docs, "sha")
    gone = duplicate_groups(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha)).distinct()
    return docs.join(gone, (F.col(id_col).cast("long") == F.col(own)) & (F.sha2(normalised(docs[text_col]), 256) == F.col(sha)), "left_anti")
