"""From raw documents to token ids: five stages, each on all its predecessor kept.

Every stage but the last gives back the columns it got, whatever others there are
beside doc_id and text, and takes an empty table to an empty one. No stage needs doc_id to be a
key: repeated rows are treated alike, and rows without one are decided by their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.llm.decontaminate import decontaminate
from cubelark.llm.line_templates import drop_recurring_lines
from cubelark.llm.ngram_join import near_duplicate_filter
from cubelark.llm.quality_crf import quality_filter, train
from cubelark.llm.queries import tokenizer_file
from cubelark.llm.sentencepiece_viterbi import encode_documents, read_model
from cubelark.llm.store import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores below its threshold go.

    The model is fitted on the labelled rows of the stage's own input, without the held-out fold.
    Null and empty texts score 0 and go.
    """
    return quality_filter(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of recurring lines go; documents of nothing else go with them.

    The first of equal lines stays, by doc_id. A text that had no words before, null included,
    stays as it is. n_chars follows the new text.
    """
    out = drop_recurring_lines(docs).where((F.col("_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.col("_dropped") > 0
    columns = [F.when(changed, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; texts without words are in no group."""
    return near_duplicate_filter(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts, and items, hold and are none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and SentencePiece ids of every document; none for null and empty texts."""
    return encode_documents(docs, read_model(tokenizer_file("piece_bpe_32k.model")))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The classifier, the alignment and the tokenizer have no SQL form; tests/llm hold `run` against a plain Python chain of the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
