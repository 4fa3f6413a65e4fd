"""Token files in Simple-8b.

Ids go into 64-bit words: four bits of selector, sixty of data. A selector says
how many values of how many bits a word packs; the widest count whose values all
fit is taken. A value of more than 60 bits is escaped: selector 0, then a word
that is the value. A document's ids are cut into blocks of 128, each beginning in
a word of its own; the file stores where, so all blocks are decoded side by side.

A token file is a Parquet folder, so that any store Spark writes to can hold it
and a lost executor leaves no half-written part. One row is a segment: a run of
whole documents in ascending doc_id order (`part`, then `seq`), with their ids and
counts of ids, the blocks' first words and the packed words.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .store import durable, fresh_path

#: Fixed values of Simple-8b: values and bits a word by selector; 0 escapes one wide value.
COUNTS = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Values of a block.
BLOCK = 128
#: Distinct words whose ids a Python worker keeps (about 40 bytes each); beyond it starts anew.
CACHE_WORDS = 1_200_000
BATCH_BYTES = 3 << 20
_U = np.uint64
_SELECTOR = np.zeros(61, np.uint8)
_SELECTOR[COUNTS[2:]] = np.arange(2, 16)
_WIDTH16 = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def widths(values: np.ndarray) -> np.ndarray:
    if len(values) and int(values.max()) < 1 << 16:
        return _WIDTH16[values.astype(np.int64)]
    return np.searchsorted(np.array([1 << k for k in range(64)], _U), values, "right").astype(np.uint8)


def block_sizes(counts: np.ndarray) -> np.ndarray:
    """Values of each block of texts with so many values."""
    blocks = -(-counts // BLOCK)
    sizes = np.full(int(blocks.sum()), BLOCK, np.int64)
    some = counts > 0
    sizes[np.cumsum(blocks)[some] - 1] = (counts - (blocks - 1) * BLOCK)[some]
    return sizes


def pack(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of consecutive blocks with those sizes, and the n + 1 offsets of each block's words."""
    n = len(sizes)
    if not n:
        return np.zeros(0, _U), np.zeros(1, np.int64)
    table = np.zeros((n, BLOCK + 60), _U)
    first = np.cumsum(sizes) - sizes
    row, col = np.repeat(np.arange(n), sizes), np.arange(len(values)) - np.repeat(first, sizes)
    table[row, col] = values
    wide = np.zeros((n, BLOCK + 60), np.uint8)
    wide[row, col] = widths(values)
    top, best = {1: wide}, np.ones((n, BLOCK), np.uint8)
    for c, bits in zip(COUNTS[14:1:-1].tolist(), BITS[14:1:-1].tolist(), strict=True):
        half = max(k for k in top if 2 * k >= c and k < c)
        over = top[half]
        span = over.shape[1] - (c - half)
        top[c] = np.maximum(over[:, :span], over[:, c - half :][:, :span])
        np.copyto(best, np.uint8(c), where=top[c][:, :BLOCK] <= bits)
    escape = wide[:, :BLOCK] > 60
    at, word = np.zeros(n, np.int64), np.zeros(n, np.int64)
    lanes = np.arange(n)
    log = []
    while len(lanes):
        pos = at[lanes]
        count = best[lanes, pos]
        log.append((lanes, pos, count, word[lanes].copy(), escape[lanes, pos]))
        at[lanes] += count
        word[lanes] += 1 + log[-1][4]
        lanes = lanes[at[lanes] < sizes[lanes]]
    lane, pos, count, index, raw = (np.concatenate([x[i] for x in log]) for i in range(5))
    offs = np.concatenate([[0], np.cumsum(word)])
    out = np.zeros(offs[-1], _U)
    to = offs[lane] + index
    for c in np.unique(count).tolist():
        s = int(_SELECTOR[c])
        i = np.flatnonzero((count == c) & ~raw)
        data = np.full(len(i), s << 60, _U)
        for k in range(c):
            data |= table[lane[i], pos[i] + k] << _U(k * int(BITS[s]))
        out[to[i]] = data
    i = np.flatnonzero(raw)
    out[to[i] + 1] = table[lane[i], pos[i]]
    return out, offs


def unpack(words: np.ndarray, offs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of consecutive blocks."""
    selector = (words >> _U(60)).astype(np.int64)
    count = COUNTS[selector]
    bits = BITS[selector]
    raw = _escaped(selector == 0, offs)
    if raw is not None:  # an escape's own word gives nothing, the next one is its value
        count = np.where(raw, 1, np.where(selector == 0, 0, count))
        bits = np.where(raw, 0, bits)
    which = np.repeat(np.arange(len(words)), count)
    ends = np.cumsum(count)
    k = np.arange(len(which)) - np.repeat(ends - count, count)
    mask = (_U(1) << bits.astype(_U)) - _U(1)
    if raw is not None:
        mask[raw] = ~_U(0)
    values = (words[which] >> (k * bits[which]).astype(_U)) & mask[which]
    starts = np.concatenate([[0], ends])[offs[:-1]]
    return values[tx.ragged(starts, sizes)]


def _escaped(zero: np.ndarray, offs: np.ndarray) -> np.ndarray | None:
    """Which words are escaped values; None if no word has selector 0.

    A word is a value if the one before it is an escape, which is a word with selector 0
    that is no value itself: so an odd number of such words must stand before it in its block.
    """
    if not zero.any():
        return None
    at = np.arange(len(zero))
    first = np.zeros(len(zero), bool)
    first[offs[:-1][np.diff(offs) > 0]] = True
    begin = np.ones(len(zero), bool)  # places where a run of such words may begin
    begin[1:] = ~zero[:-1] | first[1:]
    return (at - np.maximum.accumulate(np.where(begin, at, 0))) % 2 == 1


@lru_cache(maxsize=2)
def _tokenizer(data: bytes):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(data.decode())


class WordEncoder:
    """Ids of texts, by the library's ids of their distinct words.

    Right for tokenizers that drop white space before merging, as then no token
    spans two words; `tests/llm` holds it against encoding whole texts.
    """

    def __init__(self, tokenizer: bytes):
        self.lib = _tokenizer(tokenizer)
        self.clear()

    def clear(self) -> None:
        self.known, self.first, self.count, self.ids = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, words = tx.word_spans(buf, offs)
        h, first, which = np.unique(tx.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.clear()
        spot = np.searchsorted(self.known, h)
        new = np.ones(len(h), bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != h[inside]
        if new.any():
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            data = buf.tobytes()
            found = [e.ids for e in self.lib.encode_batch_fast([data[a:b].decode() for a, b in spans], add_special_tokens=False)]
            count = np.array([len(x) for x in found], np.int64)
            at = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, *[np.array(x, np.uint32) for x in found]]) if len(found) < 64 else np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(count.sum()))])
            to = spot[new]
            self.known, self.first, self.count = np.insert(self.known, to, h[new]), np.insert(self.first, to, at), np.insert(self.count, to, count)
        spot = np.searchsorted(self.known, h)[which]
        count = self.count[spot]
        total = np.concatenate([[0], np.cumsum(count)])
        return self.ids[tx.ragged(self.first[spot], count)], total[words]


_ENCODERS: dict[int, WordEncoder] = {}


def encoder_of(tokenizer: bytes) -> WordEncoder:
    """One encoder, and so one memory of words, for each Python worker and tokenizer."""
    key = zlib.crc32(tokenizer)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(tokenizer)
    return _ENCODERS[key]


SEGMENT = "part int, seq int, doc_ids array<long>, counts array<int>, blocks binary, words binary"


def _segment_rows(batches: Iterator[pa.RecordBatch], tokenizer: bytes, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, part, seq = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
    for whole in batches:
        for batch in tx.slices(whole, "text", BATCH_BYTES):
            ids, at = encoder(*tx.utf8(batch.column(1)))
            counts = np.diff(at) + 1
            full = np.insert(ids, at[1:], np.uint32(end_id))
            words, offs = pack(full.astype(_U), block_sizes(counts))
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([counts.astype(np.int32)]), pa.array([offs.astype("<u4").tobytes()], pa.binary()), pa.array([words.astype("<u8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "seq", "doc_ids", "counts", "blocks", "words"])
            seq += 1


def write_tokens(docs: DataFrame, tokenizer: bytes, path: str, end_id: int, partitions: int | None = None) -> None:
    """Encode every document, append end_id, and write a token file in ascending doc_id order.

    Null and empty texts have the end id alone. Null doc_ids come first; rows that
    repeat a doc_id are in order of their texts, and equal rows follow each other. An empty
    table gives a file without segments. Other columns are ignored. Texts are
    range-partitioned on doc_id once, as they are smaller than their ids; tokens are
    written by the tasks that make them.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = own.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(partial(_segment_rows, tokenizer=tokenizer, end_id=end_id), SEGMENT).write.parquet(path)


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[int], np.ndarray, np.ndarray]]:
    for row in batch.to_pylist():
        counts = np.array(row["counts"], np.int64)
        ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["blocks"], "<u4").astype(np.int64), block_sizes(counts))
        yield row["part"], row["seq"], row["doc_ids"], counts, ids.astype("<u4")


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))
    for batch in batches:
        for part, seq, doc_ids, counts, ids in _segments(batch):
            at = np.concatenate([[0], np.cumsum(counts)])
            docs = [{"doc_id": d, "inside": int(a), "n_tokens": int(b - a), "ids_crc32": zlib.crc32(ids[a:b])} for d, a, b in zip(doc_ids, at[:-1], at[1:], strict=True)]
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(at[-1])]), pa.array([docs], kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "seq", "total", "docs"])


def _id_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, doc_ids, counts, ids in _segments(batch):
            at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int64)))], names=["doc_id", "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids of every document of a token file, a row for each that was written."""
    return spark.read.parquet(path).mapInArrow(_id_rows, "doc_id long, ids array<long>")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the file.

    A running sum over segments inside each part, and over the parts' totals (one
    row a part), replaces a global order.
    """
    row = "part int, seq int, total long, docs array<struct<doc_id:long,inside:long,n_tokens:long,ids_crc32:long>>"
    segments = durable(spark.read.parquet(path).mapInArrow(_digest_rows, row))
    parts, before = segments.groupBy("part").agg(F.sum("total").alias("total")).orderBy("part").collect(), 0
    firsts = []
    for part, total in parts:
        firsts.append((part, before))
        before += total
    firsts = spark.createDataFrame(firsts, "part int, first long")
    inside = F.expr("coalesce(sum(total) over (partition by part order by seq rows between unbounded preceding and 1 preceding), 0)")
    out = segments.withColumn("before", inside).join(F.broadcast(firsts), "part")
    out = out.select((F.col("before") + F.col("first")).alias("at"), F.inline("docs"))
    return out.select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_index(docs: DataFrame, tokenizer: bytes, end_id: int = 2) -> DataFrame:
    """Write a token file to the shared folder and read its index back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, end_id)
    return token_index(docs.sparkSession, path)
