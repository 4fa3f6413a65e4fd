"""Vectorised text primitives shared by the Arrow-batch operators.

Texts stay UTF-8 bytes inside numpy arrays; no per-word Python object is made.
Whitespace is ``[\\x20\\x09-\\x0D]`` throughout.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text worked on at once. One longer text is still taken whole.
CHUNK_BYTES = 3 << 20
#: Words beyond this many bytes are hashed one by one instead of eight bytes a step.
LONG_WORD = 256

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64
_M1, _M2, _SEED = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_MASKS = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def settle() -> None:
    """Give freed memory back to the system, as Python workers live on into later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows with about `most` bytes of text each; settle after the last."""
    if not batch.num_rows:
        return
    _, offs = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    settle()


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 offsets of each text's words."""
    inside = np.zeros(len(buf) + 1, dtype=bool)
    inside[:-1] = ~SPACE[buf]
    before = np.zeros(len(buf) + 1, dtype=bool)
    before[1:] = inside[:-1]
    before[offs] = False  # a text begins a new word
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(buf) + 1, dtype=bool)
    after[:-1] = inside[1:]
    cut = offs[1:] - 1
    after[cut[cut >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    size = ends - starts
    h = mix(size.astype(np.uint64) + _SEED)
    if not len(size):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(buf) + 1,), strides=(1,))
    lanes = np.ndarray(len(buf) + 1, dtype=np.uint64, buffer=padded, strides=(1,))
    active = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    step = 0
    while len(active):
        left = size[active] - step
        piece = lanes[starts[active] + step] & _MASKS[np.minimum(left, 8)]
        h[active] = mix(h[active] ^ piece)
        step += 8
        active = active[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return h


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenate the ranges [start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def shingle_hashes(words: np.ndarray, offs: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles in order, and their offsets.

    A text of fewer than n words has one shingle, its whole sequence; a text
    without words has none.
    """
    counts = np.diff(offs)
    many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = ragged(offs[:-1], many)
    length = np.repeat(np.minimum(counts, n), many).astype(np.uint64)
    out = length * _M2
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        part = padded[first + k] * _U((0x9E3779B97F4A7C15 * (2 * k + 1) + 2 * k) % (1 << 64) | 1)
        if k:
            part[length <= k] = 0
        out += part ^ (part >> _U(29))
    return mix(out), np.concatenate([[0], np.cumsum(many)])
