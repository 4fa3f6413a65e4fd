"""Benchmark decontamination by the q-gram lemma over diagonal bands.

Texts and benchmark items are compared as bytes of their lower-case letters and
digits, every other run being one space. An item is cut into overlapping
segments. A segment of L bytes occurs in a text when some region of the text is
within edit distance e of it, e being L * error.

Each edit destroys at most q of the segment's L - q + 1 q-grams, so such a region
shares at least L - q + 1 - q * e of them with the segment, all on diagonals
(position in the text minus position in the segment) at most e apart. Shared
q-grams are counted in bands of 2 (e + 1) diagonals that overlap by half; bands
that reach the bound are verified by banded alignment.

Items too short for the bound to tell a region from chance are looked for as they
are, between word edges, by an Aho-Corasick automaton.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Bytes of a q-gram: one machine word.
Q = 8
#: Bytes of a segment, and its share of edits.
SEGMENT, ERROR = 96, 0.08
#: Items with fewer bytes than this after normalising occur only unedited, as whole words.
SHORTEST = 32
#: Segments whose q-grams one pass holds in memory (about 40 MB); more take more passes. Below 2^20, as band numbers hold them.
PASS_SEGMENTS = 20_000
#: Positions of a text whose q-grams are looked up at once.
STEP = 1 << 22
_BITS = 22
_CELLS = 40
_MULT = np.uint64(0x9E3779B97F4A7C15)

_KEEP = np.zeros(256, bool)
_KEEP[ord("a") : ord("z") + 1] = _KEEP[ord("0") : ord("9") + 1] = _KEEP[128:] = True


def folded(column: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of all texts, each framed by single spaces, and offsets."""
    raw, at = tx.utf8(column if isinstance(column, pa.Array) else pa.array(column, pa.string()))
    data, cut = raw.tobytes(), at.tolist()
    pieces = (data[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True))
    framed = [b" " + (p.lower() if p.isascii() else p.decode("utf-8", "replace").lower().encode()) + b" " for p in pieces]
    offs = np.concatenate([[0], np.cumsum([len(p) for p in framed])]).astype(np.int64)
    buf = np.frombuffer(b"".join(framed), np.uint8)
    buf = _FOLD[buf]
    stay = np.empty(len(buf), bool)  # of a run of other bytes only the first stays, as a space
    if len(buf):
        space = buf == 32
        stay[0] = True
        np.logical_or(~space[1:], ~space[:-1], out=stay[1:])
        stay[offs[:-1]] = True
    sizes = np.add.reduceat(stay, offs[:-1], dtype=np.int64) if len(offs) > 1 else np.zeros(0, np.int64)
    return buf[stay], np.concatenate([[0], np.cumsum(sizes)])


def grams(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes that begin at each position, as one word."""
    if len(buf) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray(len(buf) - Q + 1, np.uint64, buffer=np.ascontiguousarray(buf), strides=(1,))


_FOLD = np.where(_KEEP, np.arange(256), 32).astype(np.uint8)


class Index:
    """The q-grams of a bounded number of segments, and the short items."""

    def __init__(self, items: list[tuple[int, bytes]], segment: int, error: float):
        self.reach = 2 * segment
        self.item, self.text, self.at, self.budget, self.need = [], [], [], [], []
        short: dict[str, list[int]] = {}
        for item, text in items:
            if len(text) < SHORTEST:
                if text:
                    short.setdefault(f" {text.decode('latin-1')} ", []).append(item)
                continue
            cuts = [0] if len(text) <= segment else [*range(0, len(text) - segment, segment // 2), len(text) - segment]
            for at in cuts:
                piece = text[at : at + segment]
                e = min(int(len(piece) * error), (len(piece) - Q) // Q)
                self.item.append(item)
                self.text.append(piece)
                self.at.append(at)
                self.budget.append(e)
                self.need.append(len(piece) - Q + 1 - Q * e)
        self.budget, self.need = np.array(self.budget, np.int64), np.array(self.need, np.int64)
        codes = [grams(np.frombuffer(t, np.uint8)) for t in self.text]
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        seg = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        pos = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.seg, self.pos = seg[order], pos[order]
        self.code, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.code * _MULT) >> np.uint64(64 - _BITS)] = True
        self.short = ahocorasick.Automaton()
        for word, of in short.items():
            self.short.add_word(word, (len(word), of))
        if short:
            self.short.make_automaton()

    def shared(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose q-gram some segment has, and its number."""
        found, slots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(buf) - Q + 1, STEP) if len(self.code) else ():
            code = grams(buf[lo : lo + STEP + Q - 1])
            at = np.flatnonzero(self.table[(code * _MULT) >> np.uint64(64 - _BITS)])
            slot = np.minimum(np.searchsorted(self.code, code[at]), len(self.code) - 1)
            ok = self.code[slot] == code[at]
            found.append(at[ok] + lo)
            slots.append(slot[ok])
        return np.concatenate(found), np.concatenate(slots)

    def bands(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, segment, lowest diagonal) of the bands that reach their segment's bound."""
        at, slot = self.shared(buf)
        text = np.searchsorted(offs, at, "right") - 1
        inside = at + Q <= offs[text + 1]
        at, slot, text = at[inside], slot[inside], text[inside]
        # A region lies within two segments' length: too few hits around a hit end it early.
        near = np.searchsorted(at, at + self.reach) - np.searchsorted(at, at - self.reach)
        dense = near >= int(self.need.min(initial=1))
        at, slot, text = at[dense], slot[dense], text[dense]
        # Diagonals of all texts on one line, with more than a segment's length between those of two texts.
        origin = offs[:-1] + np.arange(1, len(offs)) * 2 * self.reach
        post = tx.ragged(self.first[slot], self.count[slot])
        seg = self.seg[post]
        diagonal = np.repeat(at - offs[text] + origin[text], self.count[slot]) - self.pos[post]
        # One cell for each run of e + 1 diagonals; a band is a cell and the next.
        key = (seg << np.int64(_CELLS)) | (diagonal // (self.budget[seg] + 1))
        key.sort()
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        cell, hits = key[cut], np.diff(np.concatenate([cut, [len(key)]]))
        total = hits.copy()
        beside = np.flatnonzero(cell[1:] == cell[:-1] + 1)
        total[beside] += hits[beside + 1]
        seg = cell >> _CELLS
        ok = total >= self.need[seg]
        cell, seg = cell[ok], seg[ok]
        low = (cell & ((1 << _CELLS) - 1)) * (self.budget[seg] + 1)
        text = np.searchsorted(origin - self.reach, low, "right") - 1
        return text, seg, low - origin[text]

    def found(self, buf: np.ndarray, offs: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """By (text, item): segment_at, start, stop and edits of the best occurrence in normalised texts."""
        out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for t, s, low in zip(*(x.tolist() for x in self.bands(buf, offs)), strict=True):
            e = int(self.budget[s])
            start = max(0, low - e)
            width = low + 2 * (e + 1) + e - start
            own = buf[offs[t] : offs[t + 1]][start : start + len(self.text[s]) + width]
            hit = banded(self.text[s], own.tobytes(), e, max(1, width))
            if hit:
                key, row = (t, self.item[s]), (self.at[s], start, start + hit[1], hit[0])
                if key not in out or row[3] < out[key][3]:
                    out[key] = row
        if len(self.short):
            for t in range(len(offs) - 1):
                for end, (size, items) in self.short.iter(buf[offs[t] : offs[t + 1]].tobytes().decode("latin-1")):
                    for item in items:
                        out.setdefault((t, item), (0, end + 2 - size, end, 0))
        return out


def banded(segment: bytes, region: bytes, budget: int, width: int) -> tuple[int, int] | None:
    """Least edit distance of `segment` to a part of `region`, and that part's end; None beyond the budget.

    Row i holds cells whose region position is i .. i + width, the band's diagonals.
    Bytes that match nothing go before the region: taking one of them for a byte of
    the segment is dropping that byte, so the band also holds the region's edge.
    """
    far = budget + 1
    text, size = np.frombuffer(b"\0" * budget + region, np.uint8), budget + len(region)
    span = np.arange(width + budget + 1)
    row = np.zeros(len(span), np.int64)  # the segment may begin anywhere in the band
    for i, c in enumerate(segment):
        at = span + i  # cell k of the next row ends at region position i + 1 + k
        ok = at < size
        same = np.full(len(span), far, np.int64)
        same[ok] = row[ok] + (text[at[ok]] != c)
        skip = np.concatenate([row[1:], [far]]) + 1
        new = np.minimum(same, skip)
        new = np.minimum.accumulate(new - span) + span  # extra bytes in the region
        row = np.minimum(new, far)
        if row.min() > budget:
            return None
    end = int(row.argmin())
    return (int(row[end]), max(0, min(size, len(segment) + end) - budget)) if row[end] <= budget else None


RESULT = "doc_id long, item_id long, segment_at int, start int, stop int, edits int"


def _scan(batches: Iterator[pa.RecordBatch], items: list[tuple[int, bytes]], segment: int, error: float) -> Iterator[pa.RecordBatch]:
    index = Index(items, segment, error)
    for whole in batches:
        for batch in tx.slices(whole, "text"):
            ids = batch.column(0).to_pylist()
            found = index.found(*folded(batch.column(1)))
            rows = [(ids[t], item, *row) for (t, item), row in found.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "segment_at", "start", "stop", "edits"])


def _clean_rows(batches: Iterator[pa.RecordBatch], items: list[tuple[int, bytes]], segment: int, error: float) -> Iterator[pa.RecordBatch]:
    index = Index(items, segment, error)
    for whole in batches:
        for batch in tx.slices(whole, "text"):
            stay = np.ones(batch.num_rows, bool)
            stay[[t for t, _ in index.found(*folded(batch.column(batch.schema.get_field_index("text"))))]] = False
            yield batch.filter(pa.array(stay))


def _passes(benchmark: DataFrame, segment: int) -> Iterator[list[tuple[int, bytes]]]:
    """Normalised items, as many at a time as one pass holds; at least one list."""
    held, size, any_yet = [], 0, False
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        text = folded([row["text"]])[0].tobytes().strip()
        held.append((row["item_id"], text))
        size += 1 + 2 * len(text) // segment
        if size >= PASS_SEGMENTS:
            yield held
            held, size, any_yet = [], 0, True
    if held or not any_yet:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, segment: int = SEGMENT, error: float = ERROR) -> DataFrame:
    """One row per document and benchmark item that occurs in it.

    doc_id, item_id, segment_at (where in the item the best segment begins),
    start and stop (where in the normalised text the region lies) and edits.
    Documents without an occurrence have no row; null and empty texts and items
    have none. Rows that repeat a document have a row each; of rows that repeat an
    item_id each is searched for, and the best occurrence counts. An item of fewer than SHORTEST
    normalised bytes occurs where its words stand unedited, so an item of one common
    word occurs in many documents. Items are read in passes of bounded size, so an
    evaluation set of any size fits; documents are never shuffled. Other columns are
    ignored. Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    parts = [docs.mapInArrow(partial(_scan, items=items, segment=segment, error=error), RESULT) for items in _passes(benchmark, segment)]
    return reduce(DataFrame.union, parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, segment: int = SEGMENT, error: float = ERROR) -> DataFrame:
    """The rows of `docs` in which no benchmark item occurs, all columns kept.

    Each row is decided by its own text where it is read: nothing is joined or
    shuffled, and null or repeated doc_ids make no difference. Null and empty texts stay.
    """
    for items in _passes(benchmark, segment):
        docs = docs.mapInArrow(partial(_clean_rows, items=items, segment=segment, error=error), docs.schema)
    return docs
