"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The pieces of a model become one automaton over UTF-8 bytes whose transitions
are complete (no failure steps are left at run time). A text is read once; at each
byte the output links name all pieces that end there, and each relaxes the best
score of that position. The best path is the segmentation with the highest sum of
the model's piece scores; of equal sums the one whose last piece is longest wins,
at every position. Characters that no piece covers become byte pieces.

No piece continues across the start of a run of spaces, so a text falls apart
into chunks; each distinct chunk of a batch is segmented once, all of them side by
side. A long chunk, such as a text without spaces, is cut into windows that are
segmented side by side too, each beginning a way before the last one ends. Where the
best paths to all positions near that end pass one common position in both windows, the
windows' scores differ by a constant from there on, so both go on alike and the
paths are joined at that position. Where there is none, the chunk is segmented in one run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Fixed values of the SentencePiece format: the mark for a space, and how far below the least score an unknown character scores.
SPACE_MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0
#: Bytes of text segmented at once, of a window of a longer chunk, and of what two windows share at least.
BATCH_BYTES, WINDOW, SHARED = 2 << 20, 512, 192


@dataclass
class Automaton:
    """Complete automaton of a model's pieces."""

    step: np.ndarray  # state x byte -> state
    piece: np.ndarray  # state -> id of the piece that ends there, or -1
    output: np.ndarray  # state -> nearest state at or above it (by suffix) where a piece ends; 0 for none
    link: np.ndarray  # state -> the next such state strictly above it; 0 for none
    size: np.ndarray  # id -> bytes
    score: np.ndarray
    unknown: float
    byte_id: np.ndarray  # byte -> id
    data: np.ndarray  # all pieces' decoded bytes
    data_at: np.ndarray
    newline_apart: bool  # no piece holds a newline


def build(model: bytes) -> Automaton:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i).encode() for i in range(n)]
    normal = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    score = np.array([sp.get_score(i) for i in range(n)])
    child: list[dict[int, int]] = [{}]
    piece = [-1]
    for i in normal:
        at = 0
        for b in names[i]:
            to = child[at].get(b)
            if to is None:
                to = child[at][b] = len(child)
                child.append({})
                piece.append(-1)
            at = to
        piece[at] = i
    states = len(child)
    step = np.zeros((states, 256), np.uint16 if states <= 1 << 16 else np.int32)
    output, link = np.zeros(states, np.int32), np.zeros(states, np.int32)
    fail = [0] * states
    queue = [0]
    for at in queue:  # breadth first: a state's suffix state is complete before it
        if at:
            step[at] = step[fail[at]]
            link[at] = output[fail[at]]
            output[at] = at if piece[at] >= 0 else link[at]
        for b, to in child[at].items():
            fail[to] = int(step[fail[at], b]) if at else 0
            queue.append(to)
        for b, to in child[at].items():
            step[at, b] = to
    byte_id = np.zeros(256, np.int32)
    for i in range(n):
        if sp.is_byte(i):
            byte_id[int(names[i][3:5], 16)] = i
    shown = [b"" if sp.is_control(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(SPACE_MARK, b" ") for i in range(n)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in shown])])
    data = np.frombuffer(b"".join(shown), np.uint8)
    return Automaton(step, np.array(piece, np.int32), output, link, np.array([len(x) for x in names], np.int64), score, float(score[normal].min()) - UNKNOWN_PENALTY, byte_id, data, at, not any(b"\n" in names[i] for i in normal))


_BUILT: dict[int, Automaton] = {}


def automaton(model: bytes) -> Automaton:
    """One automaton per Python worker and model."""
    key = zlib.crc32(model)
    if key not in _BUILT:
        _BUILT[key] = build(model)
    return _BUILT[key]


def _segment_long(a: Automaton, data: bytes) -> list[int]:
    """One chunk in plain Python; the same rules as `segment`."""
    step, output, link, piece = a.step, a.output, a.link, a.piece
    n = len(data)
    best, back, came = [0.0] + [-np.inf] * n, [0] * (n + 1), [0] * (n + 1)
    state, char = 0, 0
    for t, b in enumerate(data):
        state = step[state, b]
        if b & 0xC0 != 0x80:
            char = t
        o, single = output[state], False
        while o:
            p = piece[o]
            start = t + 1 - a.size[p]
            single |= start == char
            if best[start] + a.score[p] > best[t + 1]:
                best[t + 1], back[t + 1], came[t + 1] = best[start] + a.score[p], p, start
            o = link[o]
        if (t + 1 == n or data[t + 1] & 0xC0 != 0x80) and not single and best[char] + a.unknown > best[t + 1]:
            best[t + 1], back[t + 1], came[t + 1] = best[char] + a.unknown, -1, char
    out, t = [], n
    while t:
        if back[t] >= 0:
            out.append(int(back[t]))
        else:
            out.extend(int(a.byte_id[b]) for b in reversed(data[came[t] : t]))
        t = came[t]
    return out[::-1]


def _windows(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and span of each lane: spans of at most a window whole, others in overlapping windows cut between characters."""
    window = max(WINDOW, 2 * shared)
    short = np.flatnonzero(ends - starts <= window + shared)
    first, last, owner = [starts[short]], [ends[short]], [short]
    for i in np.flatnonzero(ends - starts > window + shared):
        stops = np.append(np.arange(starts[i] + window, ends[i] - shared, window), ends[i])
        for edges in (stops[:-1], begin := np.concatenate([[starts[i]], stops[:-1] - shared])):
            for _ in range(3):
                edges -= buf[edges] & 0xC0 == 0x80
        first.append(begin)
        last.append(stops)
        owner.append(np.full(len(stops), i))
    return np.concatenate(first), np.concatenate(last), np.concatenate(owner)


def _forward(a: Automaton, buf: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best score, last piece (-1: an unknown character) and its bytes, at each position of each lane, and the lanes' bases.

    Lanes are in order of falling size and take one step together for each byte.
    """
    base = np.concatenate([[0], np.cumsum(n + 1)])
    best = np.full(base[-1], -np.inf)
    best[base[:-1]] = 0
    back, width = np.full(base[-1], -1, np.int32), np.zeros(base[-1], np.int32)
    steps = int(n.max(initial=0))
    live = np.searchsorted(-n, -np.arange(1, steps + 1), "right")
    state, char = np.zeros(len(s), a.step.dtype), np.zeros(len(s), np.int64)
    following = np.append(buf, np.uint8(0))
    for t in range(steps):
        k = live[t]
        at = s[:k] + t
        b = buf[at]
        state = a.step[state[:k], b]
        char = np.where(b & 0xC0 != 0x80, t, char[:k])
        to = base[:k] + t + 1
        who, o = np.arange(k), a.output[state]
        top, by, wide, single = np.full(k, -np.inf), np.full(k, -1, np.int32), np.zeros(k, np.int32), np.zeros(k, bool)
        while True:
            some = o > 0
            if not some.all():
                who, o = who[some], o[some]
            if not len(who):
                break
            p = a.piece[o]
            w = a.size[p]
            start = t + 1 - w
            cand = best[base[who] + start] + a.score[p]
            single[who] |= start == char[who]
            ok = cand > top[who]
            i = who[ok]
            top[i], by[i], wide[i] = cand[ok], p[ok], w[ok]
            o = a.link[o]
        ended = (n[:k] == t + 1) | (following[at + 1] & 0xC0 != 0x80)
        i = np.flatnonzero(ended & ~single)
        if len(i):
            cand = best[base[i] + char[i]] + a.unknown
            ok = cand > top[i]
            i = i[ok]
            top[i], by[i], wide[i] = cand[ok], -1, t + 1 - char[i]
        best[to], back[to], width[to] = top, by, wide
    return best, back, width, base


def _joints(best: np.ndarray, width: np.ndarray, at: np.ndarray, n: np.ndarray, reach: int) -> np.ndarray:
    """For pairs of overlapping windows, how far before the first one's end their paths are joined; -1 for nowhere.

    at: (2, pairs) places in the tables of that end, in either window; n: bytes that both have before it.
    From the last `reach` positions, which no piece leaps over, all best paths are walked
    back in both windows until one position is left that is the same in both.
    """
    pairs, deep = at.shape[1], int(n.max(initial=0))
    live = np.zeros((2, deep + 1, pairs), bool)
    back = np.arange(min(reach, deep + 1))
    for side in range(2):
        spot = at[side] - back[:, None]
        live[side, : len(back)] = np.where(back[:, None] <= n, best[np.maximum(spot, 0)] > -np.inf, False)
    count = live.sum(axis=1)
    joint, open_ = np.full(pairs, -1), np.ones(pairs, bool)
    for q in range(deep + 1):
        met = open_ & (count == 1).all(axis=0) & live[:, q].all(axis=0)
        joint[met] = q
        open_ &= ~met & (q < n)
        if not open_.any():
            break
        for side in range(2):
            i = np.flatnonzero(open_ & live[side, q])
            to = q + width[at[side][i] - q]
            open_[i[to > n[i]]] = False
            i, to = i[to <= n[i]], to[to <= n[i]]
            count[side][i] -= live[side, to, i]
            live[side, to, i] = True
    return joint


def segment(a: Automaton, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each span of buf, and the n + 1 offsets of each span's ids."""
    reach = int(a.size[a.piece[a.piece >= 0]].max(initial=4))
    first, last, owner = _windows(buf, starts, ends, max(SHARED, 3 * reach))
    order = np.argsort(first - last, kind="stable")
    place = np.argsort(order)  # of a lane in falling order of size
    s, n, owner = first[order], (last - first)[order], owner[order]
    best, back, width, base = _forward(a, buf, s, n)
    lo, hi = np.zeros(len(s), np.int64), n.copy()
    slow: dict[int, np.ndarray] = {}
    # Windows of one span follow each other in `first`.
    y = np.flatnonzero(owner[place[1:]] == owner[place[:-1]]) + 1 if len(place) > 1 else np.zeros(0, np.int64)
    if len(y):
        x, y = place[y - 1], place[y]
        both = s[x] + n[x] - s[y]
        joint = _joints(best, width, np.stack([base[x] + n[x], base[y] + both]), both, reach)
        hi[x] = n[x] - joint
        lo[y] = both - joint
        for i in np.unique(owner[x[joint < 0]]).tolist():
            slow[i] = np.array(_segment_long(a, buf[starts[i] : ends[i]].tobytes()), np.int32)
            lo[owner == i] = hi[owner == i] = 0
    # Walk all best paths back at once; unknown characters count their bytes.
    at = hi
    lane, pieces, spot = [], [], []
    who = np.flatnonzero(at > lo)
    while len(who):
        here = base[who] + at[who]
        p, w = back[here], width[here].astype(np.int64)
        at[who] -= w
        lane.append(who)
        pieces.append(p)
        spot.append(at[who].copy())
        multi = (p < 0) & (w > 1)
        if multi.any():
            extra = w[multi] - 1
            lane.append(np.repeat(who[multi], extra))
            pieces.append(np.full(int(extra.sum()), -1, np.int32))
            spot.append(np.repeat(at[who[multi]] + 1, extra) + tx.ragged(np.zeros(len(extra), np.int64), extra))
        who = who[at[who] > lo[who]]
    lane, pieces, spot = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lane, pieces, spot))
    spot = spot + s[lane]
    by = np.lexsort((spot, owner[lane]))
    lane, ids, spot = lane[by], pieces[by].astype(np.int32), spot[by]
    unknown = ids < 0
    ids[unknown] = a.byte_id[buf[spot[unknown]]]
    counts = np.bincount(owner[lane], minlength=len(starts)).astype(np.int64)
    fast = counts.copy()
    for i, x in slow.items():
        counts[i] = len(x)
    offs = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offs[-1], np.int32)
    out[tx.ragged(offs[:-1], fast)] = ids
    for i, x in slow.items():
        out[offs[i] : offs[i + 1]] = x
    return out, offs


def prepared(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before each text that isn't empty, and every space mark of a text as a space."""
    mark = np.flatnonzero((buf[:-2] == SPACE_MARK[0]) & (buf[1:-1] == SPACE_MARK[1]) & (buf[2:] == SPACE_MARK[2])) if len(buf) > 2 else np.zeros(0, np.int64)
    if len(mark):
        buf = buf.copy()
        keep = np.ones(len(buf), bool)
        buf[mark] = 32
        keep[mark + 1] = keep[mark + 2] = False
        buf, offs = buf[keep], np.concatenate([[0], np.cumsum(keep)])[offs]
    full = np.diff(offs) > 0
    out = np.insert(buf, offs[:-1][full], np.uint8(32))
    return out, offs + np.concatenate([[0], np.cumsum(full)])


def encode(a: Automaton, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of prepared texts and the offsets of each text's ids."""
    if not len(buf):
        return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
    space = buf == 32
    begin = np.concatenate([[True], space[1:] & ~space[:-1]])
    begin[offs[:-1][np.diff(offs) > 0]] = True
    if a.newline_apart:
        begin |= buf == 10
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(buf))
    h = tx.span_hashes(buf, starts, ends)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    # A span's spaces become marks of three bytes for the automaton.
    us, ue = starts[first], ends[first]
    picked = buf[tx.ragged(us, ue - us)]
    count = np.where(picked == 32, 3, 1)
    wide = np.repeat(picked, count)
    edge = np.concatenate([[0], np.cumsum(count)])
    at = edge[:-1][picked == 32]
    for k in range(3):
        wide[at + k] = SPACE_MARK[k]
    cut = edge[np.concatenate([[0], np.cumsum(ue - us)])]
    ids, io = segment(a, wide, cut[:-1], cut[1:])
    counts = np.diff(io)[which]
    out = ids[tx.ragged(io[:-1][which], counts)]
    total = np.concatenate([[0], np.cumsum(counts)])
    return out, total[np.searchsorted(starts, offs)]


def decode(a: Automaton, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text, without the space put before it, and their offsets."""
    size = np.diff(a.data_at)[ids]
    data = a.data[tx.ragged(a.data_at[:-1][ids], size)]
    at = np.concatenate([[0], np.cumsum(size)])[offs]
    first = at[:-1][np.diff(at) > 0]
    first = first[data[first] == 32]
    keep = np.ones(len(data), bool)
    keep[first] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def _encode_rows(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    a = automaton(model)
    for whole in batches:
        for batch in tx.slices(whole, "text", BATCH_BYTES):
            ids, at = encode(a, *prepared(*tx.utf8(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])


def _decode_rows(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    a = automaton(model)
    for batch in batches:
        col = batch.column(1)
        at = np.asarray(col.offsets, np.int64)
        data, offs = decode(a, np.asarray(col.values, np.int32)[at[0] : at[-1]], at - at[0])
        text = pa.Array.from_buffers(pa.string(), len(batch), [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), text], names=["doc_id", "text"])


def _digest_rows(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    a = automaton(model)
    for whole in batches:
        for batch in tx.slices(whole, "text", BATCH_BYTES):
            raw, offs = tx.utf8(batch.column(1))
            ids, at = encode(a, *prepared(raw, offs))
            back, bo = decode(a, ids, at)
            same = [np.array_equal(raw[i:j], back[k:m]) for i, j, k, m in zip(offs[:-1], offs[1:], bo[:-1], bo[1:], strict=True)]
            crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            score = np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), weights=a.score[ids], minlength=len(at) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(score), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "path_score", "round_trip"])


def read_model(path: str) -> bytes:
    """A model file on the driver; its bytes (under a few MB) go along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _two(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and ids of every row; null and empty texts have an empty list of ids.

    Repeated rows and null doc_ids have a row each; an empty table gives none. Of paths
    with equal scores the one whose last piece is longest wins. Other columns are ignored.
    """
    return _two(docs).mapInArrow(partial(_encode_rows, model=model), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids). A literal space mark in the first text comes back as a space."""
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), ids.alias("ids")).mapInArrow(partial(_decode_rows, model=model), "doc_id long, text string")


def round_trips(docs: DataFrame, model: bytes) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_crc32 (ids as little-endian 32-bit integers), the path's score and whether decoding gives the text back.

    Null texts are as empty ones: no tokens, score 0, round trip true. A text with a literal
    space mark doesn't come back, as decoding gives a space. Rows and columns are taken as in `encode_documents`.
    """
    return _two(docs).mapInArrow(partial(_digest_rows, model=model), "doc_id long, n_tokens long, ids_crc32 long, path_score double, round_trip boolean")
