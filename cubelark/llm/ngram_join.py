"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct 5-word shingles. Two documents link when
100 * |A and B| >= 80 * |A or B|.

Why no link is lost. Let B be the larger set. A link means |A xor B| <= |A| / 4.
Sizes fall into bands; for a band of sizes up to `hi` the sketch has m sections
of 64 bits, and every shingle XORs its hash into one of them. A shingle that only
one set has changes one section, so the number of differing sections is at most
|A xor B| <= k = hi // 4, and at least m - k sections agree. The join is on
(band, section number, section content). Sections that no shingle fell into agree
for everybody and are not emitted. A set with fewer than m - k of those has an
agreeing section with content; the few sets with more also emit their prefix in
the order of shingle hashes, which any two linked sets share. A larger partner
also emits the sketch of the band below where a partner may be.

Within a bucket of equal keys not all pairs are made. Each member is first
compared with one member picked by hash (stars), and linked sets are merged. Only
buckets that still hold several classes are looked at further, in blocks of bounded
size. A first pass compares the parity sketches of members of different classes (a
sketch has at least two bits a shingle, so it rules out most pairs that don't link,
whatever the sets' size) and gives out the members that have a possible partner,
not the pairs. A second pass gets the shingles of those members, compares them exactly and
merges on the spot, so that a block gives out at most one proven link a member. Each
pair of a bucket is then linked, refuted or already in one component.

All links lie inside the components that are then known. For the number of a class's
links, all pairs of a component's classes are compared exactly, in blocks; again
only a number a member leaves the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .bloom_bits import bitmap, bits_for, keep_possible, positions
from .components import components
from .store import release, unused, written

#: Members and shingles, about, of one part of a bucket or component; a block is a part or two.
BLOCK, BLOCK_TOKENS = 2048, 1_000_000
#: Pairs of members whose sketches are compared at once.
PAIRS = 1 << 16
#: Sets that a task remembers so as to emit the keys of equal ones once; beyond it starts anew.
KNOWN = 1 << 20
_U = np.uint64


def bands(upto: int) -> list[tuple[int, int, int, int]]:
    """(lo, hi, k, m) of the size bands that cover set sizes 1..upto; each is half as wide again as the last."""
    out, lo = [], 1
    while lo <= max(1, upto):
        hi = max(lo, math.ceil(1.5 * lo)) if lo > 1 else 3
        k = hi // 4
        for m in range(k + 1, 2 * hi):  # room for the empty sections that a set of size lo is likely to have
            empty = m * math.exp(-lo / m)
            if m >= k + 1 + empty + 2 * math.sqrt(empty):
                break
        else:
            m = 2 * (k + 1)  # small sets: those without that room emit their prefix as well
        out.append((lo, hi, k, m))
        lo = hi + 1
    return out


def token_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text and their offsets."""
    buf, offs = tx.utf8(batch.column(1))
    buf = tx.LOWER[buf]
    starts, ends, words = tx.word_spans(buf, offs)
    sh, at = tx.shingle_hashes(tx.span_hashes(buf, starts, ends), words)
    sets = [np.unique(sh[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _fold(tokens: np.ndarray, offs: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
    out = np.zeros(len(offs) - 1, _U)
    full = np.diff(offs) > 0
    if full.any():
        out[full] = ufunc.reduceat(tokens, offs[:-1][full])
    return out


def _identity(tokens: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tx.mix(_fold(tokens, offs, np.add)), tx.mix(_fold(tx.mix(tokens), offs, np.bitwise_xor))


def sketches(tokens: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches as 64-bit words, and the n + 1 offsets of each set's words.

    Each shingle flips one bit. A set's sketch has at least two bits a shingle and a
    power of two of them; folding a longer one by XOR gives a shorter one.
    """
    n = np.diff(offs)
    bits = 64 << np.ceil(np.log2(np.maximum(n, 32) / 32)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(base[:-1], n) + (tokens >> _U(9) & np.repeat(bits - 1, n).astype(_U)).astype(np.int64)
    packed = np.packbits(np.bincount(at, minlength=base[-1]).astype(np.uint8) & 1, bitorder="little")
    return packed.view(_U), base // 64


def _possible(n: np.ndarray, words: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches let rows i and j link; the wider sketch is folded.

    A sketch distance never exceeds the symmetric difference, and a link means that
    this is at most a ninth of both sizes together.
    """
    ok = 100 * np.minimum(n[i], n[j]) >= 80 * np.maximum(n[i], n[j])
    left = np.flatnonzero(ok)
    width = np.diff(at)
    wi, wj = width[i[left]], width[j[left]]
    least = np.minimum(wi, wj)
    kind = (least << 16) | (wi // np.maximum(least, 1) << 8) | (wj // np.maximum(least, 1))
    for k in np.unique(kind).tolist():
        same, w = left[kind == k], k >> 16
        for cut in range(0, len(same), max(1, (1 << 20) // max(w, 1))):
            some = same[cut : cut + max(1, (1 << 20) // max(w, 1))]
            x, y = (_folded(words, at[side[some]], w, times) for side, times in ((i, k >> 8 & 255), (j, k & 255)))
            far = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            ok[some] = 9 * far <= n[i[some]] + n[j[some]]
    return ok


def _folded(words: np.ndarray, at: np.ndarray, width: int, times: int) -> np.ndarray:
    place = at[:, None] + np.arange(width)
    out = words[place]
    for r in range(1, times):
        out ^= words[place + r * width]
    return out


def _sketch_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and n + 1 offsets of a binary column of sketches."""
    buf, offs = tx.utf8(column)
    return np.ascontiguousarray(buf).view(_U), offs // 8


def close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sizes and sketches, those that may link."""
    for batch in batches:
        m = batch.num_rows
        n = np.concatenate([batch.column(2).to_numpy(), batch.column(3).to_numpy()])
        (u, ua), (v, va) = _sketch_column(batch.column(4)), _sketch_column(batch.column(5))
        ok = _possible(n, np.concatenate([u, v]), np.concatenate([ua[:-1], va + len(u)]), np.arange(m), np.arange(m) + m)
        yield batch.select(["a", "b"]).filter(pa.array(ok))


SETS = "doc_id long, n long, h1 long, h2 long, wide binary"


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tx.slices(whole, "text"):
            tokens, offs = token_sets(batch)
            h1, h2 = _identity(tokens, offs)
            words, at = sketches(tokens, offs)
            wide = pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((8 * at).astype(np.int32).tobytes()), pa.py_buffer(words.tobytes())])
            cols = [batch.column(0), *(pa.array(c) for c in (np.diff(offs), h1.view(np.int64), h2.view(np.int64))), wide]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "h1", "h2", "wide"])


def section_keys(tokens: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of the sets, and the number of each key's set."""
    sizes = np.diff(offs)
    table = bands(int(sizes.max(initial=1)))
    keys, owners = [], []
    for j, (lo, hi, k, m) in enumerate(table):
        if not k:
            continue  # only equal sets link, and those are one class already
        own = (sizes >= lo) & (sizes <= hi)
        above = (sizes > hi) & (np.ceil(sizes * 0.8) <= hi)
        docs = np.flatnonzero(own | above)
        if not len(docs):
            continue
        picked = tx.ragged(offs[docs], sizes[docs])
        tok, of = tokens[picked], np.repeat(np.arange(len(docs)), sizes[docs])
        section = ((tok >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)  # tokens ascend, so sections do
        place = of * m + section
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        content = np.bitwise_xor.reduceat(tok, first)
        tag = tx.mix(section[first].astype(_U) + _U(j << 40) + _U(1 << 60))
        keys.append(tx.mix(content ^ tag))
        owners.append(docs[of[first]])
        empty = m - np.bincount(of[first], minlength=len(docs))
        rest = np.flatnonzero(empty > m - k - 1)
        if len(rest):
            docs = docs[rest]
            take = sizes[docs] // 5 + 1
            keys.append(tx.mix(tokens[tx.ragged(offs[docs], take)] ^ _U((j << 40) + (1 << 61))))
            owners.append(np.repeat(docs, take))
    if not keys:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


class _Known:
    """Sets that were seen before, up to KNOWN of them (16 bytes each)."""

    def __init__(self) -> None:
        self.h1, self.h2 = np.zeros(0, _U), np.zeros(0, _U)

    def new(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The first places of sets not seen before; two that share h1 alone count as new."""
        _, first = np.unique(np.stack([h1, h2]), axis=1, return_index=True)
        spot = np.searchsorted(self.h1, h1[first])
        held = np.zeros(len(first), bool)
        inside = spot < len(self.h1)
        held[inside] = (self.h1[spot[inside]] == h1[first[inside]]) & (self.h2[spot[inside]] == h2[first[inside]])
        first, spot = first[~held], spot[~held]
        if len(self.h1) + len(first) > KNOWN:
            self.__init__()
            spot = np.zeros(len(first), np.int64)
        self.h1, self.h2 = np.insert(self.h1, spot, h1[first]), np.insert(self.h2, spot, h2[first])
        return np.sort(first)


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, set hash); a task emits the keys of equal sets once, as far as it remembers them."""
    known = _Known()
    for whole in batches:
        for batch in tx.slices(whole, "text"):
            tokens, offs = token_sets(batch)
            h1, h2 = _identity(tokens, offs)
            sizes = np.diff(offs)
            left = known.new(h1, h2)
            left = left[sizes[left] > 0]
            tokens = tokens[tx.ragged(offs[left], sizes[left])]
            keys, owners = section_keys(tokens, np.concatenate([[0], np.cumsum(sizes[left])]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(h1[left][owners].view(np.int64))], names=["key", "h"])


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, h), the distinct rows whose key has several h, each with a star.

    A bucket seen whole is renamed after its members, so that buckets with the same
    members become equal rows. State between batches is one row: memory doesn't
    grow with a key's rows.
    """
    held: tuple[int, int] | None = None  # the last distinct row of the key at hand
    star: int | None = None  # set once that key has shown two different h

    def out(k: np.ndarray, h: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(h), pa.array(s)], names=["key", "member", "center"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, h = (batch.column(i).to_numpy() for i in (0, 1))
        prior = star is not None
        if held is not None:
            key, h = np.concatenate([[held[0]], key]), np.concatenate([[held[1]], h])
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])])
        key, h = key[new], h[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(key)]]))
        whole = np.ones(len(starts), bool)
        whole[-1] = False
        whole[0] &= not prior
        members = tx.mix(np.add.reduceat(tx.mix(h.view(_U)), starts) ^ counts.astype(_U)).view(np.int64)
        name = np.repeat(np.where(whole, members, key[starts]), counts)
        rank = tx.mix(h.view(_U) ^ (name.view(_U) & _U(3)))
        best = np.minimum.reduceat(rank, starts)
        run = np.repeat(np.arange(len(starts)), counts)
        at = np.flatnonzero(rank == best[run])
        pick = np.empty(len(starts), np.int64)
        pick[run[at]] = h[at]
        if prior:
            pick[0] = star  # the run's first batch has chosen
        several = counts > 1
        if prior:
            several[0] = True
        emit = several[run]
        if prior:
            emit[0] = False  # emitted before
        last = counts[-1] > 1 or (len(starts) == 1 and prior)
        held, star = (int(key[-1]), int(h[-1])), (int(pick[-1]) if last else None)
        if emit.any():
            yield out(name[emit], h[emit], pick[run][emit])


def _whole_blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of whole blocks, from rows sorted by `bucket`."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch.select(names)])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        bucket = t.column("bucket").to_numpy()
        other = np.flatnonzero(bucket != bucket[-1]) if len(bucket) else []
        cut = int(other[-1]) + 1 if len(other) else 0
        rest = t.slice(cut)
        if cut:
            yield t.slice(0, cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _pairs(bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of rows in the same bucket, about PAIRS at a time; i ascends."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    rows = np.arange(len(bucket))
    count = np.repeat(edges[1:], np.diff(edges)) - rows - 1
    upto = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        if upto[hi] > upto[lo]:
            yield np.repeat(rows[lo:hi], count[lo:hi]), tx.ragged(rows[lo:hi] + 1, count[lo:hi])
        lo = hi


def open_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by block, those that may link with a member of another class there."""
    for t in _whole_blocks(batches, ["bucket", "id", "label", "n", "wide"]):
        bucket, label, n = (t.column(c).to_numpy() for c in ("bucket", "label", "n"))
        words, at = _sketch_column(t.column("wide"))
        found = np.zeros(len(n), bool)
        for i, j in _pairs(bucket):
            ask = (label[i] != label[j]) & ~(found[i] & found[j])
            i, j = i[ask], j[ask]
            ok = _possible(n, words, at, i, j)
            found[i[ok]] = found[j[ok]] = True
        yield from t.select(["bucket", "id", "label"]).filter(pa.array(found)).to_batches()


def _tokens(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and n + 1 offsets of a list column."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offs = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[offs[0] : offs[-1]].view(_U), offs - offs[0]


def _common(tokens: np.ndarray, offs: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """How many shingles set i has in common with each of the sets js; none may be empty."""
    own, size = tokens[offs[i] : offs[i + 1]], np.diff(offs)[js]
    other = tokens[tx.ragged(offs[js], size)]
    hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
    return np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)


def proven_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows with shingles sorted by block, links (a, b) that join all classes which links in it join.

    Two linked members whose classes earlier links of the block have joined give no
    row: a block gives fewer rows than it has members.
    """
    for t in _whole_blocks(batches, ["bucket", "id", "label", "tokens"]):
        bucket, ids, label = (t.column(c).to_numpy().copy() for c in ("bucket", "id", "label"))
        tokens, offs = _tokens(t.column("tokens"))
        words, at = sketches(tokens, offs)
        n, edges = np.diff(offs), np.searchsorted(bucket, np.unique(bucket))
        ends = np.append(edges[1:], len(bucket))
        a, b = [], []
        for i, j in _pairs(bucket):
            ask = label[i] != label[j]
            i, j = i[ask], j[ask]
            ok = _possible(n, words, at, i, j)
            i, j = i[ok], j[ok]
            for x, first, count in zip(*np.unique(i, return_index=True, return_counts=True), strict=True):
                js = j[first : first + count]
                js = js[label[js] != label[x]]
                if not len(js):
                    continue
                both = _common(tokens, offs, x, js)
                js = js[100 * both >= 80 * (n[x] + n[js] - both)]
                block = slice(edges[k := int(np.searchsorted(edges, x, "right")) - 1], ends[k])
                for y in js.tolist():
                    if label[y] != label[x]:
                        a.append(min(ids[x], ids[y]))
                        b.append(max(ids[x], ids[y]))
                        label[block][label[block] == label[y]] = label[x]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tx.slices(whole, "text"):
            tokens, offs = token_sets(batch)
            h1, _ = _identity(tokens, offs)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(tokens.view(np.int64)))], names=["id", "tokens"])


def tokens_of(docs: DataFrame, ids: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, tokens): the shingles of the given classes, as a written table.

    A bounded Bloom bitmap of their smallest doc_ids picks the texts to shingle; texts are not shuffled.
    """
    own = classes.select("id", "doc").join(ids, "id", "left_semi")
    bits = bits_for(ids.count())
    at = own.select(F.explode(F.array(*positions(F.col("doc"), bits))).alias("p"))
    held = keep_possible(docs, bitmap(at, "p"), F.col("doc_id"), bits).where("_maybe").select("doc_id", "text")
    held = held.mapInArrow(token_rows, "id long, tokens array<long>")
    return written(held.join(ids, "id", "left_semi").dropDuplicates(["id"]))


def _joined(pairs: DataFrame, side: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with both ends' columns of `side`, named after the end."""
    out = pairs
    for end in ("a", "b"):
        out = out.join(side.select(F.col("id").alias(end), *(F.col(c).alias(c + end) for c in columns)), end)
    return out


def star_links(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of pairs of classes those that link, and the shingles that decided it."""
    near = _joined(pairs, classes, "n", "wide").select("a", "b", "na", "nb", "widea", "wideb").mapInArrow(close_pairs, "a long, b long")
    near = written(near)
    release(docs.sparkSession)
    tokens = tokens_of(docs, near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), classes)
    both = _joined(near, tokens, "tokens")
    both = both.select("a", "b", (F.size("tokensa") + F.size("tokensb")).cast("long").alias("sizes"), F.size(F.array_intersect("tokensa", "tokensb")).cast("long").alias("common"))
    return written(both.where("100 * common >= 80 * (sizes - common)").select("a", "b")), tokens


def _dealt(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Rows dealt to blocks: each key's rows are hashed into parts of bounded size, and each two parts of a key are a block.

    Adds c, the row's part, and lo and hi, the block's parts. A key of one part has one block.
    """
    parts = rows.groupBy(key).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(size) / BLOCK_TOKENS)).cast("int").alias("_parts"))
    out = rows.join(parts, key).withColumn("c", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return out.withColumn("lo", F.least("c", "_other")).withColumn("hi", F.greatest("c", "_other")).drop("_parts", "_other")


def residual_links(docs: DataFrame, classes: DataFrame, members: DataFrame, merged: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links that join the classes of those buckets (key, id) that hold several."""
    labelled = written(members.join(merged, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label")))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    left = labelled.join(mixed, "key").join(classes.select("id", "n", "wide"), "id")
    left = _dealt(left, "key", "n").withColumn("bucket", F.xxhash64("key", "lo", "hi")).select("bucket", "id", "label", "n", "wide")
    left = written(left.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(open_members, "bucket long, id long, label long"))
    release(docs.sparkSession)
    ids = left.select("id").distinct()
    tokens = tokens.unionByName(tokens_of(docs, written(ids.join(tokens, "id", "left_anti")), classes))
    exact = left.join(tokens, "id").repartition("bucket").sortWithinPartitions("bucket")
    return written(exact.mapInArrow(proven_links, "a long, b long").distinct())


def link_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by block (component, lo, hi), each member's number of links in it: within a part if lo = hi, else between the two."""
    held: list[tuple] = []  # rows of the block at hand: at most two parts
    block: tuple | None = None

    def counted(between: bool) -> pa.RecordBatch:
        held.sort(key=lambda r: r[1])
        ids, sizes = np.array([r[0] for r in held], np.int64), np.array([len(r[2]) for r in held], np.int64)
        part = np.array([r[1] for r in held], np.int64)
        offs = np.concatenate([[0], np.cumsum(sizes)])
        words, at = np.unique(np.concatenate([r[2] for r in held]), return_inverse=True)
        own, n = np.zeros(len(words), np.uint8), np.zeros(len(ids), np.int64)
        first = int(np.searchsorted(part, part[-1])) if between else 0
        for i in range(first if between else len(ids) - 1):
            j = first if between else i + 1
            if j == len(ids):
                continue
            own[at[offs[i] : offs[i + 1]]] = 1
            common = np.add.reduceat(own[at[offs[j] :]], offs[j:-1] - offs[j], dtype=np.int64)
            own[at[offs[i] : offs[i + 1]]] = 0
            linked = 100 * common >= 80 * (sizes[i] + sizes[j:] - common)
            n[j:] += linked
            n[i] += int(linked.sum())
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    for batch in batches:
        component, lo, hi, ids, part = (batch.column(c).to_pylist() for c in ("component", "lo", "hi", "id", "c"))
        for i, of in enumerate(zip(component, lo, hi, strict=True)):
            if of != block:
                if len(held) > 1:
                    yield counted(block[1] != block[2])
                held, block = [], of
            held.append((ids[i], part[i], batch.column("tokens")[i].values.to_numpy()))
    if len(held) > 1:
        yield counted(block[1] != block[2])


def counted_links(docs: DataFrame, classes: DataFrame, merged: DataFrame) -> DataFrame:
    """(id, n_links): the exact number of links of every class (id, component) that has any."""
    sets = tokens_of(docs, merged.select("id"), classes).join(merged, "id").withColumn("size", F.size("tokens"))
    dealt = _dealt(written(sets), "component", "size").select("component", "lo", "hi", "id", "c", "tokens")
    dealt = dealt.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    return dealt.mapInArrow(link_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id and n_links.

    Documents with the same shingle set are a class. class_id is its smallest
    doc_id, component_id the smallest one reachable by links. n_links is the
    number of other classes that the class links with; without `count_links`, which
    saves comparing all pairs of a component, there is no such column. Null and empty
    texts have no shingles and link with nothing. Repeated rows stay repeated; rows
    that repeat a doc_id with another text are placed by their own text. Rows
    without a doc_id bear the ids of their class, or null if it has none. An empty
    table gives no rows. Other columns of the input are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = written(docs.mapInArrow(set_rows, SETS))
    # A class goes by its first hash, `id`; `doc` is its smallest doc_id.
    classes = sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("doc"), F.first("wide").alias("wide"))
    classes = written(classes.select("n", "h1", "h2", F.col("h1").alias("id"), "doc", "wide"))
    keys = docs.mapInArrow(key_rows, "key long, h long")
    buckets = keys.repartition("key").sortWithinPartitions("key", "h").mapInArrow(shared_keys, "key long, member long, center long")
    buckets = written(buckets.distinct())
    del keys
    release(docs.sparkSession)

    pairs = buckets.where("member <> center").select(F.least("member", "center").alias("a"), F.greatest("member", "center").alias("b")).distinct()
    links, tokens = star_links(docs, classes, pairs)
    merged = written(components(links))
    release(docs.sparkSession)
    links = links.union(residual_links(docs, classes, buckets.select("key", F.col("member").alias("id")), merged, tokens))
    merged = written(components(links))
    release(docs.sparkSession)

    own = classes.select("n", "h1", "h2", "id", F.col("doc").alias("class_id")).join(merged, "id", "left")
    least = own.where("component is not null").groupBy("component").agg(F.min("class_id").alias("component_id"))
    done = own.join(least, "component", "left").withColumn("component_id", F.coalesce("component_id", "class_id"))
    if count_links:
        done = done.join(written(counted_links(docs, classes, merged)), "id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    shown = ["n_links"] if count_links else []
    out = sets.select("doc_id", "n", "h1", "h2").join(done.select("n", "h1", "h2", "class_id", "component_id", *shown), ["n", "h1", "h2"], "left")
    alone = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), *alone)


def near_duplicate_filter(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near duplicates: of each group the smallest doc_id stays, all columns kept.

    Documents without words are in no group and all stay, and so do rows without a
    doc_id and all rows that repeat the doc_id that stays. A doc_id that is repeated
    with different texts goes only if each of them would. An empty table stays empty.
    """
    marks, own = jaccard_components(docs, count_links=False), unused(docs, "own")
    drop = marks.groupBy(F.col("doc_id").alias(own)).agg(F.every(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone").select(own)
    return docs.join(drop, F.col("doc_id") == F.col(own), "left_anti")
