"""Quality classifier: a linear-chain conditional random field over lines.

Every line is good or bad. A line's features describe its own bytes and words
and those of the line before and after; the chain adds weights for pairs of
neighbouring labels. Forward-backward gives each line's marginal of being good,
and the mean of the marginals, weighted by the lines' bytes, is the document's
score.

Labels are given for documents. A fit begins with them on every line; then lines'
labels become hidden: their marginals under the model, tilted no more than it takes
for a good document's weighted mean to reach AGREE and a bad one's to fall under
1 - AGREE, are what the next fit aims at. So a bad document may hold good lines, and
the chain learns where labels change.

A score depends on the text alone: sums run in a fixed order, whatever rows are
beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Labelled documents that one fit reads at most, chosen by a hash of doc_id; of them those with at most so many lines.
FIT_DOCUMENTS, FIT_LINES = 2000, 256
#: Fold of doc_id (crc32 of its digits, mod 4) that no fit may read.
FOLDS, HELD_OUT = 4, 2
#: A document is predicted good from this score on.
THRESHOLD = 0.7
#: Rounds of fitting hidden line labels, steps of each, and the mean that a good document's lines have at least. More rounds score held-out rows worse.
ROUNDS, STEPS, AGREE = 1, 30, 0.95

_CLASSES = {
    "upper": range(ord("A"), ord("Z") + 1),
    "lower": range(ord("a"), ord("z") + 1),
    "digit": range(ord("0"), ord("9") + 1),
    "stop": b".,;:?!",
    "bang": b"!",
    "bar": b"|",
    "odd": b"#$%&*+<=>@[]\\^_`{}~/",
    "space": b" \t\n\v\f\r",
    "high": range(128, 256),
}
_LUTS = {}
for _name, _bytes in _CLASSES.items():
    _LUTS[_name] = np.zeros(256, np.uint8)
    _LUTS[_name][list(_bytes)] = 1
_CUTS = np.array([0.01, 0.05, 0.15, 0.35, 0.6])


def lines_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line that has a word, and the offsets of each text's lines."""
    cut = np.flatnonzero(buf == 10)
    edges = np.union1d(offs, cut + 1)
    starts, ends = edges[:-1], edges[1:]
    full = np.add.reduceat(np.append(~tx.SPACE[buf], False), starts, dtype=np.int64) > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(starts, offs)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]; spans must not be empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[ends] - total[starts]).astype(np.float64)


def line_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, the lines' bytes, and the offsets of each text's lines."""
    starts, ends, at = lines_of(buf, offs)
    size = (ends - starts).astype(np.float64)
    if not len(starts):
        return np.zeros((0, _WIDTH), np.float32), size, at
    share = {k: _sums(lut[buf], starts, ends) / size for k, lut in _LUTS.items()}
    ws, we, _ = tx.word_spans(buf, np.union1d(offs, starts))
    h = tx.span_hashes(buf, ws, we)
    first = np.searchsorted(ws, starts)
    last = np.searchsorted(ws, ends)
    words = (last - first).astype(np.float64)
    same = np.concatenate([[False], h[1:] == h[:-1]])
    same[first] = False  # a line's first word follows none
    odd_end = (_LUTS["odd"] + _LUTS["bang"])[buf[we - 1]]
    line = np.repeat(np.arange(len(starts)), (last - first))
    order = np.lexsort((h, line))
    fresh = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])])
    distinct = np.bincount(line[order][fresh], minlength=len(starts))
    letters = share["upper"] + share["lower"] + share["high"] + 1e-9
    ratios = [
        share["upper"] / letters, share["digit"], share["stop"], share["bang"], share["bar"], share["odd"], share["space"], share["high"],
        _sums(same, first, last) / words, _sums(odd_end, first, last) / words, 1 - distinct / words, _sums((we - ws) <= 3, first, last) / words,
        np.isin(buf[we[last - 1] - 1], list(b".?!:\"'")).astype(float), _LUTS["upper"][buf[ws[first]]].astype(float),
    ]
    sizes = [np.log1p(size) / 8, np.log1p(words) / 6, size / words / 16]
    own = np.stack([*ratios, *sizes], axis=1)
    steps = (own[:, :-3, None] > _CUTS).reshape(len(own), -1)
    return np.concatenate([own, steps], axis=1).astype(np.float32), size, at


_RATIOS, _SIZES = 14, 3
_WIDTH = _RATIOS + _SIZES + _RATIOS * len(_CUTS)


def _ends(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a line is its text's first, and its last."""
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    some = at[1:] > at[:-1]
    first[at[:-1][some]] = True
    last[at[1:][some] - 1] = True
    return first, last


def with_neighbours(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its text, and flags for its ends."""
    n = len(own)
    first, last = _ends(at, n)
    before = np.concatenate([own[:1], own[:-1]]) * ~first[:, None] if n else own
    after = np.concatenate([own[1:], own[-1:]]) * ~last[:, None] if n else own
    return np.concatenate([own, before, after, first[:, None], last[:, None], np.ones((n, 1))], axis=1).astype(np.float32)


@dataclass(frozen=True)
class Crf:
    weights: np.ndarray  # of a line's features, for good against bad
    pairs: np.ndarray  # 2 x 2: of a label after a label

    def logits(self, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The weighted features of `with_neighbours`, summed feature by feature and so alike in any batch."""
        width = own.shape[1]
        first, last = _ends(at, len(own))
        parts = np.zeros((3, len(own)))  # from a line's own features, for itself, the line after and the line before
        for k, column in enumerate(np.ascontiguousarray(own.T).astype(np.float64)):
            for side in range(3):
                parts[side] += column * self.weights[side * width + k]
        before = np.concatenate([[0.0], parts[1][:-1]])[: len(own)]
        after = np.append(parts[2][1:], 0.0)[: len(own)]
        ends = self.weights[3 * width :]
        return parts[0] + np.where(first, 0.0, before) + np.where(last, 0.0, after) + np.where(first, ends[0], 0.0) + np.where(last, ends[1], 0.0) + ends[2]

    def marginals(self, logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line and P(label, next label) summed over each text's chain.

        Chains run side by side, one step of all chains at a time.
        """
        count = np.diff(at)
        order = np.argsort(-count, kind="stable")
        starts, count = at[:-1][order], count[order]
        steps = int(count.max(initial=0))
        live = np.searchsorted(-count, -np.arange(1, steps + 1), "right")  # chains with more than t lines
        pairs, logits = np.exp(self.pairs), np.clip(logits.astype(np.float64), -500, 500)
        emit = np.stack([1 / (1 + np.exp(logits)), 1 / (1 + np.exp(-logits))], axis=1)
        fore, back = np.empty_like(emit), np.ones_like(emit)
        for t in range(steps):
            i = starts[: live[t]] + t
            a = emit[i] if t == 0 else _times(fore[i - 1], pairs) * emit[i]
            fore[i] = a / a.sum(axis=1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            i = starts[: live[t + 1]] + t
            b = _times(emit[i + 1] * back[i + 1], pairs.T)
            back[i] = b / b.sum(axis=1, keepdims=True)
        both = fore * back
        joint = np.zeros((2, 2))
        has = np.ones(len(emit), bool)
        has[at[1:][np.diff(at) > 0] - 1] = False
        i = np.flatnonzero(has)
        if len(i):
            p = fore[i][:, :, None] * pairs[None] * (emit[i + 1] * back[i + 1])[:, None, :]
            joint = (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return both[:, 1] / both.sum(axis=1), joint


def _times(rows: np.ndarray, m: np.ndarray) -> np.ndarray:
    """rows @ m for two columns, in one order of operations however many rows there are."""
    return np.stack([rows[:, 0] * m[0, 0] + rows[:, 1] * m[1, 0], rows[:, 0] * m[0, 1] + rows[:, 1] * m[1, 1]], axis=1)


def mean_score(good: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The byte-weighted mean of each text's marginals; 0 for a text without lines."""
    n = len(at) - 1
    of = np.repeat(np.arange(n), np.diff(at))
    total = np.bincount(of, weights=size, minlength=n)
    return np.clip(np.bincount(of, weights=size * good, minlength=n) / np.where(total > 0, total, 1), 0.0, 1.0)


def tilted(model: Crf, logits: np.ndarray, at: np.ndarray, labels: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and pairs when each document's logits are shifted just so far that its mean agrees with its label."""
    sign = np.where(labels > 0, 1.0, -1.0)

    def agrees(shift: np.ndarray) -> np.ndarray:
        mean = mean_score(model.marginals(logits + np.repeat(sign * shift, np.diff(at)), at)[0], size, at)
        return np.where(labels > 0, mean, 1 - mean) >= AGREE

    lo, hi = np.zeros(len(labels)), np.full(len(labels), 32.0)
    hi[agrees(lo)] = 0.0
    for _ in range(12):
        mid = (lo + hi) / 2
        ok = agrees(mid)
        lo, hi = np.where(ok, lo, mid), np.where(ok, mid, hi)
    return model.marginals(logits + np.repeat(sign * hi, np.diff(at)), at)


def fit(features: np.ndarray, at: np.ndarray, labels: np.ndarray, size: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> Crf:
    """Maximise the conditional likelihood of the lines' labels by Adam, first their documents', then hidden ones."""
    y = np.repeat(labels.astype(np.float64), np.diff(at))
    seen = np.zeros((2, 2))
    _, last = _ends(at, len(y))
    i = np.flatnonzero(~last)
    np.add.at(seen, (y[i].astype(int), y[i + 1].astype(int)), 1)
    theta = np.zeros(features.shape[1] + 4)

    def climb(theta: np.ndarray, y: np.ndarray, seen: np.ndarray, steps: int) -> np.ndarray:
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            good, joint = (model := _crf(theta)).marginals(features @ model.weights, at)
            grad = np.concatenate([features.T @ (good - y), (joint - seen).ravel()]) / max(1, len(y)) + decay * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return theta

    theta = climb(theta, y, seen, rounds)
    for _ in range(ROUNDS):
        y, seen = tilted(model := _crf(theta), features @ model.weights, at, labels, size)
        theta = climb(theta, y, seen, STEPS)
    return _crf(theta)


def _crf(theta: np.ndarray) -> Crf:
    return Crf(theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tx.slices(whole, "text"):
            own, size, at = line_features(*tx.utf8(batch.column(0)))
            fit = (np.diff(at) > 0) & (np.diff(at) <= FIT_LINES)
            packed = [[x[a:b].tobytes() if ok else None for a, b, ok in zip(at[:-1], at[1:], fit, strict=True)] for x in (own, size)]
            yield pa.RecordBatch.from_arrays([*(pa.array(p, pa.binary()) for p in packed), batch.column(1)], names=["features", "sizes", "label"]).filter(pa.array(fit))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> Crf:
    """Fit on at most `most` labelled documents of 1 to FIT_LINES lines outside the held-out fold.

    The sample is those with the smallest hashes of doc_id; their line features,
    not their texts, come to the driver. Of a document's repeated rows the least text
    counts, of its labels the larger. Null labels and doc_ids are left out. Without labelled rows all weights are 0.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    picked = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # `most` rows
    rows = texts.select("text", "label").mapInArrow(_feature_rows, "features binary, sizes binary, label int").collect()
    rows = sorted(rows, key=lambda r: (r["label"], r["features"], r["sizes"]))  # one result whatever the rows' order
    if not rows:
        return Crf(np.zeros(3 * _WIDTH + 3, np.float32), np.zeros((2, 2)))
    size = [np.frombuffer(r["sizes"], np.float64) for r in rows]
    own = np.frombuffer(b"".join(r["features"] for r in rows), np.float32).reshape(-1, _WIDTH)
    at = np.concatenate([[0], np.cumsum([len(x) for x in size])])
    return fit(with_neighbours(own, at), at, np.array([r["label"] for r in rows]), np.concatenate(size))


def _scored(column: pa.Array, model: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of lines of each text."""
    own, size, at = line_features(*tx.utf8(column))
    good, _ = model.marginals(model.logits(own, at), at)
    return mean_score(good, size, at), np.diff(at)


def _score_rows(batches: Iterator[pa.RecordBatch], model: Crf) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tx.slices(whole, "text"):
            score, lines = _scored(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(lines)], names=["doc_id", "score", "n_lines"])


def scores(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, score and n_lines of every document; a text without words scores 0."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return own.mapInArrow(partial(_score_rows, model=model), "doc_id long, score double, n_lines long")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and n_lines of every document, by a model fitted here.

    Every row of `docs` gives one; repeated rows and null doc_ids too (those are not held
    out). Null and empty texts have no line and score 0. Extra columns are ignored. An
    empty table gives no rows; without labels every line is as likely good as bad.
    """
    out = scores(docs, train(docs, labels))
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines")


def _keep_rows(batches: Iterator[pa.RecordBatch], model: Crf, threshold: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tx.slices(whole, "text"):
            score, _ = _scored(batch.column(batch.schema.get_field_index("text")), model)
            yield batch.filter(pa.array(score >= threshold))


def quality_filter(docs: DataFrame, model: Crf, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score at least the threshold, all columns kept, in one pass without a join.

    Null and empty texts score 0 and go unless the threshold is 0.
    """
    return docs.mapInArrow(partial(_keep_rows, model=model, threshold=threshold), docs.schema)
