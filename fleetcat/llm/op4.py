"""Quality rules: gradient-boosted trees over document statistics, scored from flat node arrays.

Statistics are computed for every whole text in one vectorised pass without a
shuffle.  The trees (log loss, histogram splits, Newton leaves) are fitted on
a bounded sample of labelled documents and flattened into five arrays
(feature, threshold, left, right, value); scoring moves all documents through
all trees one level at a time.  ``MONOTONE`` features may only lower the score
as they grow: a split that breaks this is not allowed, and the bounds of a
monotone split hold in its whole subtree.

Only the fit is bounded: the ``SAMPLE_DOCS`` labelled documents of the table
with the smallest hash of their id, outside the held-out fold (crc32(id) % 4 = 2).

Defined cases: a null text has no words and fails the base rule, as does any
text under 50 words.  An id labelled more than once has the label 1 if the
mean is at least 0.5.  Without labels, or with one class, the method keeps
whatever the base rule keeps.  Rows with a null id are judged; repeated rows
are judged alike; rows that repeat an id are one row of the fit; extra columns
are never read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcat.llm import words as W
from fleetcat.llm.op3 import labelled_sample
from fleetcat.llm.runtime import map_arrow

SAMPLE_DOCS = 20_000
TREES, DEPTH, BINS, RATE, LEAF_MIN, L2 = 60, 4, 64, 0.2, 20.0, 1.0
MIN_WORDS, REPEAT_PERCENT = 50, 50
KEEP = 0.5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbol_ratio", "repeat_ratio", "dup_line_ratio", "upper_ratio", "bang_ratio", "same_as_before_ratio",
          "log_words", "mean_word", "digit_ratio", "punct_ratio", "words_per_line", "short_word_ratio"]
MONOTONE = {"symbol_ratio": -1, "repeat_ratio": -1, "dup_line_ratio": -1, "upper_ratio": -1, "bang_ratio": -1, "same_as_before_ratio": -1}

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:?!'\"()-")] = True


def _per_row(flags, b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions of each row at which ``flags`` of the bytes (and of the byte before) holds, block by block."""
    out = np.zeros(len(off) - 1, np.int64)
    for lo in range(0, len(b), W.BLOCK_BYTES):
        part = b[lo:lo + W.BLOCK_BYTES]
        c = np.concatenate([[0], np.cumsum(flags(part, np.concatenate([b[lo - 1:lo] if lo else np.zeros(1, np.uint8), part[:-1]])), dtype=np.int64)])
        at = np.clip(off - lo, 0, len(part))
        out += c[at[1:]] - c[at[:-1]]
    return out


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def statistics(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base counts [rows, 5] as integers, ratios [rows, len(RATIOS)])."""
    w = W.Words(raw, off, lower=False)
    b, off, rows = w.bytes, w.off, len(off) - 1
    n_words = np.diff(w.bounds)
    chars = _per_row(lambda x, _: ~W.IS_SPACE[x] & ((x & 0xC0) != 0x80), b, off)
    symbols = _per_row(lambda x, _: _SYMBOLS[x], b, off)
    # lines with a word; a line equal to an earlier one of its text
    cuts = np.flatnonzero(b == 10)
    lo = np.sort(np.concatenate([off[:-1], cuts + 1]))
    lo_row = np.searchsorted(off, lo, side="right") - 1  # a line that starts where a text ends belongs to no text: it is empty
    hi = np.minimum(np.concatenate([np.append(lo[1:], len(b))]), len(b))
    newline_before_next = np.zeros(len(lo), np.int64)
    inside = hi > lo
    newline_before_next[inside] = b[hi[inside] - 1] == 10
    hi = hi - newline_before_next
    at = np.minimum(np.searchsorted(w.ends, lo, side="right"), max(len(w.ends) - 1, 0))
    worded = (hi > lo) & (w.starts[at] < hi) & (w.ends[at] > lo) if len(w.ends) else np.zeros(len(lo), bool)
    lo, hi, lo_row = lo[worded], hi[worded], lo_row[worded]
    line_key = W.mix64(W.range_hashes(b, lo, hi) + lo_row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    n_lines = np.bincount(lo_row, minlength=rows)
    _, first = np.unique(line_key, return_index=True)
    dup_lines = n_lines - np.bincount(lo_row[first], minlength=rows)
    # words in 3-word windows that occur twice or more in their text
    h = w.hashes
    n = len(h)
    row = np.repeat(np.arange(rows), n_words)
    covered = np.zeros(n, bool)
    if n >= 3:
        tri = W.mix64(W.shingle_hashes(h, 3) + row[:-2].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        whole = np.flatnonzero(row[2:] == row[:-2])
        hit = whole[_repeats(tri[whole])]
        for k in range(3):
            covered[hit + k] = True
    bounds = w.bounds

    def words_with(flags):
        c = np.concatenate([[0], np.cumsum(flags)])
        return c[bounds[1:]] - c[bounds[:-1]]

    repeat = words_with(covered)
    same = np.zeros(n, bool)
    if n:
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    base = np.stack([n_words, chars, symbols, dup_lines, repeat], axis=1).astype(np.int64)
    nw, nc = np.maximum(n_words, 1), np.maximum(chars, 1)
    ratios = np.stack([
        symbols / nc, repeat / nw, dup_lines / np.maximum(n_lines, 1),
        _per_row(lambda x, before: ((x >= 65) & (x <= 90)) | ((before == 0xC3) & (x >= 0x80) & (x <= 0x9E)), b, off) / nc,
        _per_row(lambda x, _: x == ord("!"), b, off) / nc, words_with(same) / nw, np.log1p(n_words), chars / nw,
        _per_row(lambda x, _: (x >= 48) & (x <= 57), b, off) / nc, _per_row(lambda x, _: _PUNCT[x], b, off) / nc, n_words / np.maximum(n_lines, 1),
        words_with(w.ends - w.starts <= 3) / nw], axis=1)
    return base, ratios


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > REPEAT_PERCENT * base[:, 0])


class Trees:
    """Boosted trees as flat node arrays; a leaf points to itself."""

    def __init__(self, prior: float):
        self.prior = prior
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = [], [], [], [], [], []

    def node(self, value: float) -> int:
        k = len(self.feature)
        self.feature.append(0)
        self.threshold.append(np.inf)
        self.left.append(k)
        self.right.append(k)
        self.value.append(value)
        return k

    def freeze(self) -> Trees:
        for name, kind in (("feature", np.int32), ("threshold", np.float64), ("left", np.int32), ("right", np.int32), ("value", np.float64), ("roots", np.int32)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; every step moves all rows one level down in all trees."""
        total = np.full(len(x), self.prior)
        if len(self.roots) and len(x):
            at = np.broadcast_to(self.roots[None, :], (len(x), len(self.roots))).copy()
            rows = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] < self.threshold[at], self.left[at], self.right[at])
            total = total + self.value[at].sum(axis=1)
        return np.round(1 / (1 + np.exp(-np.clip(total, -40, 40))), 9)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Newton boosting of the log loss with histogram splits under ``MONOTONE``."""
    ones, n = float(y.sum()) if len(y) else 0.0, len(y)
    model = Trees(float(np.log((ones + 1) / (n - ones + 1))))
    if n == 0 or ones in (0, n):
        model.prior = 20.0  # nothing to learn from: keep
        return model.freeze()
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)
    sign = [MONOTONE.get(name, 0) for name in RATIOS]
    margin = np.full(n, model.prior)

    def leaf(g, h, low, high):
        return float(np.clip(-g / (h + L2), low, high))

    def grow(rows, depth, low, high):
        g, h = grad[rows], hess[rows]
        sg, sh = g.sum(), h.sum()
        value = leaf(sg, sh, low, high)
        k = model.node(RATE * value)
        best = None
        if depth < DEPTH and len(rows) >= 2 * LEAF_MIN:
            base = sg * sg / (sh + L2)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                m = len(e) + 1
                gl = np.cumsum(np.bincount(bins[rows, f], g, m))[:-1]
                hl = np.cumsum(np.bincount(bins[rows, f], h, m))[:-1]
                nl = np.cumsum(np.bincount(bins[rows, f], minlength=m))[:-1]
                gain = gl ** 2 / (hl + L2) + (sg - gl) ** 2 / (sh - hl + L2) - base
                vl, vr = np.clip(-gl / (hl + L2), low, high), np.clip(-(sg - gl) / (sh - hl + L2), low, high)
                bad = (nl < LEAF_MIN) | (len(rows) - nl < LEAF_MIN)
                if sign[f]:
                    bad |= sign[f] * (vr - vl) < 0
                gain[bad] = -np.inf
                at = int(np.argmax(gain))
                if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                    best = (gain[at], f, at, vl[at], vr[at])
        if best is None:
            margin[rows] += RATE * value
            return k
        _, f, at, vl, vr = best
        goes = bins[rows, f] <= at
        mid = (vl + vr) / 2
        left_bounds = (low, mid) if sign[f] > 0 else (mid, high) if sign[f] < 0 else (low, high)
        right_bounds = (mid, high) if sign[f] > 0 else (low, mid) if sign[f] < 0 else (low, high)
        model.feature[k], model.threshold[k] = f, float(edges[f][at])
        model.left[k] = grow(rows[goes], depth + 1, *left_bounds)
        model.right[k] = grow(rows[~goes], depth + 1, *right_bounds)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        model.roots.append(grow(np.arange(n), 0, -4.0, 4.0))
    return model.freeze()


def _sample(batches):
    for batch in batches:
        raw, off = W.text_buffer(batch.column(1))
        for i, j in W.slices(off):
            _, ratios = statistics(raw, off[i:j + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(list(ratios), pa.list_(pa.float64()))], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Trees:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    got = map_arrow(labelled_sample(docs, labels, sample_docs), _sample, "y double, x array<double>").collect()  # sample_docs rows at most
    got.sort()  # the fit does not depend on the order in which tasks end
    return fit(np.array([r[1] for r in got]).reshape(-1, len(RATIOS)), np.array([r[0] for r in got]))


def _judge(batches, model: Trees):
    for batch in batches:
        raw, off = W.text_buffer(batch.column(1))
        for i, j in W.slices(off):
            base, ratios = statistics(raw, off[i:j + 1])
            failed, score = base_failed(base), model.predict(ratios)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), *[pa.array(base[:, k]) for k in range(5)], pa.array(failed),
                 pa.array(~failed & (score >= KEEP)), pa.array(score)],
                names=["doc_id", *BASE, "base_failed", "kept", "score"])


def judge(docs: DataFrame, model: Trees) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept and the trees' score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, partial(_judge, model=model),
                     "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double")
