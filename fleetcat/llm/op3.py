"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages (lines, cut every ``PASSAGE_WORDS`` words).
Each passage is a feature vector (shape of its words, character classes,
repetition, hashed word frequencies); an encoder layer embeds it, gated
attention (tanh times sigmoid) weighs the embeddings inside the document, and
a logistic layer scores the weighted mean.  Encoder, gates and output are
learned together from document labels with Adam; no passage has a label.

Only the fit is bounded: it uses the ``SAMPLE_DOCS`` labelled documents of the
table with the smallest hash of their id (outside the held-out fold).  Of a
document with more than ``SAMPLE_PASSAGES`` passages it uses that many, the
ones with the smallest hash of their place (both bounds are parameters of
``train``).  Scoring covers every passage of every text in one pass without a
shuffle; a long text is read in pieces that begin with a passage, over which
the attention is added up.  The model is a few kilobytes.

Defined cases: null, empty and blank texts are one empty passage.  An id
labelled more than once has the label 1 if the mean is at least 0.5.  Without
labels, or with one class, every score is the smoothed share of 1 among the
labels, and ``keep_quality`` keeps every row.  Rows with a null id are scored and are not held out.  Repeated rows
are scored alike; rows that repeat an id are one row of the fit; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcat.llm import words as W
from fleetcat.llm.runtime import map_arrow

PASSAGE_WORDS = 64
SAMPLE_DOCS = 6000
SAMPLE_PASSAGES = 200
ACCEPT = 0.7
BUCKETS = 32
HIDDEN, GATE = 16, 8
EPOCHS, BATCH_DOCS, RATE, SEED = 30, 64, 0.01, 3

_UPPER, _LOWER, _DIGIT, _SYMBOL, _PIPE, _BANG, _PUNCT, _HIGH = range(8)
_CLASS = np.full(256, 8, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:256] = _UPPER, _LOWER, _DIGIT, _HIGH
for _c in b"#*$%&<>@^~=+_\\":
    _CLASS[_c] = _SYMBOL
for _c in b".,;:?'\"()-/[]{}`":
    _CLASS[_c] = _PUNCT
_CLASS[ord("|")], _CLASS[ord("!")] = _PIPE, _BANG
DENSE = 8 + 6
FEATURES = DENSE + BUCKETS


def passage_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each row); a row without words is one empty passage."""
    w = W.Words(raw, off, lower=True)
    n, rows = len(w.starts), len(off) - 1
    first_word = np.zeros(n + 1, bool)
    row = np.repeat(np.arange(rows), np.diff(w.bounds))
    if n:
        line = np.searchsorted(np.flatnonzero(w.raw == 10), w.starts)
        first_word[:n] = np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])])
        heads = np.flatnonzero(first_word[:n])
        since = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
        first_word[:n] |= since % PASSAGE_WORDS == 0
    lo = np.flatnonzero(first_word[:n])
    hi = np.append(lo[1:], n)[:len(lo)]
    x = np.zeros((len(lo), FEATURES), np.float32)
    if n:
        count = (hi - lo).astype(np.float32)
        kinds = _CLASS[w.raw]
        a, b = w.starts[lo], w.ends[hi - 1]
        spans = np.stack([a, b], axis=1).reshape(-1)  # each passage, and what lies between it and the next
        for k in range(8):
            hit = np.append(kinds == k, False)
            x[:, k] = np.add.reduceat(hit, spans, dtype=np.int64)[::2]
        letters = np.maximum(x[:, :8].sum(axis=1), 1)
        x[:, :8] /= letters[:, None]
        size = (w.ends - w.starts).astype(np.float32)
        h = w.hashes
        same = np.zeros(n, np.float32)
        same[1:] = (h[1:] == h[:-1]) & ~first_word[1:n]
        head = kinds[w.starts]
        passage = np.repeat(np.arange(len(lo), dtype=np.uint64), hi - lo)
        key = np.sort((passage << np.uint64(40)) | (h >> np.uint64(24)))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(lo))
        x[:, 8] = np.log1p(count) / 5
        x[:, 9] = np.add.reduceat(size, lo) / count / 10
        x[:, 10] = np.add.reduceat(same, lo) / count
        x[:, 11] = distinct / count
        x[:, 12] = np.add.reduceat((head == _UPPER).astype(np.float32), lo) / count
        x[:, 13] = np.add.reduceat((size <= 3).astype(np.float32), lo) / count
        bucket = passage.astype(np.int64) * BUCKETS + (h >> np.uint64(59)).astype(np.int64)
        x[:, DENSE:] = np.bincount(bucket, minlength=len(lo) * BUCKETS).reshape(-1, BUCKETS) / count[:, None]
    per_row = np.bincount(row[lo], minlength=rows) if n else np.zeros(rows, np.int64)
    if (per_row == 0).any():  # a row without words: one passage of zeros
        at = np.concatenate([[0], np.cumsum(per_row)])[:-1][per_row == 0]
        x = np.insert(x, at, 0, axis=0)
        per_row = np.maximum(per_row, 1)
    return x, np.concatenate([[0], np.cumsum(per_row)])[:-1]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _encoded(m: dict, x: np.ndarray) -> dict:
    """Embeddings of passages, their gates and their attention before it is normalised."""
    z = (x - m["mean"]) / m["scale"]
    h = np.tanh(z @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    return {"z": z, "h": h, "t": t, "g": g, "e": (t * g) @ m["w"]}


def forward(m: dict, x: np.ndarray, first: np.ndarray) -> dict:
    """Scores of bags (``first``: first passage of each) and what the gradient needs."""
    bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    f = _encoded(m, x)
    e = np.exp(f["e"] - np.maximum.reduceat(f["e"], first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    pooled = np.add.reduceat(a[:, None] * f["h"], first, axis=0)
    return f | {"a": a, "bag": bag, "pooled": pooled, "score": _sigmoid(pooled @ m["c"] + m["d"])}


def _gradient(m: dict, f: dict, first: np.ndarray, y: np.ndarray) -> dict:
    dy = (f["score"] - y) / len(y)
    dpool = dy[:, None] * m["c"]
    h, a, bag = f["h"], f["a"], f["bag"]
    dh = a[:, None] * dpool[bag]
    da = (dpool[bag] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, first)[bag])
    du = de[:, None] * m["w"]
    dt, dg = du * f["g"] * (1 - f["t"] ** 2), du * f["t"] * f["g"] * (1 - f["g"])
    dh += dt @ m["V"].T + dg @ m["U"].T
    dz = dh * (1 - h ** 2)
    return {"W": f["z"].T @ dz, "b": dz.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (f["t"] * f["g"]).T @ de,
            "c": f["pooled"].T @ dy, "d": dy.sum()}


def fit(bags: list[np.ndarray], y: np.ndarray) -> dict:
    """Model from bags of passages and their labels (0/1)."""
    prior = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
    if len(y) == 0 or y.min() == y.max():
        return {"constant": prior}
    rng = np.random.default_rng(SEED)
    every = np.concatenate(bags)
    m = {"mean": every.mean(axis=0), "scale": every.std(axis=0) + 0.02}
    p = {"W": rng.normal(0, 0.3, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)),
         "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(())}
    m |= p
    s1, s2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for i in range(0, len(order), BATCH_DOCS):
            pick = order[i:i + BATCH_DOCS]
            x = np.concatenate([bags[k] for k in pick]).astype(np.float64)
            first = np.concatenate([[0], np.cumsum([len(bags[k]) for k in pick])])[:-1]
            grad = _gradient(m, forward(m, x, first), first, y[pick])
            step += 1
            for k, g in grad.items():
                g = g + (1e-4 * m[k] if k != "d" else 0)
                s1[k] = 0.9 * s1[k] + 0.1 * g
                s2[k] = 0.999 * s2[k] + 0.001 * g * g
                m[k] = m[k] - rate * (s1[k] / (1 - 0.9 ** step)) / (np.sqrt(s2[k] / (1 - 0.999 ** step)) + 1e-8)
    return m


def pieces(raw: np.ndarray, lo: int, hi: int, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts a long text at the starts of passages, into pieces of about ``limit`` bytes."""
    size = limit
    while lo < hi:
        end = min(lo + size, hi)
        if end < hi:
            lines = np.flatnonzero(raw[lo:end] == 10)
            if len(lines):
                end = lo + int(lines[-1]) + 1
            else:
                w = W.Words(raw, np.array([lo, end]))
                whole = (len(w.starts) - 1) // PASSAGE_WORDS * PASSAGE_WORDS
                if whole <= 0:  # not yet a passage: look at more of the line
                    size *= 2
                    continue
                end = lo + int(w.starts[whole])
        yield lo, end
        lo, size = end, limit


def _piece_features(raw: np.ndarray, lo: int, hi: int) -> Iterator[np.ndarray]:
    """Features of a long text's passages, piece by piece (none for blank pieces)."""
    for a, b in pieces(raw, lo, hi, W.SLICE_BYTES):
        if not W.IS_SPACE[raw[a:b]].all():
            yield passage_features(raw, np.array([a, b]))[0]


def _long_score(m: dict, raw: np.ndarray, lo: int, hi: int) -> float:
    """Score of one long text: attention is added up over its pieces, relative to the greatest so far."""
    top, total, pooled = -np.inf, 0.0, np.zeros(HIDDEN)
    for x in _piece_features(raw, lo, hi):
        f = _encoded(m, x.astype(np.float64))
        now = max(top, float(f["e"].max()))
        e = np.exp(f["e"] - now)
        shrink = np.exp(top - now)
        total, pooled, top = total * shrink + e.sum(), pooled * shrink + e @ f["h"], now
    return float(_sigmoid(pooled / total @ m["c"] + m["d"]))


def _is_long(raw: np.ndarray, off: np.ndarray) -> bool:
    return len(off) == 2 and off[1] - off[0] > 2 * W.SLICE_BYTES and not W.IS_SPACE[raw[off[0]:off[1]]].all()


def scores(m: dict, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    if "constant" in m:
        return np.full(len(off) - 1, m["constant"])
    out = []
    for i, j in W.slices(off):
        if _is_long(raw, off[i:j + 1]):
            out.append(np.array([_long_score(m, raw, int(off[i]), int(off[j]))]))
        else:
            x, first = passage_features(raw, off[i:j + 1])
            out.append(forward(m, x.astype(np.float64), first)["score"])
    return np.round(np.concatenate(out), 9) if out else np.zeros(0)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def passage_order(first: int, n: int) -> np.ndarray:
    """Hash of the places first, ..., first + n - 1 of a document's passages; the fit takes the smallest."""
    return W.mix64(np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sampled(parts: Iterator[np.ndarray], limit: int) -> np.ndarray:
    """``limit`` passages at most of one document, in order, from the features of its pieces."""
    place, kept, order = 0, [], np.zeros(0, np.uint64)
    for x in parts:
        kept.append(x)
        order = np.concatenate([order, passage_order(place, len(x))])
        place += len(x)
        if len(order) > limit:
            least = np.sort(np.argsort(order, kind="stable")[:limit])
            kept, order = [np.concatenate(kept)[least]], order[least]
    return np.concatenate(kept)


def _bags(batches, limit: int):
    for batch in batches:
        raw, off = W.text_buffer(batch.column(1))
        for i, j in W.slices(off):
            if _is_long(raw, off[i:j + 1]):
                bags = [_sampled(_piece_features(raw, int(off[i]), int(off[j])), limit)]
            else:
                x, first = passage_features(raw, off[i:j + 1])
                bags = [_sampled(iter([x[a:b]]), limit) for a, b in zip(first, np.append(first[1:], len(x)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array([x.astype(np.float16).tobytes() for x in bags], pa.binary())], names=["y", "bag"])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """(y, text) of the ``sample_docs`` labelled documents of the table with the smallest id hash, outside the held-out fold.

    Labels of documents that are not in the table take no place; of rows that
    repeat an id the one with the smallest text hash is taken.
    """
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("l"), F.col("quality").cast("double").alias("q"))
    known = known.withColumn("out", held_out("l")).where("not out").groupBy("l").agg(F.avg("q").alias("q"))
    texts = docs.select(F.col("doc_id").cast("long").alias("l"), F.col("text").cast("string").alias("text"))
    present = texts.select("l").distinct().join(known, "l").orderBy(F.xxhash64("l"), "l").limit(sample_docs)
    rows = texts.join(F.broadcast(present), "l").groupBy("l").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row"), F.first("q").alias("q"))
    return rows.select((F.col("q") >= 0.5).cast("double").alias("y"), "row.text")


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_passages: int = SAMPLE_PASSAGES) -> dict:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    rows = labelled_sample(docs, labels, sample_docs)
    got = map_arrow(rows, partial(_bags, limit=sample_passages), "y double, bag binary").collect()  # sample_docs bags of sample_passages at most
    got.sort(key=lambda r: (bytes(r[1]), r[0]))  # the fit does not depend on the order in which tasks end
    return fit([np.frombuffer(r[1], np.float16).reshape(-1, FEATURES).astype(np.float32) for r in got], np.array([r[0] for r in got]))


def _score(batches, model: dict):
    for batch in batches:
        raw, off = W.text_buffer(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, raw, off), pa.float64())], names=["doc_id", "score"])


def score_documents(docs: DataFrame, model: dict, accept: float = ACCEPT) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = map_arrow(rows, partial(_score, model=model), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def _keep(batches, model: dict, accept: float, column: int):
    for batch in batches:
        raw, off = W.text_buffer(batch.column(column))
        yield batch.filter(pa.array(scores(model, raw, off) >= accept))


def keep_quality(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the classifier accepts; all rows if there is nothing to learn from."""
    model = train(docs, labels)
    if "constant" in model:
        return docs
    return map_arrow(docs, partial(_keep, model=model, accept=accept, column=docs.columns.index("text")), docs.schema)
