"""Benchmark decontamination: size-partitioned MinHash containment search, exact shingle check.

Short test items sit inside long documents, where the Jaccard similarity of
the two is tiny.  So items are partitioned by size (class c: 2^c to 2^(c+1)-1
distinct shingles), and for each class the documents are read in overlapping
windows of 2^(c+2) shingles, which step by half; every run of 2^(c+1) shingles
lies in one window.  An item of which 80 % is contained in a window then has a
Jaccard similarity of at least 0.19 with it, whatever the document's length.

Minima of 64 universal hash functions are taken once per block of the smallest
class and merged pairwise for the larger ones.  A window and an item of its
class that agree in any of the 64 minima are a candidate (one-row bands): an
item at the containment threshold is missed with probability 1.4e-6.
Candidates are verified exactly: distinct item shingles found in the whole
document over all distinct item shingles.

Items are the stated query set.  They are dealt into blocks of bounded size by
a hash of their id; each block is broadcast and meets all documents in one
pass, so a larger benchmark means more passes, not more memory.

An item of fewer words than a shingle is one shingle of its own length; such
shingles are looked up in the same pass.

Defined cases: texts are lower-cased (A-Z); null and blank texts match nothing.  Items that repeat an id are
separate items with the same id; identical result rows come once.  Rows
without an id take no part.  Empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcat.llm import words as W
from fleetcat.llm.runtime import map_arrow, written

SHINGLE_WORDS = 5
THRESHOLD = 80  # percent of an item's shingles
HASHES = 64
BLOCK_BYTES = 32 << 20  # item text per broadcast block; texts cost at most about 3 times that in a worker
SEED = 1

_SCHEMA = "doc_id long, item_id long, n_shared long, n_item long"


class ItemIndex:
    """Signatures and shingle sets of one block of items."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int, hashes: int):
        a, b = W.universal(hashes, SEED)
        raw, off = W.text_buffer(pa.array(texts, pa.string()))
        self.ids, self.sets = [], []
        short: dict[int, list] = {}  # items of fewer words than a shingle, by their length
        long = []
        for i, j in W.slices(off):
            w = W.Words(raw, off[i:j + 1])
            sizes = np.diff(w.bounds)
            for row, n, lo, s in zip(ids[i:j], sizes.tolist(), w.bounds.tolist(), W.shingle_sets(w, k, short=False)):
                if len(s):
                    long.append(len(self.ids))
                elif n:
                    s = W.shingle_hashes(w.hashes[lo:lo + n], n)
                    short.setdefault(n, []).append((s[0], len(self.ids)))
                else:
                    continue
                self.ids.append(row)
                self.sets.append(s)
        self.short = {}
        for n, entries in short.items():
            entries.sort()
            self.short[n] = (np.array([x for x, _ in entries], np.uint64), np.array([at for _, at in entries], np.int64))
        self.classes = sorted({len(self.sets[at]).bit_length() - 1 for at in long})
        keys: dict[int, list] = {c: [] for c in self.classes}
        for at in long:
            keys[len(self.sets[at]).bit_length() - 1].append((at, probe_keys(W.minima(self.sets[at], a, b)[None, :])[0]))
        self.probes = {}
        for c, entries in keys.items():
            key = np.concatenate([x for _, x in entries])
            item = np.repeat(np.array([at for at, _ in entries], np.int64), hashes)
            order = np.argsort(key, kind="stable")
            key, item = key[order], item[order]
            bits = max(16, int(len(key)).bit_length() + 4)
            seen = np.zeros(1 << bits, bool)
            seen[(key & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
            self.probes[c] = (key, item, seen, np.uint64((1 << bits) - 1))


def probe_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key per (hash function, least value) of each signature row."""
    which = np.arange(1, minima.shape[1] + 1, dtype=np.uint64)[None, :]
    return W.mix64((which << np.uint64(32)) | minima.astype(np.uint64))


def _block_minima(sh: np.ndarray, size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signature of each run of ``size`` shingles (the last may be shorter)."""
    n = -(-len(sh) // size)
    out = np.empty((n, len(a)), np.uint32)
    step = max(1, 4096 // size)  # blocks per vectorised step
    for i in range(0, n, step):
        x = sh[i * size:(i + step) * size]
        v = ((x[:, None] * a[None, :] + b[None, :]) >> np.uint64(32)).astype(np.uint32)
        out[i:i + step] = np.minimum.reduceat(v, np.arange(0, len(x), size), axis=0)
    return out


def _candidates(sh: np.ndarray, index: ItemIndex, a: np.ndarray, b: np.ndarray) -> set[int]:
    """Items that share a least value with a window of their size class."""
    found: set[int] = set()
    if not len(sh) or not index.classes:
        return found
    level = index.classes[0]
    blocks = _block_minima(sh, 1 << (level + 1), a, b)
    for c in index.classes:
        while level < c:  # a block of the next class is two of this one
            blocks = np.minimum.reduceat(blocks, np.arange(0, len(blocks), 2), axis=0)
            level += 1
        known, item, seen, mask = index.probes[c]
        last = max(1, len(blocks) - 1)
        for lo in range(0, last, 1024):
            window = np.minimum(blocks[lo:lo + 1024][:last - lo], blocks[lo + 1:lo + 1025]) if len(blocks) > 1 else blocks
            key = probe_keys(window).reshape(-1)
            key = key[seen[(key & mask).astype(np.int64)]]
            if len(key):
                left, right = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
                for x, y in zip(left[right > left].tolist(), right[right > left].tolist()):
                    found.update(item[x:y].tolist())
    return found


def _hits(raw: np.ndarray, off: np.ndarray, index: ItemIndex, k: int, threshold: int, a: np.ndarray, b: np.ndarray):
    """(row, item, shared shingles) of every verified hit."""
    for i, j in W.slices(off):
        w = W.Words(raw, off[i:j + 1])
        sh = W.shingle_hashes(w.hashes, k)
        for n, (known, item) in index.short.items():  # one shingle of the item's own length
            runs = W.shingle_hashes(w.hashes, n)
            at = np.searchsorted(known, runs)
            at[at == len(known)] = 0
            hit = np.flatnonzero(known[at] == runs)
            row = np.searchsorted(w.bounds, hit, side="right") - 1
            inside = hit + n <= w.bounds[row + 1]
            for r, key in sorted(set(zip(row[inside].tolist(), runs[hit[inside]].tolist()))):
                lo, hi = np.searchsorted(known, np.uint64(key), "left"), np.searchsorted(known, np.uint64(key), "right")
                for x in item[lo:hi].tolist():
                    yield i + r, x, 1
        for r in range(j - i):
            own = sh[w.bounds[r]:max(w.bounds[r], w.bounds[r + 1] - k + 1)]
            found = _candidates(own, index, a, b)
            if found:
                have = W.distinct(own)
                for at in sorted(found):
                    shared = W.intersection_size(index.sets[at], have)
                    if 100 * shared >= threshold * len(index.sets[at]):
                        yield i + r, at, shared


def _search(index_of, k: int, threshold: int, hashes: int):
    def run(batches):
        index: ItemIndex = index_of.value
        a, b = W.universal(hashes, SEED)
        for batch in batches:
            raw, off = W.text_buffer(batch.column(1))
            ids = batch.column(0)
            rows = [(ids[r].as_py(), index.ids[at], shared, len(index.sets[at])) for r, at, shared in _hits(raw, off, index, k, threshold, a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in range(4)],
                                             names=["doc_id", "item_id", "n_shared", "n_item"])
    return run


def _keep_clean(index_of, column: int, k: int, threshold: int, hashes: int):
    def run(batches):
        index: ItemIndex = index_of.value
        a, b = W.universal(hashes, SEED)
        for batch in batches:
            raw, off = W.text_buffer(batch.column(column))
            clean = np.ones(batch.num_rows, bool)
            for r, _, _ in _hits(raw, off, index, k, threshold, a, b):
                clean[r] = False
            yield batch.filter(pa.array(clean))
    return run


def _blocks(benchmark: DataFrame, shingle: int, hashes: int, block_bytes: int):
    """Broadcast indexes of the items, in blocks of bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for at in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == at).collect()  # one block: bounded by block_bytes
        yield spark.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows], shingle, hashes))


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE_WORDS, threshold: int = THRESHOLD,
                 hashes: int = HASHES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, n_shared, n_item, containment."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .where("doc_id is not null and text is not null")
    out = None
    for index in _blocks(benchmark, shingle, hashes, block_bytes):
        part = map_arrow(texts, _search(index, shingle, threshold, hashes), _SCHEMA)
        out = part if out is None else out.union(part)
    return out.distinct().withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE_WORDS, threshold: int = THRESHOLD,
                      hashes: int = HASHES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text contains no benchmark item; one filtering pass per block, without a shuffle."""
    column = docs.columns.index("text")
    left = docs
    for n, index in enumerate(_blocks(benchmark, shingle, hashes, block_bytes)):
        left = written(left, "clean") if n else left  # one block's index in a worker at a time
        left = map_arrow(left, _keep_clean(index, column, shingle, threshold, hashes), docs.schema)
    return left
