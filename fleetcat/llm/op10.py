"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts, probed level by level.

Training (all documents outside the held-out fold)
  Tasks count unigrams and bigrams of whole texts, add them up per batch and
  send them, packed, to the segment that the n-gram's hash names.  A segment
  sums its counts and keeps (a) its unigrams with exact counts, which only the
  add-one base score uses, and (b) a Bloom filter that holds, for an n-gram of
  count c, the keys (n-gram, 1) ... (n-gram, q(c)), q(c) = 1 + floor(log_1.5 c).
  Segments are rows of a written table; their number follows the input's size,
  so the size of one does not.

Scoring
  A count is read back by probing levels 1, 2, ... until one is missing; the
  level's middle stands for the count.  With u before w (the end token stands
  before the first word),
      P(w|u) = (c(u,w) + MU * P1(w)) / (max(c(u), c(u,w)) + MU),
      P1(w)  = (c(w) + 1) / (N + V + 1).
  Segments are broadcast in groups of at most ``GROUP_BYTES``.  If all fit in
  one group, one pass scores the documents.  Else a first series of passes
  stores each token's unigram level (a byte per token) and a second adds up
  the bigram terms; each pass is a written table, and results do not depend on
  the grouping.

Defined cases: null, empty and blank texts are the end token alone.  Rows with
a null id train and are scored, and are not held out.  Repeated rows count and
are scored each; extra columns are ignored.  An empty table gives no rows;
without training tokens all probabilities are 1 / (V + 1) = 1.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcat.llm import words as W
from fleetcat.llm.runtime import map_arrow, prepare, written

BASE = 1.5
LEVELS = 120
BITS_PER_KEY, PROBES = 10, 5
SEGMENT_TEXT = 64 << 20  # bytes of training text per segment
GROUP_BYTES = 192 << 20  # broadcast at once
FLUSH_TOKENS = 3_000_000
MU = 64.0
END = np.uint64(0x9D39247E33776D41)

_LOW48 = np.uint64((1 << 48) - 1)
_SEGMENT = "seg int, uh binary, uc binary, bh binary, bc binary"
_TABLE = "seg int, n long, v long, uh binary, uc binary, bits long, bloom binary"

# the count that stands for a level: middle of the integers whose level it is
_reach = np.ceil(np.round(BASE ** np.arange(LEVELS + 1, dtype=np.float64), 9))
LEVEL_COUNT = np.concatenate([[0.0], np.maximum((_reach[:-1] + _reach[1:] - 1) / 2, _reach[:-1])])


def level_of(counts: np.ndarray) -> np.ndarray:
    """q(c): number of levels whose least count is at most c."""
    return np.searchsorted(_reach, counts, side="right").astype(np.int64)


def tokens(w: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of rows 0..k-1, each ending in END; tokens per row)."""
    counts = np.diff(w.bounds)
    t = np.insert(w.hashes, w.bounds[1:], END)
    return t, counts + 1


def bigrams(t: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of (token before, token); END stands before a row's first token."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[np.cumsum(counts) - counts] = END
    return W.mix64(before * np.uint64(0xA24BAED4963EE407) + t)


def segment_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _tally(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.diff(np.append(first, len(s)))


def _pack48(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Six bytes a key and one a count; larger counts repeat the key."""
    times = (counts + 254) // 255
    keys = np.repeat(keys & _LOW48, times)
    left = np.full(len(keys), 255, np.int64)
    left[np.cumsum(times) - 1] = counts - (times - 1) * 255
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), left.astype(np.uint8).tobytes()


def _unpack48(keys: bytes) -> np.ndarray:
    wide = np.zeros((len(keys) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def _count(bits: int):
    def flush(uni, bi):
        u, uc = _tally(uni)
        b, bc = _tally(bi)
        useg, bseg = segment_of(u, bits), segment_of(b, bits)
        segments = np.union1d(useg, bseg)  # those that occur
        ends = np.append(segments, 1 << bits)
        ua, ba = np.searchsorted(useg, ends), np.searchsorted(bseg, ends)
        rows = []
        for at, s in enumerate(segments.tolist()):
            uh, c = u[ua[at]:ua[at + 1]], uc[ua[at]:ua[at + 1]]
            bh, bcount = _pack48(b[ba[at]:ba[at + 1]], bc[ba[at]:ba[at + 1]])
            rows.append((s, uh.tobytes(), c.astype("<i8").tobytes(), bh, bcount))
            if len(rows) == 64 or at + 1 == len(segments):
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(x, pa.binary()) for x in cols[1:]]],
                                                 names=["seg", "uh", "uc", "bh", "bc"])
                rows = []

    def run(batches):
        uni, bi, n = [], [], 0
        for batch in batches:
            raw, off = W.text_buffer(batch.column(0))
            for i, j in W.slices(off):
                t, counts = tokens(W.Words(raw, off[i:j + 1]), j - i)
                uni.append(t)
                bi.append(bigrams(t, counts))
                n += len(t)
                if n >= FLUSH_TOKENS:
                    yield from flush(uni, bi)
                    uni, bi, n = [], [], 0
        if n:
            yield from flush(uni, bi)
    return run


def positions(keys: np.ndarray, level: np.ndarray | int, bits: np.ndarray | int) -> np.ndarray:
    """Bit positions [PROBES, n] of the keys (n-gram, level) in filters of ``bits`` bits."""
    x = W.mix64(keys + np.asarray(level, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.asarray(bits, np.uint64) for i in range(PROBES)]).astype(np.int64)


def _build(table, bits_per_key):
    seg = table.column("seg")[0].as_py()
    parts = {c: [x.as_py() for x in table.column(c)] for c in ("uh", "uc", "bh", "bc")}
    u, uc = _sums(np.concatenate([np.frombuffer(x, "<u8") for x in parts["uh"]]), np.concatenate([np.frombuffer(x, "<i8") for x in parts["uc"]]))
    b, bc = _sums(np.concatenate([_unpack48(x) for x in parts["bh"]]), np.concatenate([np.frombuffer(x, np.uint8) for x in parts["bc"]]).astype(np.int64))
    keys = np.concatenate([_filter_key(u, seg, 1), _filter_key(b, seg, 2)])
    top = level_of(np.concatenate([uc, bc]))
    size = max(64, -(-int(top.sum()) * bits_per_key // 64) * 64)
    flags = np.zeros(size, bool)
    for level in range(1, int(top.max()) + 1 if len(top) else 1):
        at = keys[top >= level]
        for i in range(0, len(at), 1 << 18):
            flags[positions(at[i:i + (1 << 18)], level, size).reshape(-1)] = True
    row = [seg, int(uc.sum()), len(u), u.astype("<u8").tobytes(), uc.astype("<i8").tobytes(), size, np.packbits(flags, bitorder="little").tobytes()]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=["seg", "n", "v", "uh", "uc", "bits", "bloom"])


def _filter_key(h: np.ndarray, seg: np.ndarray | int, order: int) -> np.ndarray:
    """What the filter knows of an n-gram: 48 bits of its hash, its segment and its order."""
    return W.mix64((np.asarray(seg, np.uint64) << np.uint64(48) | (h & _LOW48)) * np.uint64(2) + np.uint64(order - 1))


class Group:
    """Some segments: exact unigram counts and the Bloom filters."""

    def __init__(self, sizes: list, seg_bits: int, n: int):
        """``sizes``: (seg, v, bits) of the segments; their tables are put in place one at a time."""
        sizes = sorted(sizes)
        self.seg_bits = seg_bits
        self.bits = np.zeros(1 << seg_bits, np.int64)  # 0: not in this group
        self.start = np.zeros(1 << seg_bits, np.int64)
        self.first = {}
        words = at = 0
        for seg, v, bits in sizes:
            self.bits[seg], self.start[seg], self.first[seg] = bits, at, words
            at, words = at + bits // 8, words + v
        self.hash = np.empty(words, np.uint64)
        self.count = np.empty(words, np.uint32 if n < 1 << 32 else np.int64)
        self.bloom = np.empty(at, np.uint8)

    def put(self, seg: int, uh: bytes, uc: bytes, bloom: bytes) -> None:
        at, n = self.first[seg], len(uh) // 8
        self.hash[at:at + n] = np.frombuffer(uh, "<u8")
        self.count[at:at + n] = np.frombuffer(uc, "<i8")
        self.bloom[self.start[seg]:self.start[seg] + len(bloom)] = np.frombuffer(bloom, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        return self.bits[segment_of(h, self.seg_bits)] > 0

    def exact(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.zeros(len(h), np.int64)
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        return np.where(self.hash[at] == h, self.count[at], 0).astype(np.int64)

    def levels(self, h: np.ndarray, order: int) -> np.ndarray:
        """Highest level up to which every probe hits; 0 for an n-gram that is not there (or not in this group)."""
        seg = segment_of(h, self.seg_bits)
        size, start = self.bits[seg], self.start[seg]
        key = _filter_key(h, seg, order)
        out = np.zeros(len(h), np.uint8)
        alive = np.flatnonzero(size > 0)
        level = 0
        while len(alive) and level < LEVELS:
            level += 1
            hit = np.ones(len(alive), bool)
            for p in positions(key[alive], level, size[alive]):
                hit &= (self.bloom[start[alive] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            out[alive] = level
        return out


def _score(group_of, n: int, v: int, unigrams: bool, pairs: bool, last: bool):
    """One pass: adds what this group knows of unigrams, of bigrams, or of both; the last one drops text and levels."""
    log_all = math.log10(n + v + 1)

    def run(batches):
        group: Group = group_of.value
        for batch in batches:
            raw, off = W.text_buffer(batch.column(1))
            state = [batch.column(k).to_pylist() if k == 2 else np.asarray(batch.column(k)) for k in range(2, 6)] if batch.num_columns > 2 else None
            for i, j in W.slices(off):
                t, counts = tokens(W.Words(raw, off[i:j + 1]), j - i)
                first = np.cumsum(counts) - counts
                known, base, score = (np.array(state[k][i:j]) for k in (1, 2, 3)) if state else (np.zeros(j - i, np.int64), np.zeros(j - i), np.zeros(j - i))
                if state and state[0][i] is not None:
                    level = np.frombuffer(b"".join(state[0][i:j]), np.uint8).copy()
                else:
                    level = np.zeros(len(t), np.uint8)
                if unigrams:
                    key, back = np.unique(t, return_inverse=True)
                    here = group.has(key)
                    c = group.exact(key)
                    known += np.add.reduceat((here & (c > 0))[back].astype(np.int64), first)
                    base += np.add.reduceat(np.where(here, np.log10(c + 1.0) - log_all, 0.0)[back], first)
                    level += np.where(here, group.levels(key, 1), 0).astype(np.uint8)[back]
                if pairs:
                    c1 = LEVEL_COUNT[level]
                    before = np.empty(len(t), np.float64)
                    before[1:] = c1[:-1]
                    before[first] = c1[first + counts - 1]  # END, the row's last token
                    key, at, back = np.unique(bigrams(t, counts), return_index=True, return_inverse=True)
                    c2 = LEVEL_COUNT[group.levels(key, 2)]
                    p1 = (c1[at] + 1) / (n + v + 1)
                    term = np.log10((c2 + MU * p1) / (np.maximum(before[at], c2) + MU))
                    score += np.add.reduceat(np.where(group.has(key), term, 0.0)[back], first)
                ends = np.cumsum(counts)
                kept = pa.nulls(j - i, pa.binary()) if last else pa.array([level[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())], pa.binary())
                text = pa.nulls(j - i, pa.string()) if last else batch.column(1).slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), text, kept, pa.array(known), pa.array(base), pa.array(score), pa.array(counts)],
                    names=["doc_id", "text", "levels", "n_known", "base_score", "score", "n_tokens"])
    return run


_STATE = "doc_id long, text string, levels binary, n_known long, base_score double, score double, n_tokens long"


def train(docs: DataFrame, segment_text: int = SEGMENT_TEXT, bits_per_key: int = BITS_PER_KEY) -> tuple[DataFrame, int]:
    """(segment table, bits of a hash that name the segment) from the documents outside the held-out fold."""
    texts = docs.where(~held_out()).select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / segment_text))))
    packed = map_arrow(texts, _count(bits), _SEGMENT)
    return written(packed.groupBy("seg").applyInArrow(lambda t: _build(t, bits_per_key), _TABLE), "lm-segments"), bits


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_documents(docs: DataFrame, segments: DataFrame, bits: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    spark = docs.sparkSession
    prepare(spark)
    sizes = segments.select("seg", "n", "v", "bits", (F.octet_length("uh") + F.octet_length("uc") + F.octet_length("bloom")).alias("bytes")).orderBy("seg").collect()
    n, v = sum(r["n"] for r in sizes), sum(r["v"] for r in sizes)
    groups: list[list[int]] = [[]]
    room = group_bytes
    for r in sizes:
        if groups[-1] and r["bytes"] > room:
            groups.append([])
            room = group_bytes
        groups[-1].append(r["seg"])
        room -= r["bytes"]

    def broadcast(group: list[int]):
        """group_bytes at most, which pass the driver a few segments at a time."""
        out = Group([(r["seg"], r["v"], r["bits"]) for r in sizes if r["seg"] in set(group)], bits, n)
        for r in segments.where(F.col("seg").isin(group)).select("seg", "uh", "uc", "bloom").toLocalIterator():
            out.put(r["seg"], r["uh"], r["uc"], r["bloom"])
        return spark.sparkContext.broadcast(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(groups) == 1:
        rows = map_arrow(rows, _score(broadcast(groups[0]), n, v, True, True, True), _STATE)
    else:
        passes = [(g, True, False) for g in groups] + [(g, False, True) for g in groups]
        for k, (group, unigrams, pairs) in enumerate(passes):
            if k:
                rows = rows.select("doc_id", "text", "levels", "n_known", "base_score", "score")
            rows = written(map_arrow(rows, _score(broadcast(group), n, v, unigrams, pairs, k + 1 == len(passes)), _STATE), "lm-pass")
    return rows.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                       F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))
