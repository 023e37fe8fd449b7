"""Vectorised word and shingle primitives over Arrow string batches.

A batch of texts is one byte buffer with offsets.  Everything here works on
that buffer with numpy, in slices of bounded size, so no Python object is made
per word.  Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D
(UTF-8 continuation bytes are never white space, so words never split a
character).  Words and shingles are identified by 64-bit hashes: a polynomial
over the bytes, finished by a bit mixer.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18  # working set of one vectorised step; a longer text is one slice of its own
BLOCK_BYTES = 1 << 18  # bytes of a text that are looked at together

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixer on uint64 (multiply, xor-shift), new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to one block."""
    if not _powers:
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            t = np.full(BLOCK_BYTES + 1, base, dtype=np.uint64)
            t[0] = 1
            _powers[key] = np.multiply.accumulate(t)
    return _powers["p"], _powers["i"]


def text_buffer(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null has no bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each (one row at least)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of the rows [i, j) of a text buffer: byte ranges, hashes and row bounds.

    Beside the words' places and hashes only one block of bytes is held at a time.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = True):
        base, end = int(off[0]), int(off[-1])
        self.off = off - base
        self.raw = raw[base:end]
        self.lower = lower
        n = len(self.raw)
        cut = self.off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        cut = np.unique(cut[~IS_SPACE[self.raw[cut]] & ~IS_SPACE[self.raw[cut - 1]]])  # texts that touch: a word ends and one starts there
        parts = [cut, cut]
        for lo in range(0, n, BLOCK_BYTES):
            ink = ~IS_SPACE[self.raw[max(lo - 1, 0):lo + BLOCK_BYTES]]
            if lo == 0:
                ink = np.concatenate([[False], ink])
            parts.append(np.flatnonzero(ink[1:] != ink[:-1]) + lo)
        if n and not IS_SPACE[self.raw[n - 1]]:
            parts.append(np.array([n]))
        pos = np.sort(np.concatenate(parts)) if len(cut) else np.concatenate(parts)
        self.starts, self.ends = pos[0::2], pos[1::2]
        self.bounds = np.searchsorted(self.starts, self.off)  # words of row r: bounds[r]:bounds[r+1]
        self._hash: np.ndarray | None = None

    @property
    def bytes(self) -> np.ndarray:
        return LOWER[self.raw] if self.lower else self.raw

    @property
    def hashes(self) -> np.ndarray:
        if self._hash is None:
            self._hash = range_hashes(self.raw, self.starts, self.ends, self.lower)
        return self._hash


def range_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte range b[start:end]; the ranges ascend and do not overlap.

    A polynomial over the bytes, relative to the start of the range, so that
    ranges of one block share the powers of that block.
    """
    out = np.empty(len(starts), np.uint64)
    p, inv = _power_table()
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + BLOCK_BYTES, side="right"))
        if j <= i:  # one range beyond a block: block by block
            total, factor = 0, 1
            for lo in range(base, int(ends[i]), BLOCK_BYTES):
                part = b[lo:min(lo + BLOCK_BYTES, int(ends[i]))]
                part = LOWER[part] if lower else part
                total += int(((part.astype(np.uint64) + np.uint64(1)) * p[:len(part)]).sum(dtype=np.uint64)) * factor
                factor = factor * int(p[BLOCK_BYTES]) % (1 << 64)
            out[i] = np.uint64(total % (1 << 64))
            i += 1
            continue
        part = b[base:int(ends[j - 1])]
        part = LOWER[part] if lower else part
        acc = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[:len(part)], out=acc[1:])
        lo = starts[i:j] - base
        out[i:j] = (acc[ends[i:j] - base] - acc[lo]) * inv[lo]
        i = j
    return mix64(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; entry i covers words i..i+k-1 (row bounds are the caller's)."""
    n = max(0, len(word_hashes) - k + 1)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, BLOCK_BYTES):
        hi = min(lo + BLOCK_BYTES, n)
        acc = np.zeros(hi - lo, np.uint64)
        for j in range(k):
            acc = acc * np.uint64(0xA24BAED4963EE407) + word_hashes[lo + j:hi + j]
        out[lo:hi] = mix64(acc)
    return out


def shingle_sets(w: Words, k: int, short: bool = True) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row.

    ``short``: a row with 1..k-1 words has its whole sequence as one shingle
    (else none).  Rows without words have none.
    """
    h = w.hashes
    sh = shingle_hashes(h, k)
    for lo, hi in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        n = hi - lo
        if n >= k:
            yield distinct(sh[lo:hi - k + 1])
        elif n and short:
            one = np.uint64(n)
            acc = np.zeros(1, np.uint64) + one
            for x in h[lo:hi]:
                acc = acc * np.uint64(0xA24BAED4963EE407) + x
            yield mix64(acc)
        else:
            yield np.zeros(0, np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    if len(x) < 2:
        return x.copy()
    s = np.sort(x)
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def universal(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n multiply-shift hash functions (odd multipliers, offsets) drawn from a fixed seed."""
    x = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return x[:n] | np.uint64(1), x[n:]


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each universal hash (upper 32 bits of a*x+b) over the set x, which must not be empty."""
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 512):
        v = (x[i:i + 512, None] * a[None, :] + b[None, :]) >> np.uint64(32)
        np.minimum(out, v.min(axis=0).astype(np.uint32), out=out)
    return out


def intersection_size(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    pos = np.searchsorted(b, a)
    pos[pos == len(b)] = 0
    return int((b[pos] == a).sum())
