"""Fill-in-middle transformation: both cuts of a text come from a Roaring-style set of unit boundaries.

Units are `[ws]*[ink]+|[ws]+` (a word with the white space before it, then
trailing white space) or single code points.  The boundaries of a slice of
texts form one ``BoundarySet``: positions grouped by their high bits into
containers of 2^16 positions, each stored as a sorted array, a bitmap or runs,
whichever is smallest, with the cumulative number of members before each
container.  ``rank`` counts a text's first boundary; ``select`` finds the
container of the k-th member by binary search in the cumulative counts and then
selects inside that container.  A text of any length is read container by
container, so beside the text itself only its boundary set is held.

The draws are the first four 8-digit groups of the sha256 of ``seed:id``, so
any rerun, partitioning or order gives the same cuts.

Defined cases: a null text is empty; an empty text, one that holds a sentinel,
and one that the draw leaves out stay plain (null lengths); a null id draws as
the empty string; repeated rows each get a row; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcat.llm import words as W
from fleetcat.llm.runtime import map_arrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPAN = 1 << 16  # positions of one container
ARRAY_MAX = 4096  # members of an array container at most; above, a bitmap is smaller
BITMAP_BYTES = SPAN // 8

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class ArrayContainer:
    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: np.ndarray) -> np.ndarray:
        return self.low[k].astype(np.int64)

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, x)


class BitmapContainer:
    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, bool)
        bits[low] = True
        self.word = np.packbits(bits, bitorder="little").view(np.uint64)
        self.upto = np.cumsum(np.bitwise_count(self.word), dtype=np.int64)  # members up to and with each word

    def select(self, k: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.upto, k, side="right")
        left = k - np.where(at > 0, self.upto[at - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(self.word[at]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return at * 64 + np.argmax(np.cumsum(bits, axis=1) > left[:, None], axis=1)

    def rank(self, x: np.ndarray) -> np.ndarray:
        at, bit = x >> 6, (x & 63).astype(np.uint64)
        below = self.word[at] & ((np.uint64(1) << bit) - np.uint64(1))
        return np.where(at > 0, self.upto[at - 1], 0) + np.bitwise_count(below)


class RunContainer:
    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.start = low[first].astype(np.uint16)
        self.before = first.astype(np.int64)  # members before each run
        self.size = len(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, k, side="right") - 1
        return self.start[run].astype(np.int64) + k - self.before[run]

    def rank(self, x: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.start, x, side="right") - 1
        length = np.diff(self.before, append=self.size)
        inside = np.minimum(x - self.start[run].astype(np.int64), length[run])
        return np.where(run >= 0, self.before[run] + inside, 0)


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for sorted distinct positions below SPAN."""
    runs = int(np.count_nonzero(np.diff(low) != 1)) + 1
    if 4 * runs < min(2 * len(low), BITMAP_BYTES):
        return RunContainer(low)
    return ArrayContainer(low) if len(low) <= ARRAY_MAX else BitmapContainer(low)


class BoundarySet:
    """Positions, added in ascending order, one container of SPAN positions at a time."""

    def __init__(self):
        self._high: list[int] = []
        self._sizes: list[int] = []
        self.containers: list = []

    def add(self, high: int, low: np.ndarray) -> None:
        if len(low):
            self._high.append(high)
            self._sizes.append(len(low))
            self.containers.append(container(low))

    def freeze(self) -> BoundarySet:
        self.high = np.array(self._high, np.int64)
        self.before = np.concatenate([[0], np.cumsum(self._sizes)]).astype(np.int64)
        return self

    def __len__(self) -> int:
        return int(self.before[-1])

    def _each(self, at: np.ndarray, fn: Callable) -> np.ndarray:
        """fn(container number, positions in ``at`` of its queries), one call per container that is asked."""
        out = np.zeros(len(at), np.int64)
        order = np.argsort(at, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(at) else []:
            out[part] = fn(int(at[part[0]]), part)
        return out

    def select(self, k: np.ndarray) -> np.ndarray:
        """The k-th smallest members (from 0)."""
        at = np.searchsorted(self.before, k, side="right") - 1
        return self._each(at, lambda c, i: self.high[c] * SPAN + self.containers[c].select(k[i] - self.before[c]))

    def rank(self, x: np.ndarray) -> np.ndarray:
        """How many members are less than each x."""
        at = np.searchsorted(self.high, x // SPAN)

        def count(c, i):
            if c < len(self.high) and self.high[c] == x[i[0]] // SPAN:
                return self.before[c] + self.containers[c].rank(x[i] % SPAN)
            return np.full(len(i), self.before[c])
        # queries in different spans without a container meet at the same number; ask span by span
        out = np.zeros(len(x), np.int64)
        here = np.zeros(len(x), bool)
        if len(self.high):
            here = self.high[np.minimum(at, len(self.high) - 1)] == x // SPAN
        out[~here] = self.before[at[~here]]
        out[here] = self._each(at[here], lambda c, i: count(c, np.flatnonzero(here)[i]))
        return out


def boundaries(raw: np.ndarray, off: np.ndarray, chars: bool = False) -> BoundarySet:
    """Ends of all units of the texts raw[off[i]:off[i+1]], as positions from off[0]."""
    found = BoundarySet()
    base, n = int(off[0]), int(off[-1] - off[0])
    text_ends = np.unique(off[1:][np.diff(off) > 0]) - base
    for lo in range(0, n + 1, SPAN):
        hi = min(lo + SPAN, n + 1)  # positions e of this container; e ends a unit of the text that holds byte e-1
        first = max(lo, 1)
        last = raw[base + first - 1:base + hi - 1]
        nxt = raw[base + first:base + min(hi, n)]
        mark = np.zeros(hi - lo, bool)
        if chars:
            mark[first - lo:first - lo + len(nxt)] = (nxt & 0xC0) != 0x80
        else:
            mark[first - lo:first - lo + len(nxt)] = ~W.IS_SPACE[last[:len(nxt)]] & W.IS_SPACE[nxt]
        ends = text_ends[np.searchsorted(text_ends, lo):np.searchsorted(text_ends, hi)]
        mark[ends - lo] = True
        found.add(lo // SPAN, np.flatnonzero(mark))
    return found.freeze()


def _chars(part: np.ndarray) -> int:
    return int(np.count_nonzero((part & 0xC0) != 0x80))


def _transform(rate: int, spm_rate: int, marks: tuple[str, str, str], chars: bool):
    p, s, m = (x.encode() for x in marks)

    def run(batches):
        for batch in batches:
            raw, off = W.text_buffer(batch.column("text"))
            h = [np.asarray(batch.column(f"h{i}")) for i in range(1, 5)]
            for i, j in W.slices(off):
                o = off[i:j + 1]
                found = boundaries(raw, o, chars)
                base = found.rank(o - o[0] + 1)  # boundaries up to each text's first byte
                n = np.diff(base)
                first, second = h[0][i:j] % (n + 1), h[1][i:j] % (n + 1)
                cuts = []
                for k in (np.minimum(first, second), np.maximum(first, second)):
                    at = o[:-1].copy()
                    inside = k > 0
                    at[inside] = o[0] + found.select((base[:-1] + k - 1)[inside])
                    cuts.append(at)
                forms, lengths, outputs = [], ([], []), []
                plain = (h[2][i:j] % 100 >= rate) | (n == 0)
                spm = h[3][i:j] % 100 < spm_rate
                for r, (lo, a, b, hi) in enumerate(zip(o[:-1].tolist(), cuts[0].tolist(), cuts[1].tolist(), o[1:].tolist())):
                    text = raw[lo:hi].tobytes()
                    if plain[r] or p in text or s in text or m in text:
                        forms.append("plain")
                        lengths[0].append(None)
                        lengths[1].append(None)
                        outputs.append(text)
                        continue
                    pre, mid, suf = text[:a - lo], text[a - lo:b - lo], text[b - lo:]
                    forms.append("spm" if spm[r] else "psm")
                    lengths[0].append(_chars(raw[lo:a]))
                    lengths[1].append(_chars(raw[a:b]))
                    outputs.append(b"".join([s, suf, p, pre, m, mid] if spm[r] else [p, pre, s, suf, m, mid]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n), pa.array(forms, pa.string()), pa.array(lengths[0], pa.int64()),
                     pa.array(lengths[1], pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
                   unit: str = "words", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars and the rearranged ``output``.

    ``rate`` percent of the texts are rearranged, ``spm_rate`` percent of those
    with the suffix first.  ``unit``: words (with the white space before) or chars.
    """
    if unit not in ("words", "chars"):
        raise ValueError("unit is words or chars")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), digest.alias("digest"))
    return map_arrow(rows.select("doc_id", "text", *draws), _transform(rate, spm_rate, marks, unit == "chars"), SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was made of.

    A rearranged text holds no sentinel, and a sentinel cannot begin inside
    another, so the first occurrence of each one is the one that was put there.
    """
    p, s, m = marks

    def after(mark):
        return F.locate(mark, output) + len(mark)

    def piece(mark, end):
        return F.substring(output, after(mark), F.locate(end, output) - after(mark))

    middle = F.substring(output, after(m), F.length(output))
    return (F.when(form == "psm", F.concat(piece(p, s), middle, piece(s, m)))
            .when(form == "spm", F.concat(piece(p, m), middle, piece(s, p))).otherwise(output))
