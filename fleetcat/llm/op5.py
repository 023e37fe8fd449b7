"""Token-ID output: Arrow IPC files of fixed-size-list batches, written and read back by Spark tasks.

Layout
  The documents are range-partitioned by id, so shard s holds the ids before
  shard s+1.  A shard is two Arrow IPC files in shared storage:
  ``ids-SSSSS.arrow`` has sequences of equal length as
  ``ids: fixed_size_list<uint16|uint32>[length]`` and
  ``mask: fixed_size_list<bool>[length]`` (false where the shard's last
  sequence is padded), ``BATCH_ROWS`` sequences per batch, so sequence i is row
  i % BATCH_ROWS of batch i // BATCH_ROWS: the footer and a memory map give it
  without copying or scanning.  ``docs-SSSSS.arrow`` has per document its id,
  its offset among the shard's ids and its number of ids.
  The manifest (one row per shard, a written table) names the files and holds
  the ids of all shards before, from a prefix sum over shards.

A task writes under a name of its own attempt and then renames, so a lost
executor or a repeated task leaves complete files only.

Encoding: a text is cut where ASCII white space follows a character that is
surely not white space.  Byte-level BPE splits there anyway, so pieces encode
alone as they do in the text.  Distinct pieces are encoded once with the
tokenizers library and kept in a bounded worker cache; the rest is numpy.

Defined cases: a null text is empty and holds the end id only; null ids sort
first; rows that repeat an id follow each other, ordered by a hash of the
text; extra columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetcat.llm import words as W
from fleetcat.llm.runtime import map_arrow, shared_dir, worker_object, written

SEQUENCE = 2048
BATCH_ROWS = 256
CACHE_PIECES = 400_000  # pieces a worker remembers
END_ID = 2

MANIFEST = "shard long, n_sequences long, n_docs long, n_tokens long, ids_path string, docs_path string"

_SURE_INK = np.zeros(256, bool)
_SURE_INK[0x21:0x7F] = True
_TWO_BYTE_LEAD = np.zeros(256, bool)
_TWO_BYTE_LEAD[0xC3:0xE0] = True  # U+00C0 to U+07FF: no white space among them


class Encoder:
    """Texts to ids with a byte-level BPE tokenizer; equal to encoding each text whole."""

    def __init__(self, tokenizer_json: str, end_id: int | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        vocab = self.tok.get_vocab(with_added_tokens=False)
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.n_ids = max([*vocab.values(), *added.values(), end_id or 0]) + 1
        self.width = np.zeros(self.n_ids, np.int64)  # bytes of an id: a byte-level symbol stands for one byte
        for t, i in vocab.items():
            self.width[i] = len(t)
        for t, i in added.items():
            self.width[i] = len(t.encode())
        self.end_id = end_id
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _encode_pieces(self, raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in turn, ids per piece)."""
        joins = W.IS_SPACE[raw[lo]] & (_SURE_INK[raw[hi - 1]] | (_TWO_BYTE_LEAD[raw[hi - 2]] & (raw[hi - 1] >= 0x80)))
        order = np.argsort(~joins, kind="stable")  # what may stand in a row first
        lo, hi = lo[order], hi[order]
        n_join = int(joins.sum())
        groups = [(i, min(i + 1024, n_join)) for i in range(0, n_join, 1024)] + [(i, i + 1) for i in range(n_join, len(lo))]
        texts = [b"".join(raw[x:y].tobytes() for x, y in zip(lo[i:j].tolist(), hi[i:j].tolist())).decode() for i, j in groups]
        parts, counts = [], np.empty(len(lo), np.int64)
        for (i, j), text, e in zip(groups, texts, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum(hi[i:j] - lo[i:j])
            reach = np.cumsum(self.width[ids])
            last = np.searchsorted(reach, ends)
            if not len(ids) or last[-1] >= len(ids) or (reach[last] != ends).any():
                alone = [np.array(self.tok.encode(raw[x:y].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                         for x, y in zip(lo[i:j].tolist(), hi[i:j].tolist())]
                ids, counts[i:j] = np.concatenate(alone), [len(x) for x in alone]
            else:
                counts[i:j] = np.diff(last + 1, prepend=0)
            parts.append(ids)
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        flat = np.concatenate(parts)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        n = counts[back]
        return _gather(flat, starts[back], n), n

    def stream(self, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
        """(first row, row after the last, ids, ids per row) in slices; of a long text the ids come in pieces, the count with the last."""
        for i, j in W.slices(off):
            lo, hi = int(off[i]), int(off[j])
            if j - i > 1 or hi - lo <= 2 * W.SLICE_BYTES:
                yield i, j, *self.encode(raw, off[i:j + 1])
                continue
            total, size = 0, W.SLICE_BYTES
            while hi - lo > size:
                part = raw[lo:lo + size]
                at = np.flatnonzero(W.IS_SPACE[part[1:]] & _SURE_INK[part[:-1]])
                if not len(at):  # no place to cut yet
                    size *= 2
                    continue
                end = lo + int(at[-1]) + 1
                ids, _ = self.encode(raw, np.array([lo, end]), end=False)
                yield i, j, ids, None
                total, lo, size = total + len(ids), end, W.SLICE_BYTES
            ids, counts = self.encode(raw, np.array([lo, hi]))
            yield i, j, ids, counts + total

    def encode(self, raw: np.ndarray, off: np.ndarray, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in turn, each row followed by the end id, if there is one and ``end`` is set; ids per row)."""
        end_id = self.end_id if end else None
        rows = len(off) - 1
        base = int(off[0])
        b = raw[base:int(off[-1])]
        off = off - base
        n = len(b)
        if not n:
            counts = np.full(rows, 0 if end_id is None else 1, np.int64)
            return np.full(int(counts.sum()), end_id or 0, np.uint32), counts
        cut = np.zeros(n, bool)
        cut[1:] = W.IS_SPACE[b[1:]] & _SURE_INK[b[:-1]]
        cut[2:] |= W.IS_SPACE[b[2:]] & _TWO_BYTE_LEAD[b[:-2]] & (b[1:-1] >= 0x80)
        cut[off[:-1][off[:-1] < n]] = True
        lo = np.flatnonzero(cut)
        hi = np.append(lo[1:], n)
        h = W.range_hashes(b, lo, hi)
        key, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        known = np.searchsorted(self.keys, key)
        hit = np.zeros(len(key), bool)
        inside = known < len(self.keys)
        hit[inside] = self.keys[known[inside]] == key[inside]
        at, size = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        at[hit], size[hit] = self.at[known[hit]], self.len[known[hit]]
        pool = self.pool
        if not hit.all():
            new = first[~hit]
            ids, counts = self._encode_pieces(b, lo[new], hi[new])
            at[~hit] = len(pool) + np.cumsum(counts) - counts
            size[~hit] = counts
            pool = np.concatenate([pool, ids])
            if len(self.keys) + len(new) <= CACHE_PIECES:
                where = known[~hit]
                self.keys = np.insert(self.keys, where, key[~hit])
                self.at = np.insert(self.at, where, at[~hit])
                self.len = np.insert(self.len, where, size[~hit])
                self.pool = pool
        size, at = size[inverse], at[inverse]
        ids = _gather(pool, at, size)
        piece_of_row = np.searchsorted(lo, off)
        reach = np.concatenate([[0], np.cumsum(size)])[piece_of_row]
        counts = np.diff(reach)
        if end_id is not None:
            ids = np.insert(ids, reach[1:], np.uint32(end_id))
            counts = counts + 1
        return ids, counts


def _gather(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = int(size.sum())
    before = np.cumsum(size) - size
    return pool[np.repeat(at - before, size) + np.arange(total)]


def worker_encoder(tokenizer_json: str, end_id: int | None) -> Encoder:
    return worker_object((hash(tokenizer_json), end_id), lambda: Encoder(tokenizer_json, end_id))


class _ShardWriter:
    """Streams ids into equal sequences, with at most one batch in memory."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.length, self.dtype, self.kind = length, dtype, pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.pending: list[np.ndarray] = []
        self.n_pending = self.sequences = 0

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids.astype(self.dtype))
        self.n_pending += len(ids)
        full = self.length * BATCH_ROWS
        if self.n_pending >= full:
            flat = np.concatenate(self.pending)
            for i in range(0, len(flat) - full + 1, full):
                self._write(flat[i:i + full], full)
            rest = flat[len(flat) // full * full:]
            self.pending, self.n_pending = [rest], len(rest)

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:real] = True
        self.writer.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length),
             pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.sequences += len(flat) // self.length

    def close(self) -> None:
        if self.n_pending:
            flat = np.concatenate(self.pending)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[:len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _publish(store, temp: str, final: str) -> None:
    try:
        store.move(temp, final)
    except OSError:  # some stores do not rename onto a file: an equal one of another attempt is there
        if store.get_file_info(final).type.name != "File":
            raise
        store.delete_file(temp)


def _write_shard(tokenizer, folder: str, end_id: int | None, length: int):
    def run(batches):
        shard = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        batches = (x for x in batches if x.num_rows)
        head = next(batches, None)
        if head is None:
            return
        enc = worker_encoder(tokenizer.value, end_id)
        dtype = np.dtype(np.uint16 if enc.n_ids <= 1 << 16 else np.uint32)
        store, path = _filesystem(folder)
        store.create_dir(path, recursive=True)
        names = [f"{path}/{kind}-{shard:05d}.arrow" for kind in ("ids", "docs")]
        temps = [f"{x}.{attempt}.tmp" for x in names]
        index = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
        offset = docs = 0
        with store.open_output_stream(temps[0]) as ids_sink, store.open_output_stream(temps[1]) as docs_sink:
            out = _ShardWriter(ids_sink, dtype, length)
            with pa.ipc.new_file(docs_sink, index) as docs_out:
                def consume(batch):
                    nonlocal offset, docs
                    raw, off = W.text_buffer(batch.column(1))
                    for i, j, ids, counts in enc.stream(raw, off):
                        out.add(ids)
                        if counts is None:
                            continue
                        reach = offset + np.concatenate([[0], np.cumsum(counts)])
                        docs_out.write_batch(pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(i, j - i), pa.array(reach[:-1]), pa.array(counts)], schema=index))
                        offset, docs = int(reach[-1]), docs + j - i
                consume(head)
                for batch in batches:
                    consume(batch)
            out.close()
        for temp, final in zip(temps, names):
            _publish(store, temp, final)
        base = folder.rstrip("/")
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([out.sequences]), pa.array([docs]), pa.array([offset]),
             pa.array([f"{base}/ids-{shard:05d}.arrow"]), pa.array([f"{base}/docs-{shard:05d}.arrow"])],
            names=["shard", "n_sequences", "n_docs", "n_tokens", "ids_path", "docs_path"])
    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int | None = END_ID,
                 length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents, in ascending id order; returns the manifest with ``start`` (ids of all shards before)."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("part")]  # the input partition splits even one id's equal rows
    rows = rows.withColumn("part", F.spark_partition_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    shards = written(map_arrow(rows.select("doc_id", "text"), _write_shard(tokenizer, folder, end_id, length), MANIFEST, keep=True), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class SequenceFile:
    """Random access to the sequences of one ids file; local files are memory-mapped."""

    def __init__(self, uri: str):
        store, path = _filesystem(uri)
        source = pa.memory_map(path) if store.type_name == "local" else store.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self._batch = (-1, None)

    def batch(self, k: int) -> pa.RecordBatch:
        if self._batch[0] != k:
            self._batch = (k, self.reader.get_batch(k))
        return self._batch[1]

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence i; the ids are a view of the file."""
        ids, mask = self.batch(i // BATCH_ROWS).columns
        row = i % BATCH_ROWS
        return self.flat(i // BATCH_ROWS)[row * self.length:(row + 1) * self.length], mask.slice(row, 1).flatten()

    def flat(self, k: int) -> np.ndarray:
        return self.batch(k).column(0).flatten().to_numpy(zero_copy_only=True)

    def span(self, lo: int, hi: int) -> Iterator[np.ndarray]:
        """The ids at [lo, hi), in pieces that are views of the file."""
        full = self.length * BATCH_ROWS
        while lo < hi:
            k = lo // full
            end = min(hi, (k + 1) * full)
            yield self.flat(k)[lo - k * full:end - k * full]
            lo = end


def _read_documents(batches):
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for shard in batch.to_pylist():
            ids = SequenceFile(shard["ids_path"])
            store, path = _filesystem(shard["docs_path"])
            with store.open_input_file(path) as f:
                index = pa.ipc.open_file(f)
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    crcs = []
                    for lo, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                        crc = 0
                        for piece in ids.span(lo, lo + n):
                            crc = zlib.crc32(np.ascontiguousarray(piece, "<u4"), crc)
                        crcs.append(crc)
                    start = np.asarray(part.column(1)) + shard["start"]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start), part.column(2), pa.array(crcs, pa.int64())], names=names)


def _read_sequences(batches):
    for batch in batches:
        for shard in batch.to_pylist():
            ids = SequenceFile(shard["ids_path"])
            at = 0
            for k in range(ids.reader.num_record_batches):
                part = ids.batch(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(part.num_rows, shard["shard"])), pa.array(np.arange(at, at + part.num_rows)),
                     part.column(0).cast(pa.list_(pa.int64(), ids.length)).cast(pa.list_(pa.int64())), part.column(1).cast(pa.list_(pa.bool_()))],
                    names=["shard", "sequence", "ids", "mask"])
                at += part.num_rows


def _one_task_each(manifest: DataFrame) -> DataFrame:
    manifest = written(manifest, "shards")
    return manifest.repartitionByRange(max(1, manifest.count()), "shard")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    return map_arrow(_one_task_each(manifest), _read_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_sequences(manifest: DataFrame) -> DataFrame:
    """The sequences, from the files: shard, sequence, ids, mask."""
    return map_arrow(_one_task_each(manifest), _read_sequences, "shard long, sequence long, ids array<long>, mask array<boolean>")
