import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetcat.llm import op5
from fleetcat.llm import words as W

from .helpers import docs_df, near_copies

PATH = public_tokenizers.path("byte_bpe_50k.json")
JSON = open(PATH, encoding="utf-8").read()
TOKENIZER = Tokenizer.from_str(JSON)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return op5.Encoder(JSON, 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab 'st!?\n\t\r\x0b\x1c\x85\xa0 　éß日<|>", max_size=60)), min_size=1, max_size=6))
def test_pieces_encode_as_whole_texts(texts):
    enc = ENCODER
    raw, off = W.text_buffer(pa.array(texts, pa.string()))
    ids, counts = enc.encode(raw, off)
    assert ids.tolist() == [x for t in texts for x in [*ids_of(t), 2]]
    assert counts.tolist() == [len(ids_of(t)) + 1 for t in texts]


ENCODER = op5.Encoder(JSON, 2)


def test_special_token_strings_and_a_full_cache(encoder, monkeypatch):
    monkeypatch.setattr(op5, "CACHE_PIECES", 3)
    texts = ["a<|endoftext|> b  <|endoftext|>", "one two three four five", "one two three four five"]
    raw, off = W.text_buffer(pa.array(texts))
    for _ in range(2):
        assert encoder.encode(raw, off)[0].tolist() == [x for t in texts for x in [*ids_of(t), 2]]


def test_files_hold_all_documents_in_order(spark, tmp_path):
    rows = near_copies(seed=9, groups=3)
    random.Random(1).shuffle(rows)
    manifest = op5.write_tokens(docs_df(spark, rows).repartition(6), PATH, folder=str(tmp_path / "out"), length=64)
    got = op5.read_documents(manifest).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append([*ids_of(t), 2])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        crcs = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in texts[r.doc_id]]
        assert r.ids_crc32 in crcs
        texts[r.doc_id].pop(crcs.index(r.ids_crc32))
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    # sequences: equal length, masks cover exactly the ids, random access gives the same as the scan
    seqs = sorted(op5.read_sequences(manifest).collect(), key=lambda r: (r.shard, r.sequence))
    assert {len(s.ids) for s in seqs} == {64}
    flat = [x for s in seqs for x, m in zip(s.ids, s.mask) if m]
    want = [x for r in sorted(got, key=lambda r: r.start) for x in [None] * r.n_tokens]
    assert len(flat) == len(want) == at
    for m in manifest.collect():
        f = op5.SequenceFile(m.ids_path)
        own = [s for s in seqs if s.shard == m.shard]
        assert len(own) == m.n_sequences and sum(sum(s.mask) for s in own) == m.n_tokens
        for k in (0, len(own) - 1, len(own) // 2):
            ids, mask = f[k]
            assert ids.tolist() == own[k].ids and mask.to_pylist() == own[k].mask
            assert ids.base is not None  # a view of the file
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.endswith(".tmp")]


def test_no_documents(spark, tmp_path):
    manifest = op5.write_tokens(docs_df(spark, [(1, "a")]).limit(0), PATH, folder=str(tmp_path / "none"))
    assert op5.read_documents(manifest).collect() == []
