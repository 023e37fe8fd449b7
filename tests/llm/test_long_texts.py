"""A text of tens of MB goes through each operator's task in bounded memory, and nothing of it stays in the worker."""

import json
import subprocess
import sys

import pytest

PROGRAM = """
import json, random, resource, sys
sys.path.insert(0, ROOT)
import psutil
import pyarrow as pa
from fleetcat.llm import op1, op3, op4, op5, op8, op10, op12, op13, words as W
from fleetcat.llm.runtime import give_back
import numpy as np

rng = random.Random(1)
vocabulary = ["w%x" % rng.randrange(1 << 24) for _ in range(50_000)]
line = [" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(5_000)]

def text(mb):
    parts, size = [], 0
    while size < mb << 20:
        parts.append(line[rng.randrange(len(line))])
        size += len(parts[-1]) + 1
    return "\\n".join(parts)

def op_1(batch):
    a, b = W.universal(op1.HASHES, op1.SEED)
    index = op1.ItemIndex([1, 2], [line[0], "one two"], 5, op1.HASHES)
    list(op1._hits(*W.text_buffer(batch.column(1)), index, 5, 80, a, b))

def op_3(batch):
    m = op3.fit([np.random.default_rng(k).normal(k % 2, 1, (5, op3.FEATURES)).astype(np.float32) for k in range(40)], np.arange(40) % 2 * 1.0)
    for _ in op3._score([batch], m): pass

def op_4(batch):
    for _ in op4._judge([batch], op4.fit(np.zeros((0, len(op4.RATIOS))), np.zeros(0))): pass

def op_5(batch):
    import public_tokenizers
    enc = op5.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), 2)
    raw, off = W.text_buffer(batch.column(1))
    for part in enc.stream(raw, off): pass

def op_8(batch):
    for _ in op8._signatures([batch], 5, op8.BANDS, op8.ROWS): pass

def op_10(batch):
    for _ in op10._count(3)([pa.RecordBatch.from_arrays([batch.column(1)], names=["text"])]): pass

def op_12(batch):
    pages = pa.RecordBatch.from_arrays([batch.column(0), pa.array(["u"]), batch.column(1)], names=["page_id", "url", "html"])
    for _ in op12._extract([pages]): pass

def op_13(batch):
    named = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([k * 1234567]) for k in range(4)]], names=["doc_id", "text", "h1", "h2", "h3", "h4"])
    for _ in op13._transform(100, 80, ("<P>", "<S>", "<M>"), False)([named]): pass

run = globals()[sys.argv[1]]
make = lambda mb: pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text(mb)], pa.large_string()).cast(pa.string())], names=["doc_id", "text"])
run(make(1))
give_back()
rss = lambda: psutil.Process().memory_info().rss >> 20
before = rss()
batch = make(int(sys.argv[2]))
held = rss()
run(batch)
del batch
give_back()
print(json.dumps({"stays": rss() - before, "peak": (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10) - held}))
"""


@pytest.mark.parametrize("operator, factor", [("op_1", 16), ("op_3", 6), ("op_4", 16), ("op_5", 6), ("op_8", 20), ("op_10", 24), ("op_12", 12), ("op_13", 8)])
def test_long_text(operator, factor):
    import fleetcat

    root = fleetcat.__path__[0].rsplit("/", 1)[0]
    mb = 24
    done = subprocess.run([sys.executable, "-c", PROGRAM.replace("ROOT", repr(root)), operator, str(mb)], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    got = json.loads(done.stdout)
    assert got["stays"] < 40 and got["peak"] < factor * mb, got
