import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetcat.llm import op13
from tests.llm.helpers import docs_df

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_python(doc_id, text, unit="words"):
    """(n, form, prefix_chars, middle_chars, output) by slicing lists of units."""
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text) if unit == "words" else list(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def check(spark, rows, **options):
    found = op13.fill_in_middle(docs_df(spark, rows), **options)
    found = found.withColumn("restored", op13.restored(F.col("output"), F.col("form"))).collect()
    want = [(d, *plain_python(d, t, options.get("unit", "words")), t or "") for d, t in rows]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    return found


def odd_texts():
    rng = random.Random(5)
    alphabet = ["a", "Z", "é", "漢", "😀", " ", "\t", "\n", "\x0b", " ", " ", "<", "<S", "P>", "M"]
    return ["", None, " ", "\n\t ", "one", " one", "one ", "<P>", "a <S> b", "a<M", "<", "x<S", "S>", "<<S", "a " * 5000,
            *["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(300)]]


@pytest.mark.parametrize("unit", ["words", "chars"])
def test_equal_to_lists_of_units(spark, unit):
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    rows += [(None, "no id but words"), (None, None), (-7, "negative id"), (3, "same id"), (3, "same id"), (2**62, "large id here")]
    forms = {r.form for r in check(spark, rows, unit=unit)}
    assert forms == {"plain", "psm", "spm"}


def test_long_texts(spark):
    rng = random.Random(2)
    dense = "".join(rng.choice(["a ", "b\n", "é "]) for _ in range(400_000))  # bitmaps
    sparse = "".join("x" * rng.randrange(1, 200_000) + " " for _ in range(20))  # arrays, spans without a boundary
    blank = " " * 300_000 + "end"
    check(spark, [(i, t) for i in range(12) for t in (dense, sparse, blank)])
    check(spark, [(i, t) for i in range(4) for t in (dense[:200_000], "y" * 200_000)], unit="chars")


def test_empty_table(spark):
    assert op13.fill_in_middle(docs_df(spark, [(1, "x")]).where("false")).collect() == []
    with pytest.raises(ValueError):
        op13.fill_in_middle(docs_df(spark, [(1, "x")]), unit="lines")


@pytest.mark.parametrize("kind", ["array", "bitmap", "run", "mixed", "empty"])
def test_boundary_set(kind):
    rng = np.random.default_rng(3)
    span = op13.SPAN
    parts = {"array": [np.sort(rng.choice(span, 900, replace=False))], "bitmap": [np.flatnonzero(rng.random(span) < 0.4)],
             "run": [np.concatenate([np.arange(10, 9000), np.arange(20_000, 65_536)])], "empty": []}
    parts["mixed"] = [parts["array"][0], np.zeros(0, int), parts["bitmap"][0], parts["run"][0], np.arange(span), np.array([0]), np.array([span - 1])]
    found = op13.BoundarySet()
    for high, low in enumerate(parts[kind]):
        found.add(high + 2, low)
    found.freeze()
    members = np.concatenate([np.zeros(0, int)] + [low + (high + 2) * span for high, low in enumerate(parts[kind])])
    assert len(found) == len(members)
    k = rng.permutation(len(members))[:5000]
    assert (found.select(k) == members[k]).all()
    x = np.concatenate([rng.integers(0, 12 * span, 5000), members[:2000], members[-2000:] + 1])
    assert (found.rank(x) == np.searchsorted(members, x)).all()
    names = {type(c).__name__ for c in found.containers}
    want = {"array": {"ArrayContainer"}, "bitmap": {"BitmapContainer"}, "run": {"RunContainer"}, "empty": set(),
            "mixed": {"ArrayContainer", "BitmapContainer", "RunContainer"}}[kind]
    assert names == want


def test_whole_table_by_plain_python(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)
