import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fleetcat.llm import op11
from tests.llm.helpers import docs_df

UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text=None):
    doc_id, body, lang, source, n_chars = row
    return sha("".join(map(field, (doc_id, source, lang, n_chars, body if text is None else text))))


def climb(nodes):
    """(top, per node: list of (left, right)) of a list of digests, by lists."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))  # the node of the current level above each original node
    while len(nodes) > 1:
        runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
        for p, i in zip(paths, at):
            run = runs[i // 8]
            p.append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
        nodes, at = [sha("".join(r)) for r in runs], [i // 8 for i in at]
    return nodes[0], paths


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof text, folded root of the tampered leaf) by plain Python."""
    groups = {}
    for row in rows:
        tampered = row[1]
        if row[0] is not None and tampered is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
            tampered = tampered.translate(UPPER_TO_LOWER)
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), leaf_of(row, tampered), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:4])
        trees[g] = climb([x[2] for x in groups[g]])
    root, upper = climb([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, upper):
        for (_, _, leaf, later, doc_id), path in zip(groups[g], trees[g][1]):
            node = later
            for left, right in path + above:
                node = sha(left + node + right)
            out.append((doc_id, leaf, trees[g][0], root, "".join(a + b for a, b in path + above), node))
    return out


def built(docs):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = {"text": F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))}
    return op11.build(docs, changed=changed)


def check(spark, rows):
    found = built(docs_df(spark, rows)).select(
        "doc_id", "leaf", "subroot", "root", op11.proof_text(F.col("proof")), op11.folded(F.col("other_leaf"), F.col("proof"))).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, manifest(rows)))


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    rows, k = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            text = rng.choice([None, "", "Ünï Code", f"Text {k} AZ", "lower only", "漢字 A"])
            rows.append((k, text, lang, rng.choice([None, "src", "Ж"]), rng.choice([None, 0, 17])))
            k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [
    {"en": 1}, {"en": 8}, {"en": 9}, {"en": 65, None: 3, "": 1, "de": 17},
    {**{f"l{i}": 1 for i in range(70)}, "x": 2, None: 1}, {"hot": 520, "one": 1, "é": 7, "z": 64}],
    ids=["one leaf", "one run", "lone node in a run", "groups", "many groups", "hot group"])
def test_equal_to_lists(spark, sizes):
    check(spark, rows_of(sizes))


def test_nulls_and_repeated_rows(spark):
    rows = rows_of({"en": 12, None: 9})
    rows += [(None, "A", "en", "s", 1), (None, None, None, None, None), (None, "B", "en", "s", 1), rows[0], rows[0], (rows[1][0], "other TEXT", rows[1][2], "s", 3),
             (-5, "Negative", "en", "s", 8)]
    check(spark, rows)


def test_empty_table(spark):
    assert built(docs_df(spark, [(1, "x")]).where("false")).collect() == []


def test_tampering_is_found(spark):
    rows = rows_of({"en": 40, "de": 3})
    for r in built(docs_df(spark, rows)).select("*", op11.folded(F.col("other_leaf"), F.col("proof")).alias("f")).collect():
        assert (r.f == r.root) == (r.leaf == r.other_leaf)


def test_long_text(spark):
    check(spark, [(i, "Word " * 400_000, "en", "s", 1) for i in range(3)])
