import math
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetcat.llm import op10

from .helpers import docs_df, near_copies, words


def tokens(t):
    return [*words(t), None]


def reference(rows):
    train = [(i, t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(x for _, t in train for x in tokens(t))
    bi = Counter(p for _, t in train for p in zip([None, *tokens(t)], tokens(t)))
    return uni, bi


def stands_for(c):
    """The count that the filter gives back for c."""
    return float(op10.LEVEL_COUNT[op10.level_of(np.array([c]))[0]])


def test_levels_are_the_floor_of_the_logarithm():
    c = np.arange(1, 5000)
    assert (op10.level_of(c) == 1 + np.floor(np.log(c) / np.log(1.5) + 1e-9)).all()
    assert op10.level_of(np.array([0]))[0] == 0 and op10.LEVEL_COUNT[0] == 0 and op10.LEVEL_COUNT[1] == 1
    assert (np.abs(op10.LEVEL_COUNT[op10.level_of(c)] / c - 1) < 0.5).all()


def test_scores_equal_brute_force_up_to_false_positives(spark):
    rows = near_copies(seed=6, groups=3)
    uni, bi = reference(rows)
    n, v = sum(uni.values()), len(uni)
    docs = docs_df(spark, rows).repartition(5)
    segments, bits = op10.train(docs, bits_per_key=40)  # so few false positives that the model can be compared
    got = op10.score_documents(docs, segments, bits).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    close = 0
    for r in got:
        assert r.train_tokens == n and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        options = []
        for t in texts[r.doc_id]:
            ts = tokens(t)
            base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in ts)
            model = 0.0
            for u, w in zip([None, *ts], ts):
                c2, p1 = stands_for(bi[u, w]), (stands_for(uni[w]) + 1) / (n + v + 1)
                model += math.log10((c2 + op10.MU * p1) / (max(stands_for(uni[u]), c2) + op10.MU))
            options.append((len(ts), sum(uni[x] > 0 for x in ts), base, model))
        best = min(options, key=lambda o: abs(o[2] - r.base_score))
        assert (r.n_tokens, r.n_known) == best[:2] and abs(r.base_score - best[2]) < 1e-4
        close += abs(r.score - best[3]) < 1e-3
    assert close >= 0.8 * len(got)


def test_groups_of_segments_change_nothing(spark):
    rows = near_copies(seed=7, groups=2)
    docs = docs_df(spark, rows)
    segments, bits = op10.train(docs, segment_text=20_000)
    assert bits >= 1
    one = op10.score_documents(docs, segments, bits).collect()
    many = op10.score_documents(docs, segments, bits, group_bytes=1).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_held_out_text_is_likelier_than_under_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in op10.score_documents(docs, *op10.train(docs)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty_tables(spark):
    docs = docs_df(spark, [(1, "a")])
    assert op10.score_documents(docs.limit(0), *op10.train(docs.limit(0))).collect() == []
    r = op10.score_documents(docs, *op10.train(docs.limit(0))).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0) and r.score == pytest.approx(0.0)
