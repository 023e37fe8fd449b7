import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleetcat.llm import op3, op4
from fleetcat.llm import words as W
from fleetcat.session import read_table

from .helpers import ASCII_LOWER, docs_df, near_copies, prose, words


def statistics(text):
    text = text or ""
    ws = words(text, lower=False)
    tri = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    c = Counter(tri)
    covered = {i + k for i, x in enumerate(tri) if c[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return [len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


ODD = ["a b c a b c", None, "", "\n\nx\nx\n x\nx", "é é é é", "# |<>", "\n", "x\n", "x", " x y z\r\n x y z\r\n", "A a A a A a", "a\nb", "b\na"]


def test_statistics_equal_plain_python():
    rng = random.Random(3)
    texts = ODD + [("\n" if i % 3 else " ").join(prose(rng, rng.randrange(1, 30), 12) for _ in range(9)) for i in range(60)]
    raw, off = W.text_buffer(pa.array(texts))
    got = [x for i, j in W.slices(off, 300) for x in op4.statistics(raw, off[i:j + 1])[0].tolist()]
    assert got == [statistics(t) for t in texts]


def test_trees_follow_their_constraints_and_arrays():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(op4.RATIOS)))
    y = ((x[:, 0] < 0.4) & (x[:, 6] > 0.3) | (rng.random(3000) < 0.05)).astype(float)
    m = op4.fit(x, y)
    assert ((m.predict(x) >= 0.5) == y).mean() > 0.93
    for name, sign in op4.MONOTONE.items():
        k = op4.RATIOS.index(name)
        z = x.copy()
        z[:, k] += rng.random(3000)
        assert (sign * (m.predict(z) - m.predict(x)) >= -1e-9).all()

    def walk(row):
        total = m.prior
        for at in m.roots:
            while m.left[at] != at:
                at = m.left[at] if row[m.feature[at]] < m.threshold[at] else m.right[at]
            total += m.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(m.predict(x[:50]), [walk(r) for r in x[:50]], atol=1e-8)


def labels_df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, y double")


@pytest.mark.parametrize("labels", [[], [(1, 1, 0, "", 0.0), (2, 1, 0, "", 0.0)], [(None, 1, 0, "", 0.0), (1, None, 0, "", 0.0)]])
def test_without_usable_labels(spark, labels):
    docs = docs_df(spark, near_copies(seed=2, groups=2))
    table = labels_df(spark, labels)
    got = op3.score_documents(docs, op3.train(docs, table)).collect()
    assert len(got) == docs.count() and len({r.score for r in got}) == 1 and 0 < got[0].score < 1
    judged = op4.judge(docs, op4.train(docs, table)).collect()
    assert all(r.kept != r.base_failed for r in judged)


def test_empty_documents_table(spark):
    docs, labels = docs_df(spark, [(1, "a")]).limit(0), labels_df(spark, [(1, 1, 0, "", 0.0)])
    assert op3.score_documents(docs, op3.train(docs, labels)).collect() == []
    assert op3.keep_quality(docs, labels).collect() == []
    assert op4.judge(docs, op4.train(docs, labels)).collect() == []


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(2)
    bags = [rng.normal(size=(n, op3.FEATURES)) for n in (1, 4, 2)]
    y, first = np.array([1.0, 0.0, 1.0]), np.array([0, 1, 5])
    m = {"mean": np.zeros(op3.FEATURES), "scale": np.ones(op3.FEATURES), "W": rng.normal(0, 0.1, (op3.FEATURES, 16)), "b": rng.normal(0, 0.1, 16),
         "V": rng.normal(0, 0.5, (16, 8)), "U": rng.normal(0, 0.5, (16, 8)), "w": rng.normal(0, 1, 8), "c": rng.normal(0, 1, 16), "d": np.array(0.1)}
    x = np.concatenate(bags)

    def loss():
        s = op3.forward(m, x, first)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g = op3._gradient(m, op3.forward(m, x, first), first, y)
    for k in g:
        flat = m[k].reshape(-1)
        for at in (0, flat.size // 2):
            old = flat[at]
            flat[at] = old + 1e-5
            up = loss()
            flat[at] = old - 1e-5
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-5 - np.reshape(g[k], -1)[at]) < 1e-6


def test_one_bag_per_text_and_scores_do_not_depend_on_neighbours():
    texts = ODD + [" ".join(["long"] * 5000), "l1\nl2 l2\n\n \nl3"]
    raw, off = W.text_buffer(pa.array(texts))
    x, first = op3.passage_features(raw, off)
    counts = np.diff(np.append(first, len(x)))
    want = [max(1, sum(-(-len(words(line)) // op3.PASSAGE_WORDS) for line in (t or "").split("\n"))) for t in texts]
    assert counts.tolist() == want
    for k, t in enumerate(texts):
        alone, _ = op3.passage_features(*W.text_buffer(pa.array([t], pa.string())))
        assert np.allclose(alone, x[first[k]:first[k] + counts[k]])


def test_held_out_accuracy_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    scored = op3.score_documents(docs, op3.train(docs, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    judged = {r.doc_id: r for r in op4.judge(docs, op4.train(docs, labels)).collect()}
    assert np.mean([(judged[r.doc_id].score >= 0.5) == truth[r.doc_id] for r in held]) > 0.9
    for r in docs.collect():
        j = judged[r.doc_id]
        base = statistics(r.text)
        assert [j[c] for c in op4.BASE] == base
        assert j.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert j.kept == (not j.base_failed and j.score >= op4.KEEP)


def test_keep_returns_the_columns_of_documents(spark):
    docs = docs_df(spark, near_copies(seed=4, groups=2))
    kept = op3.keep_quality(docs, labels_df(spark, [(i, i % 2, 0, "", 0.0) for i in range(14)]))
    assert kept.schema == docs.schema
    kept.collect()


def test_long_documents_train(spark):
    n = op3.SAMPLE_PASSAGES
    place = np.arange(n * 5)[:, None]
    at = op3._sampled(iter([place]), n)[:, 0]
    assert len(set(at.tolist())) == n and (np.diff(at) > 0).all() and at[0] < n and at[-1] >= 4 * n
    assert op3._sampled(iter(np.split(place, [7, 8, 900])), n)[:, 0].tolist() == at.tolist()
    assert op3._sampled(iter([place[:n]]), n).tolist() == place[:n].tolist()
    rng = random.Random(6)
    text = lambda i: "\n".join(" ".join(rng.choice(["alpha", "beta"] if i % 2 else ["#", "|| 9"]) for _ in range(6)) for _ in range(n + 50))
    rows = [(i, text(i)) for i in range(60)]
    model = op3.train(docs_df(spark, rows), labels_df(spark, [(i, i % 2, 0, "", 0.0) for i in range(60)]))
    assert "constant" not in model
    scored = op3.score_documents(docs_df(spark, rows), model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in scored)


def test_labels_of_no_document_take_no_place(spark):
    docs = docs_df(spark, [(i, "alpha beta\n" * 9 if i % 2 else "# | 9\n" * 9) for i in range(40)])
    labels = labels_df(spark, [(i, i % 2, 0, "", 0.0) for i in range(3000)])
    assert "constant" not in op3.train(docs, labels, sample_docs=25)


@pytest.mark.parametrize("labels", [[], [(99, 0, 0, "", 0.0)], [(1, 0, 0, "", 0.0)]])
def test_without_usable_labels_every_row_is_kept(spark, labels):
    docs = docs_df(spark, near_copies(seed=2, groups=2))
    kept = op3.keep_quality(docs, labels_df(spark, labels))
    assert kept.schema == docs.schema and kept.count() == docs.count()


def test_a_repeated_id_is_one_row_of_the_fit(spark):
    rows = [(i, "alpha beta gamma delta\n" * 20 if i % 2 else "# | 9 ! 7\n" * 20) for i in range(200)]
    rows = [(1, "alpha\n" * 20)] * 3000 + rows
    docs, labels = docs_df(spark, rows).coalesce(1), labels_df(spark, [(i, i % 2, 0, "", 0.0) for i in range(200)])
    assert "constant" not in op3.train(docs, labels, sample_docs=100)
    assert op3.labelled_sample(docs, labels, 100).count() == 100
    assert len(op4.train(docs, labels, sample_docs=100).roots) == op4.TREES


def test_rules_learn_beside_labels_of_other_documents(spark):
    docs = docs_df(spark, [(i, "alpha beta\n" * 60 if i % 2 else "# | 9\n" * 60) for i in range(120)])
    labels = labels_df(spark, [(i, i % 2, 0, "", 0.0) for i in range(20_000)])
    assert len(op4.train(docs, labels, sample_docs=100).roots) == op4.TREES


def plain_passages(text):
    out = []
    for line in (text or "").split("\n"):
        w = words(line, lower=False)
        out += [(line, w[i:i + op3.PASSAGE_WORDS]) for i in range(0, len(w), op3.PASSAGE_WORDS)]
    return out


def test_features_and_scores_by_plain_python():
    """Features of each passage, and attention pooling, written out word by word."""
    kind_of = {**{c: 0 for c in range(65, 91)}, **{c: 1 for c in range(97, 123)}, **{c: 2 for c in range(48, 58)}, **{c: 7 for c in range(128, 256)}}
    kind_of |= {c: 3 for c in b"#*$%&<>@^~=+_\\"} | {c: 6 for c in b".,;:?'\"()-/[]{}`"} | {ord("|"): 4, ord("!"): 5}
    rng = random.Random(8)
    m = {"mean": np.zeros(op3.FEATURES), "scale": np.ones(op3.FEATURES)}
    r = np.random.default_rng(1)
    for k, shape in (("W", (op3.FEATURES, op3.HIDDEN)), ("b", op3.HIDDEN), ("V", (op3.HIDDEN, op3.GATE)), ("U", (op3.HIDDEN, op3.GATE)),
                     ("w", op3.GATE), ("c", op3.HIDDEN), ("d", ())):
        m[k] = r.normal(0, 0.5, shape)
    texts = ["A cat, the CAT! sat sat | on 42 #mats", "é Ü " * 70 + "\n\n one", None, "", " \n ", "x\ny y y\n" * 40]
    texts += [" ".join(rng.choice(["a", "Bc", "9", "d,", "long-word", "\n"]) for _ in range(200)) for _ in range(5)]
    raw, off = W.text_buffer(pa.array(texts, pa.string()))
    x, first = op3.passage_features(raw, off)
    at, want = 0, []
    for t in texts:
        bags = []
        for _, w in plain_passages(t):
            low = [v.translate(ASCII_LOWER) for v in w]
            counts = [0] * 8
            for i, b in enumerate(" ".join(w).encode()):
                if b in kind_of:
                    counts[kind_of[b]] += 1
            total = max(sum(counts), 1)
            n = len(w)
            shape = [np.log1p(n) / 5, sum(len(v.encode()) for v in w) / n / 10, sum(a == b for a, b in zip(low, low[1:])) / n, len(set(low)) / n,
                     sum("A" <= v[0] <= "Z" for v in w) / n, sum(len(v.encode()) <= 3 for v in w) / n]
            hashes = W.Words(*W.text_buffer(pa.array([" ".join(w)]))).hashes
            buckets = np.bincount((hashes >> np.uint64(59)).astype(int), minlength=op3.BUCKETS) / n
            bags.append(np.concatenate([np.array(counts) / total, shape, buckets]))
        bags = np.array(bags) if bags else np.zeros((1, op3.FEATURES))
        assert np.allclose(x[at:at + len(bags)], bags, atol=1e-6)
        at += len(bags)
        h = np.tanh(bags @ m["W"] + m["b"])
        e = np.array([sum(m["w"][k] * np.tanh(row @ m["V"][:, k]) / (1 + np.exp(-row @ m["U"][:, k])) for k in range(op3.GATE)) for row in h])
        a = np.exp(e) / np.exp(e).sum()
        want.append(1 / (1 + np.exp(-((a[:, None] * h).sum(axis=0) @ m["c"] + m["d"]))))
    assert at == len(x)
    assert np.allclose(op3.scores(m, raw, off), want, atol=1e-6)
    # a long text is read in pieces; the score is that of the whole
    for text in ("Some words, 7 of them!\n" * 40_000, "no line break but MANY words " * 30_000, "\n" * 600_000 + "x"):
        raw, off = W.text_buffer(pa.array([text]))
        assert op3._is_long(raw, off)
        f, g = op3.passage_features(raw, off)
        assert abs(op3.scores(m, raw, off)[0] - op3.forward(m, f.astype(np.float64), g)["score"][0]) < 1e-6
