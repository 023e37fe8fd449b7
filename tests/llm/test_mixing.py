import random
from collections import Counter, defaultdict

import pytest

from fleetcat.llm import op7

from .helpers import docs_df, prose, words


def water_fill(sizes, weights, share):
    """Targets by repeated resharing, as the rule is stated."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()) / 100, set(order), dict.fromkeys(order, 0.0)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        give = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, g in give.items():
            target[s] += g
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def rows(seed):
    rng = random.Random(seed)
    out = [(i, prose(rng, rng.choice([1, 20, 200])), "en", rng.choice(["a", "b", "Z", "é", None, "hot", "hot", "hot"])) for i in range(200)]
    out += [(500, None, "en", "a"), (501, "", "en", "nothing"), (502, None, "en", "nothing"), (None, "null id here", "en", "b"),
            (503, "three equal rows", "en", "b"), (503, "three equal rows", "en", "b"), (503, "three equal rows", "en", "b"), (504, prose(rng, 5000), "en", "long")]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken_words(spark, seed):
    data = rows(seed)
    sizes = Counter()
    for _, t, _, s in data:
        sizes[s] += len(words(t))
    want = water_fill(sizes, op7.WEIGHTS, op7.SHARE)
    got = op7.mix(docs_df(spark, data).repartition(7)).collect()
    assert len(got) == len(data)
    by_target = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_target[(r.source_size, r.target)] += r.taken
    assert sorted((sizes[s], round(t, 3)) for s, t in want.items()) == sorted((n, round(t, 3)) for n, t in by_target)
    assert all(abs(taken - target) < 1 + 1e-6 for (_, target), taken in by_target.items() if target)
    again = op7.mix(docs_df(spark, data).repartition(3)).collect()
    assert Counter(again) == Counter(got)


def test_mixed_documents_hold_the_taken_words(spark):
    data = rows(3)
    docs = docs_df(spark, data)
    taken = defaultdict(int)
    for r in op7.mix(docs).collect():
        taken[r.doc_id] += r.taken
    mixed = op7.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got, texts = defaultdict(int), defaultdict(set)
    for r in mixed.collect():
        got[r.doc_id] += len(words(r.text))
        texts[r.doc_id].add(r.text)
    assert all(abs(got[i] - taken[i]) <= (2 if i == 503 else 0) for i in taken)  # equal rows share a cut evenly
    source = defaultdict(set)
    for i, t, *_ in data:
        source[i].add(t)
    assert all(any((s or "").startswith(t or "") for s in source[i]) for i, ts in texts.items() for t in ts)


def test_no_rows(spark):
    docs = docs_df(spark, [(1, "a")]).limit(0)
    assert op7.mix(docs).collect() == [] and op7.mixed_documents(docs).collect() == []
