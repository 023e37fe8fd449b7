import random

import pytest

from fleetcat.llm import op8

from .helpers import docs_df, near_copies, shingles


def brute(rows, k, threshold):
    """{id: (component, sizes)} over links between rows that share an id or are similar."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}, sorted((i is None, i or 0, len(s)) for i, s in sets)


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, k):
    rows = near_copies(seed=k)
    want, sizes = brute(rows, k, 80)
    got = op8.near_duplicates(docs_df(spark, rows).repartition(5), shingle=k).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got) == sizes


def test_links_between_members_that_the_pivot_does_not_reach(spark):
    """A chain in which neighbours are similar and ends are not, larger than one round's pivots."""
    rng = random.Random(4)
    w = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(90):
        rows.append((i, " ".join(w)))
        w[rng.randrange(60)] = f"n{i}"
    want, _ = brute(rows, 2, 80)
    got = op8.near_duplicates(docs_df(spark, rows), shingle=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_star_components_on_chains_cycles_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 102), (102, 100)] + [(200 + i, 199) for i in range(1, 20)] + [(5, 5)]
    got = {r.node: r.label for r in op8.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 100: 100, 101: 100, 102: 100, 199: 199, **{200 + i: 199 for i in range(1, 20)}}


def test_no_rows(spark):
    docs = docs_df(spark, [(1, "a")]).limit(0)
    assert op8.near_duplicates(docs).collect() == []
    assert op8.drop_near_duplicates(docs).collect() == []


def test_one_document_of_each_group_stays(spark):
    rows = near_copies(seed=5)
    docs = docs_df(spark, rows)
    want, _ = brute(rows, 5, 80)
    kept = op8.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))
    assert ids.count(None) == 2


def test_rows_that_share_an_id_are_dropped_only_if_their_texts_are_near(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{i}_{rng.randrange(10 ** 6)}" for _ in range(80)) for i in range(6)]
    near = texts[1] + " more"
    rows = [(0, texts[0]), (0, texts[1]), (0, texts[2]), (0, texts[2]), (0, near), (5, texts[1]), (5, texts[3]), (7, texts[4]), (8, texts[5]), (8, None), (8, None), (8, "")]
    kept = op8.drop_near_duplicates(docs_df(spark, rows).repartition(3))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    ones = [x for x in got if x not in ((0, texts[1]), (0, near))]
    assert sorted(map(str, ones)) == sorted(map(str, [(0, texts[0]), (0, texts[2]), (5, texts[3]), (7, texts[4]), (8, texts[5]), (8, None), (8, "")]))
    assert len(got) == len(ones) + 1
