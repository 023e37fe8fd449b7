import random

from fleetcat.llm import op1

from .helpers import docs_df, prose, shingles, words


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, q in items:
            k = min(5, len(words(q)))  # an item of fewer words is one shingle of its own length
            need, have = (shingles(x, k, short=False) if k else set() for x in (q, t))
            n = len(need & have)
            if d is not None and i is not None and need and 100 * n >= 80 * len(need):
                out.add((d, i, n, len(need)))
    return out


def cases():
    rng = random.Random(2)
    items = [(i, prose(rng, n, 4000)) for i, n in enumerate([5, 6, 9, 17, 30, 55, 300])]
    items += [(90, None), (91, ""), (92, "too few words"), (None, items[3][1]), (3, items[4][1]), (3, items[3][1]), (93, " ".join(["same"] * 40))]
    items += [(94, "gap"), (95, "GAP gap"), (96, " ".join(items[2][1].split()[1:5])), (97, "gap"), (98, "words few"), (99, "same same same")]
    docs = []
    for k in range(40):
        w = prose(rng, rng.choice([3, 40, 3000]), 4000).split()
        i = rng.randrange(7)
        q = items[i][1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            q[rng.randrange(len(q))] = "changed"
        at = rng.randrange(len(w))
        docs.append((k, " ".join(w[:at] + [x.upper() if k % 2 else x for x in q] + w[at:])))
    half = items[5][1].split()
    docs += [(50, " ".join(half[:30]) + " gap " * 900 + " ".join(half[26:])), (51, None), (52, ""), (53, "same " * 30), (54, "ends with too few"), (55, "words"), (56, "few words too few"), (57, "too"), (58, "Words Few"), (None, docs[0][1]), (1, docs[1][1])]
    return docs, items


def items_df(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, n_shared int")


def test_equal_to_exact_containment_in_one_block_and_in_many(spark):
    docs, items = cases()
    want = brute(docs, items)
    assert len(want) > 20
    for block in (1 << 20, 600):
        got = op1.contaminated(docs_df(spark, docs), items_df(spark, items), block_bytes=block).collect()
        assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == want and len(got) == len(want)
        assert all(abs(r.containment - r.n_shared / r.n_item) < 1e-6 for r in got)


def test_stage_drops_what_contains_an_item(spark):
    docs, items = cases()
    def holds(q, t):
        k = min(5, len(words(q)))
        need, have = (shingles(x, k, False) if k else set() for x in (q, t))
        return 100 * len(need & have) >= 80 * len(need) > 0

    bad = {t for d, t in docs if any(i is not None and holds(q, t) for i, q in items)}
    df = docs_df(spark, docs)
    for block in (1 << 20, 600):
        left = op1.drop_contaminated(df, items_df(spark, items), block_bytes=block)
        assert left.schema == df.schema
        assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, t in docs if t not in bad)


def test_empty_tables(spark):
    docs, items = cases()
    assert op1.contaminated(docs_df(spark, docs).limit(0), items_df(spark, items)).collect() == []
    assert op1.contaminated(docs_df(spark, docs), items_df(spark, items).limit(0)).collect() == []
