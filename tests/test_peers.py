"""M23 with two conditions against plain loops over all pairs."""

import random

import numpy as np
import pytest

from fleetcat.operators.peers import count_dominating_peers, earlier_smaller


def test_earlier_smaller_equals_a_loop():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 17, 64, 65):
        value = np.array([rng.randrange(9) for _ in range(n)], np.int64)
        weight = np.array([rng.randrange(1, 4) for _ in range(n)], np.int64)
        want = [sum(weight[j] for j in range(i) if value[j] < value[i]) for i in range(n)]
        assert earlier_smaller(value, weight).tolist() == want


@pytest.mark.parametrize("block", [1, 5, 64, 1 << 16])
@pytest.mark.parametrize("by", [["g", "h"], []])
def test_peers_equal_all_pairs(spark, block, by):
    """One group holds most rows; nulls, ties, NaN and copies occur; other columns stay."""
    rng = random.Random(5)
    data = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([1, None]), rng.choice([None, float("nan"), *map(float, range(12))]),
             rng.choice([None, *range(15)])) for i in range(300)]
    data += [(300 + i, "a", 1, 3.0, 4) for i in range(40)]
    df = spark.createDataFrame(data, "id long, g string, h int, x double, y int").repartition(4)
    nan_last = lambda x: (1, 0.0) if x != x else (0, x)
    want = {}
    for i, g, h, x, y in data:
        peers = [p for p in data if (not by or p[1:3] == (g, h)) and None not in (x, y, p[3], p[4])]
        want[i] = sum(nan_last(p[3]) > nan_last(x) and p[4] < y for p in peers)
    got = count_dominating_peers(df, by, "x", "y", "n", block=block)
    assert got.columns == ["id", "g", "h", "x", "y", "n"]
    assert {r.id: r.n for r in got.collect()} == want


def test_peers_of_nothing_and_plan(spark):
    none = spark.createDataFrame([], "g string, x double, y int")
    assert count_dominating_peers(none, ["g"], "x", "y", "n").collect() == []
    nulls = spark.createDataFrame([("a", None, 1), ("a", None, 1), (None, 1.0, None)], none.schema)
    assert [r.n for r in count_dominating_peers(nulls, ["g"], "x", "y", "n").collect()] == [0, 0, 0]
    rows = spark.range(2000).selectExpr("'a' as g", "id % 97 as x", "id % 89 as y")
    plan = count_dominating_peers(rows, ["g"], "x", "y", "n", block=64)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
