"""Catalog search, updates, counted quarantine, rule tables and measure contexts, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetcat.operators import measures as M
from fleetcat.operators import rules, search
from fleetcat.operators import time_intel as T
from fleetcat.sources import sink
from fleetcat.sources.quarantine import CountedParse, stage_counts


def test_search_equals_contains(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abAB é%_") for _ in range(rng.randrange(0, 7)))
    entries = {(m, ("Root", word(), word())[:rng.randrange(1, 4)]) for m in (1, None) for _ in range(120)}
    entries = {(m, p[:n]) for m, p in entries for n in range(1, len(p) + 1)}
    rows = [(m, list(p), p[-1]) for m, p in entries] + [(7, ["Root", None], None), (7, ["Root"], "Root")]
    index = search.build_index(spark.createDataFrame(rows, "model_id long, path array<string>, label string"), str(tmp_path))
    asked = ["", " ", "a", "AB", "ab ", "aba", "abab", "éa%", "_", "root", "nothing like it", "bb bb", "x"] + [word() for _ in range(25)] + [None, "a"]
    got = search.search(index, spark.createDataFrame([(x,) for x in asked], "query string")).collect()
    want = {}
    for query in {x for x in asked if x is not None}:
        for m, path, label in rows:
            if label is not None and query.strip().lower() in label.lower():
                for n in range(1, len(path) + 1):
                    key = (query, m, tuple(path[:n]))
                    want[key] = want.get(key, False) or n == len(path)
    assert {(r.query, r.model_id, tuple(r.path)): r.is_match for r in got} == want and len(got) == len(want)


def test_search_without_entries_or_queries(spark, tmp_path):
    none = spark.createDataFrame([], "model_id long, path array<string>, label string")
    index = search.build_index(none, str(tmp_path / "none"))
    assert search.search(index, spark.createDataFrame([("a",)], "query string")).collect() == []
    index = search.build_index(spark.createDataFrame([(1, ["a"], "a")], none.schema), str(tmp_path / "one"))
    assert search.search(index, spark.createDataFrame([], "query string")).collect() == []


def test_update_replaces_only_the_models_given(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(m, f"n{m}-{i}", i) for m in (1, 2, 3) for i in range(5)], "model_id long, name string, v int")
    sink.update_catalog(first, path, ["name"])
    files = {f for f in spark.read.parquet(path).where("model_id <> 2").select("_metadata.file_path").distinct().toPandas()["file_path"]}
    sink.update_catalog(spark.createDataFrame([(2, "new", 9), (4, "other", 8)], first.schema), path, ["name"])
    got = sorted(tuple(r) for r in sink.read_catalog(spark, path, first.schema).collect())
    assert got == sorted([tuple(r) for r in first.where("model_id <> 2").collect()] + [(2, "new", 9), (4, "other", 8)])
    assert files <= {f for f in spark.read.parquet(path).select("_metadata.file_path").distinct().toPandas()["file_path"]}
    assert sink.drop_models(spark, path, spark.createDataFrame([(4,), (99,)], "model_id long")) == 1
    assert spark.read.parquet(path).where("model_id = 4").isEmpty()


def test_lookup_by_name_skips_row_groups(spark, tmp_path):
    """An absent name between the least and the greatest: only the Bloom filter can tell that no row group holds it."""
    path = str(tmp_path / "t")
    rows = spark.range(20_000).select(F.lit(1).alias("model_id"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"))

    def rows_read(folder, name):
        df = spark.read.parquet(folder).where(F.col("name") == name)
        n = df.count()
        df = spark.read.parquet(folder).where(F.col("name") == name)
        df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return n, leaf.metrics().apply("numOutputRows").value()

    sink.update_catalog(rows.coalesce(1), path, ["name"])
    assert rows_read(path, "name 77") == (1, 20_000) and rows_read(path, "name 77x") == (0, 0)
    rows.coalesce(1).write.option("parquet.enable.dictionary", "false").parquet(str(tmp_path / "plain"))
    assert rows_read(str(tmp_path / "plain"), "name 77x") == (0, 20_000)


def test_units_are_counted_while_they_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"a": "x"}'), (2, '{"a": '), (3, None), (4, '{"a": 1}'), (5, "no")], "id int, t string")
    runs = [CountedParse(df, ["id"], "t", "a string", str(tmp_path / "p"), "FIRST"),
            CountedParse(df.where("false"), ["id"], "t", "a string", str(tmp_path / "q"), "SECOND")]
    assert sorted(tuple(r) for r in stage_counts(runs).collect()) == [("FIRST", 5, 1, 2), ("SECOND", 0, 0, 0)]
    assert sorted(r.id for r in runs[0].good.collect()) == [1, 3, 4] and sorted(r.id for r in runs[0].bad.collect()) == [2, 5]
    assert {r.stage for r in runs[0].bad.collect()} == {"FIRST"} and runs[1].bad.collect() == []


def test_rule_tables_of_any_size(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    table = [(rng.randrange(50), word(rng.randrange(1, 6)), f"c{i % 7}", f"t{i}") for i in range(3000)]
    table += [(60, None, "null", "null"), (70, "", "rest", "any")]
    texts = [None, "", "abc", "zzz", *[word(rng.randrange(1, 9)) for _ in range(60)], "abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, code string")
    for own in (table, table[:40], [r for r in table[:200] if len(r[1]) > 3]):
        got = rules.classify_by_rules(df, "code", spark.createDataFrame(own, "priority int, keyword string, category string, connection_type string"))
        for r in got.collect():
            fits = sorted(x for x in own if x[1] is not None and r.code is not None and x[1] in r.code)
            assert (r.category, r.connection_type) == (fits[0][2:] if fits else ("Computed", None))
    assert got.count() == len(texts)


def test_totals_in_contexts(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), rng.randrange(9)) for _ in range(200)]
    got = M.totals_in_contexts(spark.createDataFrame(rows, "k string, l string, v int"), ["k", "l"],
                               {"s": F.sum("v"), "m": F.max("v"), "d": F.count_distinct("v")}, {"k": ["k"], "l": ["l"], "all": []}).collect()
    assert {(r.k, r.l) for r in got} == {r[:2] for r in rows} and len(got) == len({r[:2] for r in rows})
    for r in got:
        for name, keep in (("", (0, 1)), ("_k", (0,)), ("_l", (1,)), ("_all", ())):
            mine = [v for *k, v in rows if all(k[i] == (r.k, r.l)[i] for i in keep)]
            assert (r["s" + name], r["m" + name], r["d" + name]) == (sum(mine), max(mine), len(set(mine)))


def test_distinct_counts_in_contexts(spark, monkeypatch):
    """Null keys and values, a value in most rows, more than 64 rows of contexts; values are never multiplied by the contexts."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([*range(40), None]), rng.choice([None, "hot", "hot", str(rng.randrange(60))]), rng.random()) for _ in range(900)]
    rows.append(("c", 99, None, 0.5))
    plans, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df, name))[1])
    got = M.totals_in_contexts(spark.createDataFrame(rows, "k string, l int, v string, x double"), ["k", "l"], {"m": F.max("x")},
                               {"k": ["k"], "l": ["l"], "all": []}, distinct={"d": "v", "e": F.upper("v")}).collect()
    assert len(got) == len({r[:2] for r in rows}) > 64
    for r in got:
        for name, keep in (("", (0, 1)), ("_k", (0,)), ("_l", (1,)), ("_all", ())):
            mine = [x for x in rows if all(x[i] == (r.k, r.l)[i] for i in keep)]
            n = len({x[2] for x in mine} - {None})
            assert (r["m" + name], r["d" + name], r["e" + name]) == (max(x[3] for x in mine), n, n)
    expands = [line for plan in plans for line in plan.splitlines() if "Expand" in line]
    assert expands and not any(" v#" in line or "[v#" in line for line in expands)


def test_contexts_query_shuffles_no_order_per_context(spark, sf_small, monkeypatch):
    from fleetcat.plans.registry import QUERIES, load_all
    load_all()
    plans, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df, name))[1])
    QUERIES["M12_M13_M14_contexts"](spark, sf_small)
    expands = [line for plan in plans for line in plan.splitlines() if "Expand" in line]
    assert expands and not any("l_orderkey" in line for line in expands)


def test_distinct_counts_roll_up(spark):
    rng = random.Random(5)
    values = [None, 0, 1, -1, 32767, 32768, 32769, -32768, -32769, 2**40, -2**40, 2**62, *[rng.randrange(-10**6, 10**6) for _ in range(300)]]
    rows = [(d, m, rng.choice(values)) for d in range(12) for m in "ab" for _ in range(60)]
    stored = M.distinct_buckets(spark.createDataFrame(rows, "day int, model string, v long"), ["day", "model"], "v")
    for group in (["day", "model"], ["model"], ["day"], []):
        got = {tuple(r[:-1]): r.n for r in M.distinct_count_of_buckets(stored, group, "n").collect()}
        at = [("day", "model").index(g) for g in group]
        want = {}
        for r in rows:
            want.setdefault(tuple(r[i] for i in at), set()).add(r[2])
        assert got == {k: len(v) for k, v in want.items()}


@pytest.mark.parametrize("unit, months", [("month", 1), ("quarter", 3), ("year", 12)])
def test_calendars_have_no_gaps(spark, unit, months):
    first = lambda k: dt.date(2020 + k // 12, k % 12 + 1, 1)
    facts = {("a", 0): 5, ("a", months * 2): 7, ("a", months * 9): 1, ("b", months * 3): 2, (None, 0): 4, (None, months): 6}
    rows = [(e, first(k), v) for (e, k), v in facts.items()]
    cal = T.on_calendar(spark.createDataFrame(rows, "e string, p date, v int"), ["e"], "p", unit)
    out = T.to_date_on_calendar(T.shifted_on_calendar(cal, ["e"], "p", "v", months, "before"), ["e"], "p", "v", "ytd")
    got = {(r.e, r.p): (r.v, r.before, r.ytd) for r in out.collect()}
    want = {}
    for e in ("a", "b", None):
        ks = [k for x, k in facts if x == e]
        for k in range(min(ks), max(ks) + 1, months):
            year = [facts[e, j] for j in range(k // 12 * 12, k + 1) if (e, j) in facts]
            want[e, first(k)] = (facts.get((e, k)), facts.get((e, k - months)) if k > min(ks) else None, sum(year) if year else None)
    assert got == want
