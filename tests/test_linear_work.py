"""Work that follows the input: search postings, name candidates, field names without needless patterns, pages settled in their row."""

from fleetcat.functions import names as N
from fleetcat.operators import search, usage


def test_search_tries_postings_once_per_place(spark, tmp_path):
    """Codes that share their grams: postings are one per character, and queries meet labels by their whole text."""
    labels = [f"{a}{b}#0{c}" for a in "ab" for b in range(10) for c in range(100, 120)]
    index = search.build_index(spark.createDataFrame([(1, [x], x) for x in labels], "model_id long, path array<string>, label string"), str(tmp_path))
    assert index.table(spark, "labels").count() == sum(map(len, labels))
    asked = [f"#0{c}" for c in range(100, 120)] + ["b", "a1", "#011 ", "", "9#0119x"]
    got = search.search(index, spark.createDataFrame([(x,) for x in asked], "query string")).collect()
    want = {(x, label) for x in asked for label in labels if x.strip() in label}
    assert {(r.query, r.label) for r in got} == want and len(got) == len(want) and all(r.is_match for r in got)


def test_names_meet_fields_before_they_are_cut_up(spark):
    """Characters of fields are listed only for models with names of one character."""
    names = spark.createDataFrame([(1, "total"), (1, "tot"), (2, "x")], "model_id long, key string")
    visuals = spark.createDataFrame([(1, "Sum: Total"), (1, "to"), (2, "Ax"), (2, None), (3, "total")], "model_id long, field string")
    found = {tuple(r) for r in usage._bound_substrings(names, visuals).collect()}
    assert found == {(1, "total"), (1, "tot"), (2, "a"), (2, "x"), (2, "")}


def test_field_names_without_needless_patterns(spark):
    rows = [("Values: Sum(p.x) -> Agg(p[Measure 120])", "Measure 120"), ("Y2: a[][b]c", "a[][b]c"), ("X -> a[][b]c", "b"), ("q -> -> z", "-> z"), ("Y: n7\n", "n"),
            ("Agg(t[Total Sales 12])", "Total Sales"), ("Count(p.q))", "q"), ("sum(x)", "x"), ("\u3000Size\x85", "Size"), ("Axis: ", ""), ("", ""), (None, None)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "i int, s string")
    out = N.with_clean_field_name(df, "s", "flat").withColumn("bound", N.clean_field_name("s"))
    got = out.orderBy("i").collect()
    assert [(r.flat, r.bound) for r in got] == [(want, want) for _, want in rows]
    plan = df.select(N.well_of("s"), N.py_strip("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
