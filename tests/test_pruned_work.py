"""Work that cannot find anything is left out: fields of models without names, parses of JSON text without the key."""

from fleetcat.functions.text import field_reference
from fleetcat.operators import usage


def test_fields_of_models_without_names_are_not_cut_up(spark):
    names = spark.createDataFrame([(1, "total"), (2, "x")], "model_id long, key string")
    visuals = spark.createDataFrame([(1, "Values: Total"), (2, None), (3, "Y: total"), (None, "total")], "model_id long, field string")
    found = {tuple(r) for r in usage._bound_substrings(names, visuals).collect()}
    assert (1, "total") in found and {m for m, _ in found} == {1}


def test_unused_measures_with_models_on_one_side_only(spark):
    measures = spark.createDataFrame([(1, "Total"), (1, "Gone"), (2, "Lone"), (None, "Total")], "model_id long, name string")
    visuals = spark.createDataFrame([(1, "Values: total"), (3, "Gone"), (None, "Total")], "model_id long, field string")
    assert [tuple(r) for r in usage.unused_measures(measures, visuals).collect()] == [(1, "Gone")]


def test_references_skip_parses_for_absent_keys_only(spark):
    rows = [
        ('{"Measure":{"Expression":{"SourceRef":{"Entity":"t"}},"Property":"m"}}', "t[m]"),
        ('{"\\u004deasure":{"Property":"m"}}', "[m]"),  # an escaped key
        ('{"Aggregation":{"Expression":{"Column":{"Property":"c"}}}}', "Agg([c])"),
        ('{"HierarchyLevel":{"Level":"Year","Measure":1}}', "HierarchyLevel(Year)"),
        ('{"Other":{"Measure":{"Property":"m"}}}', ""), ("no json, Measure", ""), ("", ""), (None, ""),
    ]
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(rows)], "i int, j string")
    out = df.select("i", field_reference("j").alias("ref"))
    assert [r["ref"] for r in out.orderBy("i").collect()] == [ref for _, ref in rows]
    assert "contains(j" in out._jdf.queryExecution().optimizedPlan().toString().lower()
