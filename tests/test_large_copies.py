"""Faults that showed on larger copies: broadcasts of whole tables, filters and files paid per model."""

import os

import pytest
from pyspark.sql import functions as F

from fleetcat.operators import rules as R
from fleetcat.operators import time_intel as T
from fleetcat.session import cut_lineage
from fleetcat.sources import definitions as defs
from fleetcat.sources import sink
from fleetcat.sources.layout_variant import parse_layouts, scan_page_documents


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(path, ending=".parquet"):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(ending)]


def test_calendar_periods_are_not_broadcast(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("e"), F.expr("add_months(date'2020-01-01', cast(id as int))").alias("p"), F.col("id").alias("v"))
    cal = T.on_calendar(cut_lineage(rows, "sparse"), ["e"], "p")
    assert "Broadcast" not in plan(cal)
    cal = cut_lineage(cal, "calendar")
    out = T.shifted_on_calendar(T.shifted_on_calendar(cal, ["e"], "p", "v", 1, "month"), ["e"], "p", "v", 7, "seven", source=cal)
    assert "Broadcast" not in plan(out)
    got = {(r.e, r.p): r for r in out.collect()}
    assert all(r.month is None and (r.seven is None) == (r.v is None or r.v < 7) for r in got.values() if r.v is not None)


def test_bloom_filters_of_small_models_are_small(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 40).alias("model_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    path = sink.update_catalog(rows, str(tmp_path / "t"), ["name"])
    files = stored(path)
    assert spark.read.parquet(path).count() == 400 and sum(os.path.getsize(f) for f in files) < 8192 * len(files)


def test_large_models_are_split(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, F.lit(None).cast("int")).otherwise(F.col("id").cast("int")).alias("model_id"), "id")
    dealt = sink._by_model(rows, "model_id", rows_a_task=100)
    parts = dealt.withColumn("p", F.spark_partition_id()).groupBy("model_id").agg(F.count_distinct("p").alias("n"), F.count("id").alias("rows")).collect()
    assert sum(r.rows for r in parts) == 1000 and all((r.n > 1) == (r.model_id is None) for r in parts)


def test_pages_are_not_broadcast(spark):
    files = [(1, "R.Report/definition/pages/a/page.json", '{"displayName":"A"}'), (1, "R.Report/definition/pages/a/visuals/v/visual.json", "{}")]
    parsed = parse_layouts(spark.createDataFrame(files, "model_id int, path string, text string"), ["model_id"], "text", extra=["path"])
    out = scan_page_documents(parsed, ["model_id"])
    assert "Broadcast" not in plan(out) and [r.page_name for r in out.collect()] == ["A"]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 6, 11, 12, 23, 24, 40])
def test_rules_of_any_length_without_broadcast(spark, size):
    words = [("x" * size)[:-1] + c for c in "abc"]
    rules = [(p, w, f"c{p}", None) for p, w in enumerate([*words, words[0], words[0]])]
    texts = [(f"- {w} -",) for w in words] + [(w,) for w in words] + [(" ".join(words[1:]),), ("x" * 50,), ("",), (None,)]
    schema = "priority int, keyword string, category string, connection_type string"
    out = R.first_rules(spark.createDataFrame(texts, "t string"), "t", spark.createDataFrame(rules, schema))
    assert "Broadcast" not in plan(out)
    want = {t: min(r[0] for r in rules if r[1] in t) for t, in texts if t and any(r[1] in t for r in rules)}
    assert {r.text: r.priority for r in out.collect()} == want


def test_definition_files_are_packed(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 3).alias("model_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("file"),
                                   F.concat(F.lit("table t\n\n\tmeasure "), F.col("id").cast("string"), F.lit("\n")).alias("value"))
    packs = defs.pack_definition_files(rows.coalesce(2), str(tmp_path / "packs"))
    assert len(stored(packs)) <= 2
    cols = ["model_id", "file", "line_no", "line"]
    want = defs.scan_definition_lines(spark, defs.write_definition_files(rows.limit(20), str(tmp_path / "files")))
    names = {r.file for r in want.select("file").collect()}
    got = defs.scan_definition_lines(spark, packs, packed=True)
    assert got.count() == 1200
    assert sorted(map(tuple, got.where(F.col("file").isin(list(names))).select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
