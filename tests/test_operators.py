"""Operator tests: literal quirk cases and brute-force comparisons on small inputs."""

import random
import re

from pyspark.sql import functions as F

from conftest import rows
from fleetcat.operators import layout, measures, segment, usage
from fleetcat.sources.quarantine import unit_status

PAGE = ("model_id long, page_id long, pos long, type string, title string, x double, y double, "
        "width double, height double, z double, page_width double, page_height double")


def _page(spark, items):
    return spark.createDataFrame([(1, 1, i + 1, t, "", float(x), float(y), float(w), float(h), float(z), 1280.0, 720.0)
                                  for i, (t, x, y, w, h, z) in enumerate(items)], PAGE)


def test_consolidate_chain_absorbed_cannot_absorb(spark):
    # A covers B (0.98), B covers C (0.96), A does not cover C (0.94): B is absorbed, so C stays.
    v = _page(spark, [("textbox", 0, 0, 100, 100, 0), ("textbox", 2, 0, 100, 100, 1), ("textbox", 6, 0, 100, 100, 2)])
    out = rows(layout.consolidate_layers(v), "pos", "absorbed")
    assert out == [(1, False), (2, True), (3, False)]


def test_consolidate_only_text_and_buttons_absorbed(spark):
    v = _page(spark, [("barChart", 0, 0, 500, 300, 0), ("card", 10, 10, 100, 50, 1), ("actionButton", 10, 10, 100, 50, 2)])
    out = rows(layout.consolidate_layers(v), "pos", "absorbed")
    assert out == [(1, False), (2, False), (3, True)]


def test_overlap_pairs_literal(spark):
    # a background covers everything; two half-overlapping cards; a zero-width line; one element apart; one inside
    v = _page(spark, [("shape", 0, 0, 1280, 720, 0), ("card", 100, 100, 200, 100, 1), ("card", 200, 100, 200, 100, 2),
                      ("shape", 150, 0, 0, 700, 3), ("card", 900, 600, 100, 50, 4), ("card", 350, 100, 50, 50, 5), ("card", 400, 0, 10, 10, 6)])
    got = {(r["pos_a"], r["pos_b"]): round(r["ioa"], 6) for r in layout.overlap_pairs(v).collect()}
    assert got == {(1, 2): 1.0, (1, 3): 1.0, (2, 3): 0.5, (1, 5): 1.0, (1, 6): 1.0, (3, 6): 1.0, (1, 7): 1.0}


def test_badge_offsets_half_even(spark):
    v = _page(spark, [("card", 9, 0, 100, 100, 0), ("card", 15, 0, 100, 100, 1), ("card", 21, 0, 100, 100, 2)])
    c = layout.consolidate_layers(v)
    out = rows(layout.wireframe(c), "pos", "z_number", "badge_offset")
    # 9/6 = 1.5 and 15/6 = 2.5 both round half-even to 2; 21/6 = 3.5 rounds to 4
    assert out == [(1, 1, 0), (2, 2, 20), (3, 3, 0)]


def test_unused_substring_semantics(spark):
    m = spark.createDataFrame([(1, 1, "T", "Measure 1"), (1, 2, "T", "Measure 3"), (1, 3, "T", "Other")],
                              "model_id long, ordinal long, table_name string, name string")
    v = spark.createDataFrame([(1, "Values: x -> T[Measure 12]")], "model_id long, field string")
    assert rows(usage.unused_measures(m, v), "name") == [("Measure 3",), ("Other",)]
    assert rows(usage.unused_report(m, v), "name") == [("Measure 3",), ("Other",)]


def test_unused_edges_of_pruning(spark):
    m = spark.createDataFrame([(1, 1, "T", "x"), (1, 2, "T", "AB"), (1, 3, "T", "q"), (1, 4, "T", "zab1")],
                              "model_id long, ordinal long, table_name string, name string")
    v = spark.createDataFrame([(1, "zzab"), (1, "X")], "model_id long, field string")
    # 'ab' ends the first field, 'x' is a one-character name found case-insensitively
    assert rows(usage.unused_measures(m, v), "name") == [("q",), ("zab1",)]


def test_empty_measure_name_occurs_in_every_field(spark):
    m = spark.createDataFrame([(1, 1, "T", ""), (1, 2, "T", "gone"), (2, 1, "T", "")], "model_id long, ordinal long, table_name string, name string")
    v = spark.createDataFrame([(1, "x"), (2, None)], "model_id long, field string")
    assert rows(usage.unused_measures(m, v), "model_id", "name") == [(1, "gone"), (2, "")]


def test_query_steps_literal(spark):
    codes = {
        0: 'let\n  Source = Sql.Database("s", "d"),\n  Kept = Table.SelectRows(Source,\n    each true)\nin\n  Kept',
        1: "let Source = 1\nin Source",  # a first step on the 'let' line is not a step of its own
        2: 'let\n    #"Step one" = Csv.Document(x),\n\n    Typed = Table.Transform(#"Step one", f),\nin\n    Typed',
        3: "no steps here", 4: None,
        5: 'let\n  A = Table.FromRows(Json.Document(Binary.Decompress(Binary.FromText("xx"))))\nin A',
        6: "let\n  Empty =\nin Empty",
    }
    df = spark.createDataFrame(list(codes.items()), "ordinal long, expression string")
    got = rows(segment.split_query_steps(df, ["ordinal"]), "ordinal", "step_no", "step", "step_expression")
    assert got == [
        (0, 1, "Source", 'Sql.Database("s", "d")'), (0, 2, "Kept", "Table.SelectRows(Source,\n    each true)"),
        (2, 1, "Step one", "Csv.Document(x)"), (2, 2, "Typed", 'Table.Transform(#"Step one", f)'),
        (5, 1, "A", 'Table.FromRows(Json.Document(Binary.Decompress(Binary.FromText("xx"))))')]


def test_audit_embedded_blocks_positive(spark):
    df = spark.createDataFrame([(1, "<html><script>{{x}}</script><STYLE>p{}</STYLE><script>mermaidAPI {{y}}</script></html>")],
                               "page_id long, html string")
    out = rows(segment.audit_embedded_blocks(df), "tag", "block_no", "skipped", "double_brace")
    assert out == [("script", 1, False, True), ("script", 2, True, True), ("style", 1, False, False)]


def test_quarantine_malformed_json(spark):
    df = spark.createDataFrame([(1, '[{"a":"1"}]'), (2, '[{"a":'), (3, None)], "id long, payload string")
    out = rows(unit_status(df, ["id"], "payload", "array<struct<a:string>>"), "id", "status")
    assert out == [(1, "ok"), (2, "quarantined"), (3, "ok")]


def _measures_from_text(spark, text):
    lines = segment.lines_of(spark.createDataFrame([(1, "f", text)], "model_id long, file string, value string"),
                             ["model_id", "file"])
    return rows(segment.measures(segment.table_blocks(lines, ["model_id", "file"]), ["model_id", "file"]),
                "name", "expression", "format_string")


def test_segmentation_quirks(spark):
    text = "\n".join([
        "table 'T'",
        "\tmeasure 'A' = SUM(x)",       # inline part prevents dedent of continuation lines
        "\t\t\t+ 1",
        "\t\tformatString: \"0.0\"",
        "",
        "\tmeasure B =",                 # fenced on the next line
        "\t\t\t```",
        "\t\t\t\tline1",
        "\t\t\t\t",
        "\t\t\t\tline2",
        "\t\t\t```",
        "\tmeasure 'C' =",              # a blank line ends the continuation and the properties
        "\t\t\tx",
        "",
        "\t\tformatString: ignored",
    ])
    assert _measures_from_text(spark, text) == [
        ("A", "SUM(x)\n\t\t\t+ 1", "0.0"), ("B", "line1\n\nline2", None), ("C", "x", None)]


def test_fences_open_only_after_an_opener(spark):
    text = "\n".join([
        "table 'T'",
        "/// a description",
        "\tmeasure A = ```",            # a fence on the header line is expression text
        "\t\t\tSUM(x)",
        "\t\t\t```",
        "\t\tformatString: \"0\"",
        "```",                           # a stray fence is an ordinary line
        "\tmeasure B =",
        "\t\t\t```",
        "\t\t\tmeasure Z = inside the fence",
        "\t\t\t```",
        "\t\tformatString: \"0.0\"",
        "\tmeasure C = 3",
        "\t\tformatString: \"0.00\"",
        "\t\t```",                       # stray again, among the properties
        "\tcolumn k",
        "\t\tdataType: int64",
        "\tmeasure D =",
        "\t\t\t```",
        "\t\t\tmeasure E =",              # looks like an opener, but the next fence closes
        "\t\t\t```",
        "\t\tformatString: last",
    ])
    assert _measures_from_text(spark, text) == [
        ("A", "```\n\t\t\tSUM(x)\n\t\t\t```", "0"), ("B", "measure Z = inside the fence", "0.0"), ("C", "3", "0.00"),
        ("D", "measure E =", "last")]
    keys = ["model_id", "file"]
    lines = segment.lines_of(spark.createDataFrame([(1, "f", text)], "model_id long, file string, value string"), keys)
    assert rows(segment.columns(segment.table_blocks(lines, keys), keys), "column_name", "data_type") == [("k", "int64")]


def test_replies_keep_their_rows(spark):
    from fleetcat.operators.scope import enrich_definitions
    item = '{"schema_version":"1","object_type":"Measure","table":"t","object_name":"A"}'
    d = spark.createDataFrame([(1, 1, f"[{item}]"), (1, 2, f"Sure, here it is: [ {item} , {item} ] Bye [1]"), (1, 3, "[{broken}]"),
                               (1, 4, "no"), (1, 5, None)], "model_id long, ordinal long, payload string")
    o = spark.createDataFrame([(1, "measure", "a", "T")], "model_id long, object_type string, object_name string, table_name string")
    out = rows(enrich_definitions(d, o), "ordinal", "status", "n_items", "n_matched", "n_skipped")
    assert out == [(1, "ok", 1, 1, 0), (2, "ok", 2, 2, 0), (3, "unreadable", 0, 0, 0), (4, "unreadable", 0, 0, 0), (5, "unreadable", 0, 0, 0)]


def test_shifted_days_do_not_multiply_rows(spark):
    import datetime as dt
    from fleetcat.operators import time_intel as ti
    days = [dt.date(2023, 1, d) for d in (28, 29, 30, 31)] + [dt.date(2023, 2, 28)]
    df = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "day date, total double")
    got = rows(ti.with_shifted(df, "day", "total", 1, "month", "before"), "total", "before")
    assert got == [(0.0, None), (1.0, None), (2.0, None), (3.0, None), (4.0, 0.0)]


def test_building_a_query_runs_no_job_and_plans_stay_in_the_engine(spark, sf_small, monkeypatch):
    """Building a query only plans; exceptions: writers (inputs of scans, indexes, stored and cut tables), rounds,
    range-partitioned numberings and the export's scope.

    Opening a Parquet table reads one footer in a job of its own.  Plans hold
    no Python evaluation, no nested loops and no shrinking window frames.
    """
    from fleetcat.plans.registry import QUERIES, load_all
    from pyspark.sql.readwriter import DataFrameReader
    load_all()
    opened, parquet = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *a, **k: (opened.append(a), parquet(self, *a, **k))[1])
    tracker = spark.sparkContext.statusTracker()
    for name in QUERIES:
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        opened.clear()
        query = QUERIES[name](spark, sf_small)
        writers = ("S1_", "S3_", "S4_", "S7_counted", "S8_", "J13_search", "P10_classify_by_rule", "M4_distinctcount_rollup", "M12_M13_M14", "M27_M30")
        if not name.startswith((*writers, "A5", "A10", "J8", "W1", "M21", "M22_concatenatex_rows", "M23")) and not name.endswith("_one_file"):
            assert len(tracker.getJobIdsForGroup(f"build-{name}")) <= len(opened), name
        plan = query._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
        # shrinking frames (k .. unbounded following) re-aggregate per row; whole-partition frames are fine
        frames = re.findall(r"specifiedwindowframe\((?:row|range)frame, ([^,]+), unboundedfollowing\$\(\)\)", plan.lower())
        assert all(f.strip() == "unboundedpreceding$()" for f in frames), (name, frames)
    spark.sparkContext.setJobGroup("tests", "tests")


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"model_id", "measure", "depends_on_measures", "depends_on_columns"}
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)


def test_numbering_and_ranks_equal_windows_with_nulls(spark):
    from pyspark.sql import Window
    from fleetcat.operators.common import rank_within, ranks_within, row_number_within
    rnd = random.Random(3)
    data = [(rnd.choice([1, 1, 1, 2, None]), i, rnd.choice([None, *map(float, range(12))])) for i in range(400)]
    df = spark.createDataFrame(data, "g long, pos long, v double")
    w = Window.partitionBy("g").orderBy("v", "pos")
    assert rows(row_number_within(df, ["g"], ["v", "pos"], "rn"), "pos", "rn") == rows(df.withColumn("rn", F.row_number().over(w)), "pos", "rn")
    for descending in (False, True):
        wd = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_first())
        want = df.withColumn("r", F.rank().over(wd)).withColumn("d", F.dense_rank().over(wd))
        assert rows(rank_within(df, ["g"], "v", "r", descending=descending), "pos", "r") == rows(want, "pos", "r")
        assert rows(rank_within(df, ["g"], "v", "d", descending=descending, dense=True), "pos", "d") == rows(want, "pos", "d")
    spark.sparkContext.setJobGroup("ranks", "ranks")
    several = ranks_within(df, ["g"], "v", {"a": (False, False), "ad": (False, True), "d": (True, False), "dd": (True, True)})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ranks")) <= 8
    spark.sparkContext.setJobGroup("tests", "tests")
    for asc, dense, c in ((True, False, "a"), (True, True, "ad"), (False, False, "d"), (False, True, "dd")):
        wd = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first() if asc else F.col("v").desc_nulls_last())
        assert rows(several, "pos", c) == rows(df.withColumn(c, (F.dense_rank() if dense else F.rank()).over(wd)), "pos", c)


def test_a_large_model_is_written_by_several_tasks(spark, tmp_path):
    from fleetcat.sources.sink import write_text_export
    lines = spark.range(30000).selectExpr("cast(id % 10 < 7 as long) as model_id", "id as seq", "concat('line ', id) as line")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows here stand for many
    path = write_text_export(lines, str(tmp_path / "out"), ["model_id", "seq"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    import glob
    hot = sorted(glob.glob(path + "/model_id=1/*.txt"))
    assert len(hot) > 1
    assert "".join(open(f).read() for f in hot).split() == [x for i in range(30000) if i % 10 < 7 for x in ("line", str(i))]


def test_table_name_of_empty_file_is_stem(spark):
    files = spark.createDataFrame([(1, "tables/Sales.tmdl", "table 'Sales Fact'\n\tmeasure x = 1\n"),
                                   (1, "tables/Empty.tmdl", "")], "model_id long, file string, value string")
    assert rows(segment.table_names_of_files(files, ["model_id", "file"]), "file", "table_name") == [
        ("tables/Empty.tmdl", "Empty"), ("tables/Sales.tmdl", "Sales Fact")]


def test_text_export_keeps_line_order(spark, sf_small):
    import glob
    from fleetcat.plans.scope_queries import a10
    from fleetcat.operators.scope import export_text_order
    from fleetcat.sources.sink import shared_path, write_text_export
    lines = a10(spark, sf_small)
    path = write_text_export(lines, shared_path(spark, "export-test"), export_text_order())
    want = [r["line"] for r in lines.where("model_id = 3").orderBy(*export_text_order()).collect()]
    files = glob.glob(path.replace("file:", "") + "/model_id=3/*.txt")
    text = "".join(open(f).read() for f in sorted(files))
    assert text == "".join(x + "\n" for x in want)


def test_layout_fallbacks(spark):
    from fleetcat.sources.layout_json import scan_layout_json, scan_page_files
    proto = ('{"singleVisual":{"visualType":"card","prototypeQuery":{"Select":[{"Measure":{"Expression":{"SourceRef":'
             '{"Entity":"S"}},"Property":"Total"},"Name":"S.Total"}]}}}')
    layout = '{"sections":[{"visualContainers":[{"config":' + __import__("json").dumps(proto) + '},{"x":1}]}]}'
    docs = spark.createDataFrame([(1, layout)], "id long, layout string")
    out = scan_layout_json(docs, ["id"]).collect()
    assert len(out) == 1 and out[0]["page_name"] == "Unknown Page" and out[0]["fields"] == ["Values: S.Total -> S[Total]"]
    vis = ('{"visual":{"visualType":"tableEx","query":{"queryState":{"projections":[{"queryRef":"T.c",'
           '"field":{"Column":{"Expression":{"SourceRef":{"Entity":"T"}},"Property":"c"}}}]}}}}')
    files = spark.createDataFrame([(1, "R/definition/pages/p/page.json", '{"displayName":"P"}'),
                                   (1, "R/definition/pages/p/visuals/v/visual.json", vis)], "id long, path string, text string")
    got = scan_page_files(files, ["id"]).collect()
    assert got[0]["fields"] == ["T.c -> T[c]"] and got[0]["page_width"] == 1280.0


def test_layout_select_without_roles_defaults_to_values(spark):
    import json
    from fleetcat.sources.layout_json import scan_layout_json
    dt = {"selects": [{"displayName": "n", "roles": {}, "expr": {"Column": {"Expression": {"SourceRef": {"Entity": "T"}},
                                                                            "Property": "c"}}}]}
    vc = {"config": json.dumps({"singleVisual": {"visualType": "card"}}), "dataTransforms": json.dumps(dt)}
    docs = spark.createDataFrame([(1, json.dumps({"sections": [{"displayName": "P", "visualContainers": [vc]}]}))],
                                 "id long, layout string")
    assert scan_layout_json(docs, ["id"]).first()["fields"] == ["Values: n -> T[c]"]


def test_source_rules_can_be_extended(spark):
    from fleetcat.functions.code import SOURCE_RULES, classify_source, source_rules
    own = spark.createDataFrame([(2, "Sql.Database", "Ours", "Second"), (1, "My.Source", "Ours", "First")],
                                "priority int, keyword string, category string, connection_type string")
    df = spark.createDataFrame([("My.Source(Sql.Database)",), ("Sql.Database()",), ("none",)], "c string")
    rules = source_rules(own)
    got = [tuple(r[0]) for r in df.select(classify_source("c", rules)).collect()]
    assert got == [("Ours", "First"), ("Ours", "Second"), ("Computed", None)]
    assert [tuple(r[0]) for r in df.select(classify_source("c", (*rules[:1], *SOURCE_RULES))).collect()][1] == ("Database", "SQL Server")


def test_optional_lines_of_the_export(spark):
    from fleetcat.operators.scope import definition_export, export_text_order
    scope = spark.createDataFrame([(1, "T")], "model_id long, table_name string")
    parts = spark.createDataFrame([(1, 1, "T", False, "src")], "model_id long, ordinal long, table_name string, is_calculated boolean, expression string")
    cols = spark.createDataFrame([(1, "T", "c", "int64", True, "1", "True")],
                                 "model_id long, table_name string, column_name string, data_type string, is_calculated boolean, expression string, is_hidden string")
    meas = spark.createDataFrame([(1, 1, "T", "m", "2", "0", "F", True)],
                                 "model_id long, ordinal long, table_name string, name string, expression string, format_string string, display_folder string, is_hidden boolean")
    rels = spark.createDataFrame([(1, 1, "T", "a", "T", "b", "Both", False)],
                                 "model_id long, rel_id long, from_table string, from_column string, to_table string, to_column string, cross_filter string, is_active boolean")
    lines = [r["line"] for r in definition_export(scope, parts, cols, meas, rels).orderBy(*export_text_order()).collect()]
    text = "\n".join(lines)
    assert "\t\tdataType: int64\n\t\tisHidden\n\t\texpression" in text
    assert "\t\tdisplayFolder: F\n\t\tformatString: 0\n\t\tisHidden\n" in text and "\tisActive: false" in text


def test_pages_without_visuals_stay(spark):
    from fleetcat.sources.layout_json import layout_pages, page_file_pages
    docs = spark.createDataFrame([(1, '{"sections":[{"displayName":"A"},{"displayName":"B","visualContainers":[{"x":1},{"config":"{}"}]}]}'),
                                  (2, "broken")], "id long, layout string")
    assert rows(layout_pages(docs, ["id"]), "id", "page_no", "page_name", "n_visuals") == [(1, 1, "A", 0), (1, 2, "B", 1)]
    files = spark.createDataFrame([(1, "R/definition/pages/p/page.json", '{"displayName":"P"}')], "id long, path string, text string")
    assert rows(page_file_pages(files, ["id"]), "page_folder", "page_name") == [("p", "P")]


def test_concatenatex_as_ordered_rows(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *[f"v{i}" for i in range(400)]]), rng.randrange(9)) for _ in range(1500)]
    df = spark.createDataFrame(data, "g string, v string, o long").repartition(5)
    for order_by, descending in ((None, False), (None, True), ("o", False), ("o", True)):
        got = measures.concatenatex_rows(df, ["g"], "v", order_by, descending).collect()
        for g in ("a", "b", None):
            want = sorted(v for k, v, _ in data if k == g and v is not None)
            if order_by:
                want = [v for o in sorted({o for _, _, o in data}, reverse=descending) for v in sorted(v for k, v, p in data if k == g and v is not None and p == o)]
            elif descending:
                want.reverse()
            assert [(r.position, r.value) for r in sorted((r for r in got if r.g == g), key=lambda r: r.position)] == list(enumerate(want, 1))
    joined = {r.g: r.s for r in df.groupBy("g").agg(measures.concatenatex("v", "|").alias("s")).collect()}
    rows_of = measures.concatenatex_rows(df, ["g"], "v").orderBy("position").collect()
    assert joined == {g: "|".join(r.value for r in rows_of if r.g == g) for g in joined}
    plan = measures.concatenatex_rows(df, ["g"], "v")._jdf.queryExecution().toString()
    assert "listagg" not in plan and "collect_list" not in plan


def test_lineage_edges_literal(spark):
    from fleetcat.operators.lineage import lineage_edges
    expressions = {
        "Total": "SUM(Sales[Amount])",
        "Margin": "[total] - [Cost] // [Late]",
        "Quoted": "SUM('Fact Table'[Net Price]) + \"[Total]\" & [Nothing]",
        "Vars": "VAR base = [Total] RETURN [base] + [Both]",
        "Both": "/* [Total] */ [Margin] -- [Vars]",
        "Cut": "\"http://x\" & [Total]",  # comments go before strings, so the line ends at the slashes
        "Qualified": "Sales[Total] + [Cost] + [Cost]",
    }
    measures = spark.createDataFrame([(1, i, "Sales", n, e) for i, (n, e) in enumerate(expressions.items())] + [
        (1, 90, "LocalDateTable_1", "Hidden", "[Total]"), (2, 1, "Sales", "Other", "[Total] + [Cost]"), (1, -1, "Sales", "Total", "[Cost]"),
        (1, 91, "Sales", None, "[Total]"), (1, 92, "Sales", "Empty", None)],
        "model_id long, ordinal long, table_name string, name string, expression string")
    columns = spark.createDataFrame([(1, "Sales", "COST"), (1, "Sales", "Both"), (1, "Sales", None)], "model_id long, table_name string, column_name string")
    got = rows(lineage_edges(measures, columns), "model_id", "measure", "dep_kind", "dep")
    assert got == sorted([
        (1, "Total", "column", "Amount"), (1, "Margin", "measure", "total"), (1, "Margin", "column", "Cost"),
        (1, "Quoted", "column", "Net Price"), (1, "Vars", "measure", "Total"), (1, "Vars", "measure", "Both"),
        (1, "Both", "measure", "Margin"), (1, "Qualified", "column", "Total"), (1, "Qualified", "column", "Cost")])
