"""Literal cases for the scalar rules, including the reference's quirks (FIXTURES.md section 4)."""

from pyspark.sql import functions as F

from fleetcat import functions as fx
from fleetcat.functions.names import with_clean_field_name


def one(spark, expr, *values, schema="a string"):
    df = spark.createDataFrame([values], schema)
    return df.select(expr.alias("r")).first()["r"]


def test_system_and_technical(spark):
    assert one(spark, fx.is_system_table("a"), "LocalDateTable_12")
    assert one(spark, fx.is_system_table("a"), "RowNumber-7")
    assert not one(spark, fx.is_system_table("a"), "Sales")
    assert one(spark, fx.is_technical("a"), "NoRecords")
    assert one(spark, fx.is_technical("a"), "!hidden")
    assert one(spark, fx.is_technical("a"), "tooltip page")
    assert not one(spark, fx.is_technical("a"), "My Tooltip")


def test_redact_secrets_three_quoting_forms(spark):
    assert one(spark, fx.redact_secrets("a"), "x token=abc y") == "x token=*** y"
    assert one(spark, fx.redact_secrets("a"), "password: 'hunter2'") == "password='***'"
    assert one(spark, fx.redact_secrets("a"), 'ApiKey = "k1"&more') == 'ApiKey="***"&more'
    assert one(spark, fx.redact_secrets("a"), 'key="unclosed') == 'key="unclosed'


def test_escape_html_redacts_then_escapes(spark):
    assert one(spark, fx.escape_html("a"), "<b>pwd=abc&x</b>") == "&lt;b&gt;pwd=***&amp;x&lt;/b&gt;"
    assert one(spark, fx.escape_html("a"), None) == ""
    assert one(spark, fx.escape_html("a"), "it's \"q\"") == "it&#x27;s &quot;q&quot;"


def test_redact_sensitive_order(spark):
    src = 'Sql.Database("10.1.2.3", "db") Web.Contents("http://h") token = "t"'
    out = one(spark, fx.redact_sensitive("a"), src)
    # the IP rule runs first; the connector rule then replaces the (already redacted) quoted arguments
    assert out == 'Sql.Database("[REDACTED_SERVER]", "[REDACTED_DB]") Web.Contents("[REDACTED_URL]") token="[REDACTED]"'


def test_safe_id_keeps_unicode_letters(spark):
    assert one(spark, fx.safe_id("a"), "Umsatz €/Jahr é1") == "Umsatz___Jahr_é1"


def test_fit_label_budgets(spark):
    df = spark.createDataFrame([("Quarterly revenue", 43.0), ("Quarterly revenue", 44.0), ("Quarterly revenue", 1000.0),
                                ("Quarterly revenue", 120.0)], "t string, w double")
    got = [r["r"] for r in df.select(fx.fit_label("t", "w").alias("r")).collect()]
    assert got == [None, "Qua…", "Quarterly revenue", "Quarterly…"]


def test_clean_field_name_cases(spark):
    cases = {
        "Values: Sum(part.x) -> Agg(part[Measure 123])": "Measure 123",
        "Values: Sum(part.x) -> Agg(part[Measure 12])": "Measure",
        "Category: part.p_brand -> part[p_brand]": "p_brand",
        "Tooltips: Count(part.p_type)) -> part.p_type": "p_type",
        "Sum(Sales[Amount])": "Amount",
        "Average(x))": "x",  # unwrap gives "x)", then the unbalanced ")" goes
        "plain months1": "plain months",
    }
    df = spark.createDataFrame([(k,) for k in cases], "f string")
    got = {r["f"]: r["c"] for r in df.select("f", fx.clean_field_name("f").alias("c")).collect()}
    assert got == cases
    got2 = {r["f"]: r["clean"] for r in with_clean_field_name(df, "f", "clean").collect()}
    assert got2 == cases


def test_classify_source_first_match(spark):
    df = spark.createDataFrame([('AzureSql.Database("a")',), ("Table.FromRows(Json.Document(Binary.Decompress(x)))",),
                                ("Table.Combine({A, B})",), ("#table(type table [a=text], {}) DateTime.LocalNow()",)], "c string")
    got = [(r["k"]["category"], r["k"]["connection_type"]) for r in df.select(fx.classify_source("c").alias("k")).collect()]
    assert got == [("Database", "SQL Server"), ("File", "JSON"), ("Computed", None), ("Other", "Manual/Inline Table")]


def test_hana_info(spark):
    code = 'SapHana.Database("srv"){[Name="Contents"]}[Data]{[Name="pkg"]}[Data]{[Name="view"]}[Data]'
    r = one(spark, fx.hana_source_info("a"), code)
    assert (r["package"], r["view"], r["connection"]) == ("pkg", "view", "hardcoded")
    r = one(spark, fx.hana_source_info("a"), 'SapHana.Database(HanaServer) ""&HanaView&""')
    assert (r["package"], r["view"], r["connection"]) == ("--", "(via HanaView param)", "via HanaServer param")


def test_field_reference(spark):
    j = '{"Aggregation":{"Expression":{"Column":{"Expression":{"SourceRef":{"Entity":"T"}},"Property":"c"}},"Function":0}}'
    assert one(spark, fx.field_reference("a"), j) == "Agg(T[c])"
    assert one(spark, fx.field_reference("a"), '{"HierarchyLevel":{"Level":"Year"}}') == "HierarchyLevel(Year)"


def test_error_code_and_fingerprint(spark):
    import hashlib
    h = hashlib.sha1(b"ValueError:PARSE").hexdigest()[:8].upper()
    assert one(spark, fx.error_hash(F.lit("PARSE"), F.lit("ValueError")), "x") == h
    fp = hashlib.sha256(b"sales.model_3_2").hexdigest()[:8]
    assert one(spark, fx.model_fingerprint(F.lit("sales.model"), F.lit(3), F.lit(2)), "x") == fp


def test_py_strip_knows_every_white_space(spark):
    from fleetcat.functions.common import py_strip
    space = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    texts = [space + "x y" + space, "​x​", "", space]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert sorted(r[0] for r in df.select(py_strip("t")).collect()) == sorted(t.strip() for t in texts)


def test_function_calls_of_a_measure(spark):
    from fleetcat.operators.lineage import function_calls
    m = spark.createDataFrame([(1, "T", "A", 1, 'IF(SUM(t[a (b)]) > 0, sum (t[x]), "MAX(1)") -- MIN(2)')],
                              "model_id long, table_name string, name string, ordinal long, expression string")
    assert sorted((r["function"], r["n_calls"]) for r in function_calls(m).collect()) == [("IF", 1), ("SUM", 2)]


def test_binary_payloads(spark):
    cases = {
        'Table.FromRows(Json.Document(Binary.Decompress(Binary.FromText("i45W", BinaryEncoding.Base64))))': True,
        'Table.FromRows( \n Json.Document(\n Binary.Decompress(x, Compression.Deflate)))': True,
        'Binary.Decompress(\n  Binary.FromText("a"))': True,
        'Binary.Decompress(File.Contents("a")) & later(Binary.FromText("b"))': True,  # the lazy span crosses anything
        'Binary.FromText("a") then Binary.Decompress(x)': False,
        'Table.FromRows(Json.Document(x))': False, 'binary.decompress(binary.fromtext(': False, "": False,
    }
    for code, want in cases.items():
        assert one(spark, fx.is_binary_payload("a"), code) is want, code
    assert one(spark, fx.is_binary_payload("a"), None) is False


def test_wells_and_their_labels(spark):
    assert one(spark, fx.well_of("a"), "Category: x -> T[c]") == "Category"
    assert one(spark, fx.well_of("a"), "Y: Sum(T.c)") == "Y"
    for raw in ("T[c]", "category: T[c]", "Category:T[c]", " Category: T[c]", "Nowhere: T[c]", ""):
        assert one(spark, fx.well_of("a"), raw) == "Values", raw
    labels = {"Category": "X-axis", "X": "X-axis", "Axis": "X-axis", "Y": "Y-axis", "Y2": "Y-axis (secondary)", "Series": "Legend", "Legend": "Legend",
              "Values": "Value", "Rows": "Rows", "Columns": "Columns", "Tooltips": "Tooltips", "Details": "Detail", "Size": "Size", "Nowhere": "Nowhere"}
    df = spark.createDataFrame([(w,) for w in labels], "a string").select("a", fx.well_label("a").alias("r"))
    assert {r.a: r.r for r in df.collect()} == labels
