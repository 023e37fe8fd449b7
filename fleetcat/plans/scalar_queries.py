"""Registered scalar-function queries (P1-P27) with DuckDB oracles.

Each query applies one scalar builder to a whole catalog or driver table and
returns the key columns beside the result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcat import functions as fx
from fleetcat.functions.code import BINARY_MARKER, BINARY_PATTERNS, HANA_NAME_PATTERN, SOURCE_RULES
from fleetcat.functions.names import (
    TECHNICAL_DENYLIST, TECHNICAL_PATTERN, WELL_LABELS, with_clean_field_name,
)
from fleetcat.functions.text import SECRET_KEYS, SENSITIVE_RULES
from fleetcat.operators import descriptions, segment
from fleetcat.plans.registry import register
from fleetcat.plans.sqlbits import case_map, clean_field, escape_html, field_ref_sql, is_system, pystrip, q, visual_label
from fleetcat.session import read_table
from fleetcat.sources.fixtures import catalog, oracle_ctes


def _cat(spark, sf_dir, name):
    return catalog(spark, sf_dir, name)[name]


# ------------------------------------------------------------------ names

@register("P1_is_system_table", oracle=oracle_ctes("cat_measures")
          + f"select model_id, ordinal, table_name, {is_system('table_name')} as is_system from cat_measures")
def p1(spark, sf_dir):
    m = _cat(spark, sf_dir, "cat_measures")
    return m.select("model_id", "ordinal", "table_name", fx.is_system_table("table_name").alias("is_system"))


def _technical_sql(col):
    deny = ", ".join(q(d) for d in TECHNICAL_DENYLIST)
    c = f"coalesce(cast({col} as varchar), 'None')"
    return f"({c} in ({deny}) or starts_with({c}, '!') or regexp_matches({c}, {q(TECHNICAL_PATTERN)}))"


@register("P2_is_technical", oracle=oracle_ctes("cat_visuals")
          + f"select model_id, page_id, pos, title, {_technical_sql('title')} as is_technical from cat_visuals")
def p2(spark, sf_dir):
    v = _cat(spark, sf_dir, "cat_visuals")
    return v.select("model_id", "page_id", "pos", "title", fx.is_technical("title").alias("is_technical"))


@register("P8_safe_id", oracle="select page_id, regexp_replace(url, '[^\\p{L}\\p{N}]', '_', 'g') as safe_id from pages")
def p8(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", fx.safe_id("url").alias("safe_id"))


_VF = oracle_ctes("cat_visual_fields")


@register("P12_clean_field_name", oracle=_VF + f"""
select model_id, page_id, pos, field_no, clean from (select *, {clean_field('field', 'clean')} from cat_visual_fields)
""")
def p12(spark, sf_dir):
    f = _cat(spark, sf_dir, "cat_visual_fields")
    return with_clean_field_name(f, "field", "clean").select("model_id", "page_id", "pos", "field_no", "clean")


def _well_sql():
    from fleetcat.functions.names import _WELL_ALT
    return f"coalesce(nullif(coalesce(regexp_extract(field, '^({_WELL_ALT}): ', 1), ''), ''), 'Values')"


@register("P13_well_of", oracle=_VF + f"""
select model_id, page_id, pos, field_no, well, {case_map('well', WELL_LABELS)} as well_label
from (select *, {_well_sql()} as well from cat_visual_fields)
""")
def p13(spark, sf_dir):
    f = _cat(spark, sf_dir, "cat_visual_fields")
    return (f.select("model_id", "page_id", "pos", "field_no", fx.well_of("field").alias("well"))
            .withColumn("well_label", fx.well_label("well")))


@register("P14_is_measure_field", oracle=_VF + """
select model_id, page_id, pos, field_no, (contains(field, 'Agg(') or contains(field, 'Measure')) as is_measure
from cat_visual_fields
""")
def p14(spark, sf_dir):
    f = _cat(spark, sf_dir, "cat_visual_fields")
    return f.select("model_id", "page_id", "pos", "field_no", fx.is_measure_field("field").alias("is_measure"))


@register("P15_visual_label", oracle=oracle_ctes("cat_visuals")
          + f"select model_id, page_id, pos, {visual_label('type')} as label from cat_visuals")
def p15(spark, sf_dir):
    v = _cat(spark, sf_dir, "cat_visuals")
    return v.select("model_id", "page_id", "pos", fx.visual_label("type").alias("label"))


@register("P16_is_technical_card", oracle=oracle_ctes("cat_visual_fields", "cat_visuals") + f"""
, f AS (select model_id, page_id, pos, bool_or({_technical_sql('clean')}) as tech_field
        from (select *, {clean_field('field', 'clean')} from cat_visual_fields) group by model_id, page_id, pos)
select v.model_id, v.page_id, v.pos,
  coalesce(f.tech_field, false) or (coalesce(v.title, '') <> '' and {_technical_sql('v.title')}) as is_technical_card
from cat_visuals v left join f on v.model_id = f.model_id and v.page_id = f.page_id and v.pos = f.pos
""")
def p16(spark, sf_dir):
    """Per visual: any technical field or a technical title; a visual's few fields are one array."""
    f = _cat(spark, sf_dir, "cat_visual_fields")
    v = _cat(spark, sf_dir, "cat_visuals")
    key = ["model_id", "page_id", "pos"]
    fields = f.groupBy(*key).agg(F.collect_list("field").alias("fields"))
    return v.join(fields, key, "left").select(*key, fx.is_technical_card("fields", "title").alias("is_technical_card"))


@register("P12_clean_field_arrays", oracle=_VF + f"""
select model_id, page_id, pos, array_to_string(list(clean order by field_no), '|') as cleaned
from (select model_id, page_id, pos, field_no, {clean_field('field', 'clean')} from cat_visual_fields) group by model_id, page_id, pos
""")
def p12_arrays(spark, sf_dir):
    """The array form of the field cleaner, over all fields of a visual."""
    f = _cat(spark, sf_dir, "cat_visual_fields")
    one = F.transform(F.array_sort(F.collect_list(F.struct("field_no", "field"))), lambda x: fx.clean_field_name(x["field"]))
    return f.groupBy("model_id", "page_id", "pos").agg(F.array_join(one, "|").alias("cleaned"))


# ------------------------------------------------------------------ M code

_P = oracle_ctes("cat_partitions")
_BIN_SQL = " or ".join(f"regexp_matches(expression, {q(p)})" for p in BINARY_PATTERNS)
_HANA_HARD_SQL = "(contains(expression, 'SapHana.Database(\"') or contains(expression, 'SapHana.Database('''))"


@register("P3_is_binary_payload", oracle=_P
          + f"select model_id, ordinal, coalesce({_BIN_SQL}, false) as is_binary from cat_partitions")
def p3(spark, sf_dir):
    p = _cat(spark, sf_dir, "cat_partitions")
    return p.select("model_id", "ordinal", fx.is_binary_payload("expression").alias("is_binary"))


@register("P4_is_hardcoded_connection", oracle=_P
          + f"select model_id, ordinal, coalesce({_HANA_HARD_SQL}, false) as is_hardcoded from cat_partitions")
def p4(spark, sf_dir):
    p = _cat(spark, sf_dir, "cat_partitions")
    return p.select("model_id", "ordinal", fx.is_hardcoded_connection("expression").alias("is_hardcoded"))


_HANA_SQL = f"""
, h AS (select model_id, ordinal, expression,
          list_filter(regexp_extract_all(expression, {q(HANA_NAME_PATTERN)}, 1), lambda x: x <> 'Contents') as names
        from cat_partitions),
hana AS (select model_id, ordinal, expression,
  case when coalesce(expression, '') = '' then '--'
       when contains(expression, '&HanaPackage&') then '(via HanaPackage param)'
       when len(names) >= 2 then names[-2] when len(names) = 1 then names[1] else '--' end as package,
  case when coalesce(expression, '') = '' then '--'
       when contains(expression, '&HanaView&') then '(via HanaView param)'
       when len(names) >= 2 then names[-1] else '--' end as view,
  case when coalesce(expression, '') = '' then '--'
       when {_HANA_HARD_SQL} then 'hardcoded'
       when contains(expression, 'SapHana.Database(HanaServer') then 'via HanaServer param'
       else 'via parameter' end as connection
  from h)
"""


@register("P9_hana_source_info", oracle=_P + _HANA_SQL + "select model_id, ordinal, package, view, connection from hana")
def p9(spark, sf_dir):
    p = _cat(spark, sf_dir, "cat_partitions")
    return p.select("model_id", "ordinal", fx.hana_source_info("expression").alias("h")).select(
        "model_id", "ordinal", "h.package", "h.view", "h.connection")


def _classify_sql(col):
    cat_whens, conn_whens = [], []
    for category, rules in SOURCE_RULES:
        for kw, label in rules:
            cat_whens.append(f"when contains({col}, {q(kw)}) then {q(category)}")
            conn_whens.append(f"when contains({col}, {q(kw)}) then {q(label)}")
    manual = (f"(contains({col}, 'Binary.Decompress') or contains({col}, 'Table.FromRows(Json') "
              f"or (contains({col}, '#table(type table') and contains({col}, 'DateTime.LocalNow')) "
              f"or (length({pystrip(col)}) < 100 and (contains({col}, 'Table.FromRows') or contains({col}, 'Table.RemoveColumns'))))")
    category = f"(case {' '.join(cat_whens)} when {manual} then 'Other' else 'Computed' end)"
    conn = f"(case {' '.join(conn_whens)} when {manual} then 'Manual/Inline Table' else null end)"
    return category, conn


_CAT_SQL, _CONN_SQL = _classify_sql("coalesce(expression, '')")


@register("P10_classify_by_rule_table", oracle=oracle_ctes("cat_measures") + """
, rules AS (select p_partkey as priority, '[Measure ' || cast(p_partkey as varchar) || ']' as keyword, p_brand as category, p_type as connection_type from part
            union all select p_partkey + 1000000000, 'p_size] > ' || cast(p_size as varchar), 'Filter', 'size ' || cast(p_size as varchar) from part),
texts AS (select distinct expression from cat_measures where expression is not null),
hit AS (select expression, priority, category, connection_type,
          row_number() over (partition by expression order by priority, keyword, category, connection_type) as k
        from texts join rules on contains(expression, keyword))
select m.model_id, m.ordinal, coalesce(h.category, 'Computed') as category, h.connection_type
from cat_measures m left join hit h on h.expression = m.expression and h.k = 1""")
def p10_rule_table(spark, sf_dir):
    """As many rules as the table has parts, first match by priority."""
    from fleetcat.operators.rules import classify_by_rules

    part = read_table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    rules = part.select(key.alias("priority"), F.concat(F.lit("[Measure "), key.cast("string"), F.lit("]")).alias("keyword"),
                        F.col("p_brand").alias("category"), F.col("p_type").alias("connection_type"))
    size = F.col("p_size").cast("string")
    rules = rules.union(part.select(key + 1000000000, F.concat(F.lit("p_size] > "), size), F.lit("Filter"), F.concat(F.lit("size "), size)))
    measures = catalog(spark, sf_dir, "cat_measures")["cat_measures"].select("model_id", "ordinal", "expression")
    return classify_by_rules(measures, "expression", rules).select("model_id", "ordinal", "category", "connection_type")


@register("P10_classify_source", oracle=_P
          + f"select model_id, ordinal, {_CAT_SQL} as category, {_CONN_SQL} as connection_type from cat_partitions")
def p10(spark, sf_dir):
    p = _cat(spark, sf_dir, "cat_partitions")
    return p.select("model_id", "ordinal", fx.classify_source("expression").alias("c")).select(
        "model_id", "ordinal", "c.category", "c.connection_type")


@register("P11_classify_parameter", oracle=oracle_ctes("cat_expressions") + f"""
select model_id, ordinal, name,
  case when contains(coalesce(expression, ''), 'meta [IsParameterQuery=true') or starts_with(coalesce(expression, ''), '"') then 'parameter'
       when contains(coalesce(name, ''), '(') or contains(lower(coalesce(expression, '')), 'let') or contains(coalesce(expression, ''), '=>') then 'helper'
       when starts_with({pystrip("coalesce(expression, '')")}, '"') and contains(coalesce(expression, ''), 'meta') then 'parameter'
       else 'helper' end as kind
from cat_expressions
""")
def p11(spark, sf_dir):
    e = _cat(spark, sf_dir, "cat_expressions")
    return e.select("model_id", "ordinal", "name", fx.classify_parameter("name", "expression").alias("kind"))


@register("P19_source_excerpt", oracle=_P + _HANA_SQL + f"""
select model_id, ordinal,
  case when {_CONN_SQL.replace("coalesce(expression, '')", 'expression')} = 'SAP HANA' then 'Package: ' || package || ' / View: ' || view
       when coalesce({_BIN_SQL}, false) then {q(BINARY_MARKER)}
       when length(expression) > 120 then substring({pystrip("string_split(expression, '\\n')[1]")}, 1, 100) || '…'
       else {pystrip('expression')} end as excerpt,
  case when coalesce({_BIN_SQL}, false) then {q(BINARY_MARKER)}
       when length({pystrip('expression')}) > 120 then substring({pystrip('expression')}, 1, 100) || '…'
       else {pystrip('expression')} end as computed_excerpt
from hana
""")
def p19(spark, sf_dir):
    p = _cat(spark, sf_dir, "cat_partitions")
    conn = fx.classify_source("expression")["connection_type"]
    return p.select("model_id", "ordinal", fx.source_excerpt(F.col("expression"), conn).alias("excerpt"),
                    fx.computed_excerpt("expression").alias("computed_excerpt"))


@register("P24_function_calls", oracle=oracle_ctes("cat_measures") + """
, latest AS (select model_id, name, arg_max(expression, ordinal) as e from cat_measures group by model_id, name),
c AS (select model_id, name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(e, ''), '--.*', '', 'g'), '//.*', '', 'g'),
    '"[^"]*"', '""', 'g'), '\\[[^\\]]*\\]', '', 'g') as e from latest),
f AS (select model_id, name, upper(trim(replace(unnest(regexp_extract_all(e, '[[:alpha:]][[:alnum:]_.]*[[:space:]]*\\(')), '(', ''))) as fn from c)
select model_id, name as measure, fn as "function", count(*) as n_calls from f group by all""")
def p24(spark, sf_dir):
    from fleetcat.operators.lineage import function_calls
    return function_calls(_cat(spark, sf_dir, "cat_measures"))


# ------------------------------------------------------------------ text

_KEYS = "|".join(SECRET_KEYS)


def _redact_secrets_sql(col):
    s = col
    for quote in ('"', "'"):
        pat = f"(?i)({_KEYS})\\s*[=:]\\s*{quote}[^\\s'\"&]+{quote}"
        s = f"regexp_replace({s}, {q(pat)}, {q(chr(92) + '1=' + quote + '***' + quote)}, 'g')"
    pat = f"(?i)({_KEYS})\\s*[=:]\\s*[^\\s'\"&]+"
    return f"regexp_replace({s}, {q(pat)}, {q(chr(92) + '1=***')}, 'g')"


@register("P5_redact_secrets", oracle=f"select doc_id, {_redact_secrets_sql('text')} as redacted from documents")
def p5(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", fx.redact_secrets("text").alias("redacted"))


@register("P6_escape_html", oracle=f"select page_id, {escape_html('html')} as escaped from pages")
def p6(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", fx.escape_html("html").alias("escaped"))


def _redact_sensitive_sql(col):
    s = col
    for pat, repl in SENSITIVE_RULES:
        s = f"regexp_replace({s}, {q(pat)}, {q(repl.replace('$1', chr(92) + '1'))}, 'g')"
    return s


@register("P7_redact_sensitive", oracle=f"select doc_id, {_redact_sensitive_sql('text')} as redacted from documents")
def p7(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", fx.redact_sensitive("text").alias("redacted"))


_V = oracle_ctes("cat_visuals", "cat_pages")


@register("P17_fit_label", oracle=oracle_ctes("cat_visuals") + """
, b AS (select *, case when coalesce(title, '') = '' then type else title end as raw, cast(trunc(width / 11) as bigint) as budget
        from cat_visuals)
select model_id, page_id, pos,
  case when budget < 4 then null when length(raw) <= budget then raw else substring(raw, 1, budget - 1) || '…' end as label
from b
""")
def p17(spark, sf_dir):
    v = _cat(spark, sf_dir, "cat_visuals")
    raw = F.when(F.coalesce("title", F.lit("")) == "", F.col("type")).otherwise(F.col("title"))
    return v.select("model_id", "page_id", "pos", fx.fit_label(raw, F.col("width")).alias("label"))


@register("P18_layer_of", oracle=_V + """
select v.model_id, v.page_id, v.pos,
  case when (case when coalesce(p.width, 0) <> 0 and coalesce(p.height, 0) <> 0 then v.width * v.height / (p.width * p.height) else 0 end) > 0.70
       then 'background'
       when lower(v.type) in ('button', 'slicer', 'shape', 'textbox', 'actionbutton') then 'control' else 'data' end as layer
from cat_visuals v join cat_pages p on v.model_id = p.model_id and v.page_id = p.page_id
""")
def p18(spark, sf_dir):
    from fleetcat.operators.usage import visuals_with_page
    cat = catalog(spark, sf_dir, "cat_visuals", "cat_pages")
    vp = visuals_with_page(cat["cat_visuals"], cat["cat_pages"])
    return vp.select("model_id", "page_id", "pos",
                     fx.layer_of("type", "width", "height", "page_width", "page_height").alias("layer"))


@register("P20_model_fingerprint", oracle=oracle_ctes("cat_measures", "cat_columns") + """
, mc AS (select model_id, count(*) as n_measures from cat_measures group by model_id),
tc AS (select model_id, count(distinct table_name) as n_tables from cat_columns group by model_id)
select model_id, n_measures, n_tables,
  substring(sha256('model_' || cast(model_id as varchar) || '_' || cast(n_measures as varchar) || '_' || cast(n_tables as varchar)), 1, 8) as fingerprint
from mc join tc using (model_id)
""")
def p20(spark, sf_dir):
    cat = catalog(spark, sf_dir, "cat_measures", "cat_columns")
    mc = cat["cat_measures"].groupBy("model_id").agg(F.count(F.lit(1)).alias("n_measures"))
    tc = cat["cat_columns"].groupBy("model_id").agg(F.count_distinct("table_name").alias("n_tables"))
    return mc.join(tc, "model_id").select(
        "model_id", "n_measures", "n_tables",
        fx.model_fingerprint(F.concat(F.lit("model_"), F.col("model_id").cast("string")), "n_measures", "n_tables")
        .alias("fingerprint"))


@register("P22_field_reference", oracle=_VF + """
, j AS (select model_id, page_id, pos, field_no, field_json as j from cat_visual_fields),
r AS (select *, {ref} as ref from j)
select model_id, page_id, pos, field_no, ref from r
""".replace("{ref}", field_ref_sql("j")))
def p22(spark, sf_dir):
    f = _cat(spark, sf_dir, "cat_visual_fields")
    return f.select("model_id", "page_id", "pos", "field_no", fx.field_reference("field_json").alias("ref"))


_NESTED = "pos % 5"  # wrappers put round a reference


@register("P22_nested_references", oracle=_VF + f"""
select model_id, page_id, pos, field_no, repeat('Agg(', cast({_NESTED} as integer)) || {field_ref_sql("field_json")}
  || repeat(')', cast({_NESTED} as integer)) as ref
from cat_visual_fields
""")
def p22_nested(spark, sf_dir):
    from fleetcat.sources.layout_variant import field_reference_any
    f = _cat(spark, sf_dir, "cat_visual_fields")
    times = F.expr(f"cast({_NESTED} as int)")
    nested = F.concat(F.repeat(F.lit('{"Aggregation":{"Expression":'), times), F.col("field_json"), F.repeat(F.lit(',"Function":0}}'), times))
    return f.select("model_id", "page_id", "pos", "field_no", field_reference_any(nested).alias("ref"))


@register("P27_format_geometry", oracle=oracle_ctes("cat_visuals") + """
select model_id, page_id, pos, case when coalesce(title, '') = '' then type else title end as label,
  cast(cast(trunc(width) as bigint) as varchar) || '×' || cast(cast(trunc(height) as bigint) as varchar) || ' @ '
  || cast(cast(trunc(x) as bigint) as varchar) || ',' || cast(cast(trunc(y) as bigint) as varchar) as geometry,
  cast(cast(trunc(z) as bigint) as varchar) as z_text
from cat_visuals
""")
def p27(spark, sf_dir):
    v = _cat(spark, sf_dir, "cat_visuals")
    return v.select("model_id", "page_id", "pos",
                    fx.format_geometry("type", "title", "x", "y", "width", "height", "z").alias("g")).select(
        "model_id", "page_id", "pos", "g.label", "g.geometry", "g.z_text")


# ------------------------------------------------------------------ operators over text

@register("P23_description_lookup", oracle=oracle_ctes("cat_measures") + f"""
, d AS (select model_id, ordinal, table_name, name, {pystrip("coalesce(description, '')")} as description from cat_measures),
d2 AS (select * from d where description <> '' and lower(description) <> 'nan'),
k AS (select model_id, ordinal, 1 as variant, lower(coalesce(table_name, 'None') || '[' || name || ']') as key, description from d2
      union all select model_id, ordinal, 2, lower('[' || name || ']'), description from d2
      union all select model_id, ordinal, 3, lower(name), description from d2)
select model_id, key, arg_max(description, ordinal * 4 + variant) as description from k group by model_id, key
""")
def p23(spark, sf_dir):
    return descriptions.description_lookup(_cat(spark, sf_dir, "cat_measures"))


@register("P26_audit_embedded_blocks", oracle="""
, b AS (
  select page_id, 'script' as tag, unnest(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)) as body,
         generate_subscripts(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), 1) as block_no from pages
  union all
  select page_id, 'style', unnest(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1)),
         generate_subscripts(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1), 1) from pages)
select page_id, tag, block_no, length(body) as n_chars,
  contains(body, 'mermaidAPI') as skipped, (contains(body, '{{') or contains(body, '}}')) as double_brace
from b
""".replace("\n, b AS", "WITH b AS", 1))
def p26(spark, sf_dir):
    return segment.audit_embedded_blocks(read_table(spark, sf_dir, "pages"))

