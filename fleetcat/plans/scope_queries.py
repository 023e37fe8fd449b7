"""Registered scope, universe, source-section and export queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcat.operators import scope, segment
from fleetcat.plans.registry import register
from fleetcat.plans.scalar_queries import _classify_sql, _redact_sensitive_sql
from fleetcat.plans.sqlbits import is_system, pystrip, q
from fleetcat.session import read_table
from fleetcat.sources import definitions as defs
from fleetcat.sources.fixtures import catalog, oracle_ctes

_LP = """
, lp AS (select model_id, table_name, arg_max(expression, ordinal) as expression, arg_max(is_calculated, ordinal) as is_calculated
         from cat_partitions where table_name is not null group by model_id, table_name),
ct AS (select distinct model_id, table_name from cat_partitions where is_calculated and table_name is not null),
mt AS (select lp.model_id, lp.table_name, lp.expression from lp
       where not exists (select 1 from ct where ct.model_id = lp.model_id and ct.table_name = lp.table_name))
"""
_P = oracle_ctes("cat_partitions") + _LP


def _cat(spark, sf_dir, *names):
    return catalog(spark, sf_dir, *names)


@register("A8_latest_partition", oracle=_P + "select model_id, table_name, expression, is_calculated from lp")
def a8(spark, sf_dir):
    return scope.latest_partition(_cat(spark, sf_dir, "cat_partitions")["cat_partitions"])


@register("J4_exclude_calculated_tables", oracle=_P + "select * from mt")
def j4(spark, sf_dir):
    return scope.exclude_calculated_tables(_cat(spark, sf_dir, "cat_partitions")["cat_partitions"])


_UNIVERSE = """
, universe AS (select distinct model_id, table_name from (
    select model_id, table_name from cat_measures union all select model_id, table_name from cat_columns
    union all select model_id, table_name from cat_partitions) where table_name is not null)
"""


@register("A7_table_universe", oracle=oracle_ctes("cat_measures", "cat_columns", "cat_partitions") + _UNIVERSE
          + "select * from universe")
def a7_tables(spark, sf_dir):
    c = _cat(spark, sf_dir, "cat_measures", "cat_columns", "cat_partitions")
    return scope.table_universe(c["cat_measures"], c["cat_columns"], c["cat_partitions"])


@register("A7_column_universe", oracle=oracle_ctes("cat_columns")
          + "select distinct model_id, column_name from cat_columns where column_name is not null")
def a7_columns(spark, sf_dir):
    return scope.column_universe(_cat(spark, sf_dir, "cat_columns")["cat_columns"])


@register("J12_calculated_columns_with_table", oracle=oracle_ctes("cat_columns")
          + "select model_id, table_name, column_name, expression from cat_columns where is_calculated")
def j12(spark, sf_dir):
    return scope.calculated_columns_with_table(_cat(spark, sf_dir, "cat_columns")["cat_columns"])


_KIND_SQL = f"""(case when contains(coalesce(expression, ''), 'meta [IsParameterQuery=true') or starts_with(coalesce(expression, ''), '"') then 'parameter'
       when contains(coalesce(name, ''), '(') or contains(lower(coalesce(expression, '')), 'let') or contains(coalesce(expression, ''), '=>') then 'helper'
       when starts_with({pystrip("coalesce(expression, '')")}, '"') and contains(coalesce(expression, ''), 'meta') then 'parameter'
       else 'helper' end)"""


@register("U1_all_parameters", oracle=oracle_ctes("cat_expressions")
          + f"""select model_id, name, {_KIND_SQL} as kind, expression,
  case when {_KIND_SQL} = 'parameter' then substring(coalesce(cast(expression as varchar), ''), 1, 150)
       when coalesce(description, '') <> '' then description else 'Custom M function' end as display
from cat_expressions""")
def u1(spark, sf_dir):
    return scope.all_parameters(_cat(spark, sf_dir, "cat_expressions")["cat_expressions"])


_CAT_SQL, _CONN_SQL = _classify_sql("coalesce(expression, '')")
_BIN_SQL = ("(regexp_matches(expression, '(?s)Binary\\.Decompress\\(.*?Binary\\.FromText\\(') or "
            "regexp_matches(expression, '(?s)Table\\.FromRows\\(\\s*Json\\.Document\\(\\s*Binary\\.Decompress\\('))")
_SYS = is_system("table_name")
_CLASSIFIED = f"""
, cls AS (select model_id, table_name, expression, {_CAT_SQL} as category from mt where not {_SYS}),
dax AS (select model_id, table_name, arg_max(expression, ordinal) as expression from cat_partitions
        where is_calculated and table_name is not null group by model_id, table_name)
"""


@register("U2_computed_tables", oracle=_P + _CLASSIFIED + f"""
, u AS (select model_id, table_name, expression, 'M (Power Query)' as table_type from cls where category = 'Computed'
        union all select model_id, table_name, expression, 'DAX Calculated Table' from dax where not {_SYS})
select model_id, table_name, table_type,
  case when coalesce({_BIN_SQL}, false) then '[binary payload - inline table]'
       when length({pystrip('expression')}) > 120 then substring({pystrip('expression')}, 1, 100) || '…'
       else {pystrip('expression')} end as excerpt
from u""")
def u2(spark, sf_dir):
    return scope.computed_tables(_cat(spark, sf_dir, "cat_partitions")["cat_partitions"])


@register("W3_source_sections", oracle=oracle_ctes("cat_partitions", "cat_expressions") + _LP + _CLASSIFIED + f"""
, s AS (select model_id, case when category = 'Computed' then 'Computed Tables' else category end as section from cls
        union all select model_id, 'Computed Tables' from dax where not {_SYS}
        union all select model_id, case when {_KIND_SQL} = 'parameter' then 'Parameters' else 'Helper Functions' end from cat_expressions),
c AS (select model_id, section, count(*) as n_items from s group by model_id, section)
select model_id, section, n_items,
  cast(dense_rank() over (partition by model_id order by list_position({list(scope.SOURCE_SECTIONS)}, section)) as integer) as section_no
from c""")
def w3(spark, sf_dir):
    c = _cat(spark, sf_dir, "cat_partitions", "cat_expressions")
    return scope.source_sections(c["cat_partitions"], c["cat_expressions"])


@register("A5_measures_by_table", oracle=oracle_ctes("cat_measures") + f"""
, m AS (select * from cat_measures where not {_SYS}),
t AS (select model_id, table_name, cast(dense_rank() over (partition by model_id order by table_name) as bigint) as section_no
      from (select distinct model_id, table_name from m))
select m.model_id, m.table_name, t.section_no, m.name,
  cast(row_number() over (partition by m.model_id, m.table_name order by m.name, m.ordinal) as integer) as item_no
from m join t on m.model_id = t.model_id and m.table_name = t.table_name""")
def a5(spark, sf_dir):
    return scope.items_by_table(_cat(spark, sf_dir, "cat_measures")["cat_measures"], "name")


@register("A5_columns_by_table", oracle=oracle_ctes("cat_columns") + f"""
, c AS (select * from cat_columns where not {_SYS})
select model_id, table_name, cast(dense_rank() over (partition by model_id order by table_name) as bigint) as section_no, column_name as name,
  cast(row_number() over (partition by model_id, table_name order by ordinal) as integer) as item_no from c""")
def a5_columns(spark, sf_dir):
    return scope.columns_by_table(_cat(spark, sf_dir, "cat_columns")["cat_columns"])


@register("A1_model_summary", oracle=oracle_ctes(
        "cat_measures", "cat_columns", "cat_partitions", "cat_relationships", "cat_expressions", "cat_pages", "cat_visuals")
        + _UNIVERSE + f"""
, a AS (select model_id, count(*) as n_tables from universe group by model_id),
b AS (select model_id, count(*) as n_columns, count(*) filter (where is_calculated) as n_calculated_columns from cat_columns group by model_id),
c AS (select model_id, count(*) as n_measures from cat_measures group by model_id),
d AS (select model_id, count(*) as n_relationships from cat_relationships group by model_id),
e AS (select model_id, count(*) filter (where {_KIND_SQL} = 'parameter') as n_parameters,
        count(*) filter (where {_KIND_SQL} = 'helper') as n_functions from cat_expressions group by model_id),
f AS (select model_id, count(*) as n_queries from cat_partitions group by model_id),
g AS (select model_id, count(*) as n_pages from cat_pages group by model_id),
h AS (select model_id, count(*) as n_visuals from cat_visuals group by model_id),
ids AS (select model_id from a union select model_id from b union select model_id from c union select model_id from d
        union select model_id from e union select model_id from f union select model_id from g union select model_id from h)
select ids.model_id, coalesce(n_tables, 0) as n_tables, coalesce(n_columns, 0) as n_columns,
  coalesce(n_calculated_columns, 0) as n_calculated_columns, coalesce(n_measures, 0) as n_measures,
  coalesce(n_relationships, 0) as n_relationships, coalesce(n_parameters, 0) as n_parameters,
  coalesce(n_functions, 0) as n_functions, coalesce(n_queries, 0) as n_queries, coalesce(n_pages, 0) as n_pages,
  coalesce(n_visuals, 0) as n_visuals
from ids left join a using (model_id) left join b using (model_id) left join c using (model_id) left join d using (model_id)
  left join e using (model_id) left join f using (model_id) left join g using (model_id) left join h using (model_id)""")
def a1(spark, sf_dir):
    c = _cat(spark, sf_dir, "cat_measures", "cat_columns", "cat_partitions", "cat_relationships", "cat_expressions",
             "cat_pages", "cat_visuals")
    tables = scope.table_universe(c["cat_measures"], c["cat_columns"], c["cat_partitions"])
    return scope.model_summary(tables, c["cat_columns"], c["cat_measures"], c["cat_relationships"], c["cat_expressions"],
                               c["cat_partitions"], c["cat_pages"], c["cat_visuals"])


_SCOPE = _UNIVERSE + """
, facts AS (select distinct model_id, t as table_name from (
    select model_id, to_table as t from cat_relationships where lower(to_cardinality) = 'many'
    union all select model_id, from_table from cat_relationships where lower(from_cardinality) = 'many') where t is not null),
hop AS (select r.model_id, r.to_table as table_name from cat_relationships r
          where exists (select 1 from facts f where f.model_id = r.model_id and f.table_name = r.from_table)
        union all select r.model_id, r.from_table from cat_relationships r
          where exists (select 1 from facts f where f.model_id = r.model_id and f.table_name = r.to_table)),
scope AS (select distinct model_id, table_name from (
    select * from facts union all select * from hop where table_name is not null
    union all select * from universe u where u.model_id not in (select model_id from facts)))
, rin AS (select r.* from cat_relationships r
  where exists (select 1 from scope s where s.model_id = r.model_id and s.table_name = r.from_table)
    and exists (select 1 from scope s where s.model_id = r.model_id and s.table_name = r.to_table))
"""
_SCOPE_CTES = oracle_ctes("cat_measures", "cat_columns", "cat_partitions", "cat_relationships") + _SCOPE


def _scope(spark, sf_dir):
    c = _cat(spark, sf_dir, "cat_measures", "cat_columns", "cat_partitions", "cat_relationships")
    universe = scope.table_universe(c["cat_measures"], c["cat_columns"], c["cat_partitions"])
    return c, scope.fact_scope(c["cat_relationships"], universe)


@register("J9_fact_scope", oracle=_SCOPE_CTES + "select * from scope")
def j9(spark, sf_dir):
    return _scope(spark, sf_dir)[1]


@register("J10_relationships_in_scope", oracle=_SCOPE_CTES + "select model_id, rel_id, from_table, to_table from rin")
def j10(spark, sf_dir):
    c, s = _scope(spark, sf_dir)
    return scope.relationships_in_scope(c["cat_relationships"], s).select("model_id", "rel_id", "from_table", "to_table")


@register("J11_enrich_definitions", oracle=oracle_ctes("cat_definitions", "cat_measures", "cat_columns") + f"""
, found AS (select model_id, ordinal, regexp_extract(payload, '(?s)\\[\\s*\\{{.*?\\}}\\s*\\]') as p from cat_definitions),
good AS (select * from found where p <> '' and json_valid(p)),
items AS (select model_id, ordinal, unnest(from_json(p,
    '[{{"schema_version":"VARCHAR","object_type":"VARCHAR","table":"VARCHAR","object_name":"VARCHAR"}}]')) as it
  from good),
ok AS (select model_id, ordinal, lower(it.object_type) as t, lower(it.object_name) as n, lower(it."table") as tb
       from items where it.schema_version = '1'),
obj AS (select model_id, 'measure' as t, lower(name) as n, lower(table_name) as otb from cat_measures where not {_SYS}
        union all select model_id, 'column', lower(column_name), lower(table_name) from cat_columns
        where is_calculated and not {_SYS}),
m AS (select ok.model_id, ok.ordinal, count(*) as n_matched from ok join obj on ok.model_id = obj.model_id and ok.t = obj.t and ok.n = obj.n
      where ok.tb is null or ok.tb = '' or ok.tb = obj.otb group by ok.model_id, ok.ordinal),
per AS (select f.model_id, f.ordinal, case when g.p is null then 'unreadable' else 'ok' end as status,
  coalesce(json_array_length(g.p), 0) as n_items from found f left join good g on f.model_id = g.model_id and f.ordinal = g.ordinal)
select per.model_id, per.ordinal, per.status, cast(per.n_items as integer) as n_items, coalesce(m.n_matched, 0) as n_matched,
  greatest(cast(per.n_items as bigint) - coalesce(m.n_matched, 0), 0) as n_skipped
from per left join m on per.model_id = m.model_id and per.ordinal = m.ordinal""")
def j11(spark, sf_dir):
    c = _cat(spark, sf_dir, "cat_definitions", "cat_measures", "cat_columns")
    return scope.enrich_definitions(c["cat_definitions"], scope.catalog_objects(c["cat_measures"], c["cat_columns"]))


SEARCH_QUERY = "12"


@register("J13_catalog_search", oracle=oracle_ctes("cat_measures") + f"""
, m AS (select model_id, table_name, name from cat_measures where not {_SYS}),
hits AS (select model_id, 'measure' as kind, table_name, name from m where contains(lower(name), {q(SEARCH_QUERY)})),
t AS (select distinct model_id, table_name from m),
th AS (select * from t where contains(lower(table_name), {q(SEARCH_QUERY)})
       union select t.* from t where exists (select 1 from hits h where h.model_id = t.model_id and h.table_name = t.table_name))
select * from hits union all select model_id, 'table', table_name, cast(null as varchar) from th""")
def j13(spark, sf_dir):
    return scope.catalog_search(_cat(spark, sf_dir, "cat_measures")["cat_measures"], SEARCH_QUERY)


_ENTRIES_SQL = _LP + _CLASSIFIED + f"""
, sec AS (select model_id, case when category = 'Computed' then 'Computed Tables' else category end as section from cls
        union select model_id, 'Computed Tables' from dax where not {_SYS}
        union select model_id, case when {_KIND_SQL} = 'parameter' then 'Parameters' else 'Helper Functions' end from cat_expressions),
leaf AS (select model_id, ['Data Sources', section] as path from sec
  union all select model_id, ['Power Query Transformations', table_name] from cat_partitions where not {_SYS}
  union all select model_id, ['DAX Measures', table_name, name] from cat_measures where not {_SYS}
  union all select model_id, ['DAX Calculated Columns', table_name, column_name] from cat_columns where is_calculated and not {_SYS}
  union all select model_id, ['Report Pages', page_name] from cat_pages
  union all select case when p_partkey % 10 < 3 then 0 else 1 + cast(floor(p_partkey / 50) as bigint) end,
    ['Calculation Groups', 'Calc Group ' || cast(cast(floor(p_partkey / 50) as bigint) as varchar), 'Item ' || cast(p_partkey as varchar)] from part),
entries AS (select distinct model_id, path[1:n] as path, path[n] as label from (select model_id, path, unnest(range(1, len(path) + 1)) as n from leaf)),
queries AS (select distinct query from (
  select substring(p_type, 1, 1 + p_partkey % 9) as query from part union all select upper(substring(s_name, 9, 10)) from supplier
  union all select ' age ' || cast(c_custkey % 90 as varchar) || ' ' from customer union all select 'm ' || cast(p_partkey % 97 as varchar) from part)),
labels AS (select distinct label from entries),
found AS (select query, label from queries, labels where contains(lower(label), trim(lower(query)))),
hits AS (select query, model_id, path from found join entries using (label))
select query, model_id, array_to_string(path, ' / ') as path, path[len(path)] as label, bool_or(own) as is_match
from (select query, model_id, path[1:n] as path, n = len(path) as own from (select *, unnest(range(1, len(path) + 1)) as n from hits))
group by query, model_id, path"""


@register("J13_search_whole_catalog", oracle=oracle_ctes("cat_measures", "cat_columns", "cat_partitions", "cat_expressions", "cat_pages") + _ENTRIES_SQL)
def j13_whole(spark, sf_dir):
    """Many queries in one join over an n-gram posting table of all navigation entries."""
    from fleetcat.operators import search
    from fleetcat.sources.sink import shared_path

    c = _cat(spark, sf_dir, "cat_measures", "cat_columns", "cat_partitions", "cat_expressions", "cat_pages")
    part, supplier, customer = (read_table(spark, sf_dir, t) for t in ("part", "supplier", "customer"))
    lines = segment.lines_of(defs.calc_group_files(part), ["model_id", "file"])
    items = segment.calculation_items(segment.table_blocks(lines, ["model_id", "file"]), ["model_id", "file"])
    items = items.select("model_id", F.col("file").alias("group"), F.col("item_name").alias("name"))
    entries = search.catalog_entries(*(c[f"cat_{t}"] for t in ("measures", "columns", "partitions", "expressions", "pages")), items)
    index = search.build_index(entries, shared_path(spark, "search-index"))
    queries = part.select(F.substring("p_type", F.lit(1), 1 + F.col("p_partkey") % 9).alias("query")) \
        .union(supplier.select(F.upper(F.substring("s_name", 9, 10)))) \
        .union(customer.select(F.concat(F.lit(" age "), (F.col("c_custkey") % 90).cast("string"), F.lit(" ")))) \
        .union(part.select(F.concat(F.lit("m "), (F.col("p_partkey") % 97).cast("string"))))
    return search.search(index, queries).withColumn("path", F.array_join("path", " / "))


@register("W4_ordered_items", oracle="""
select case when p_partkey % 10 < 3 then 0 else 1 + cast(floor(p_partkey / 50) as bigint) end as model_id, 'Calc Group ' || cast(cast(floor(p_partkey / 50) as bigint) as varchar) as file, 'Item ' || cast(p_partkey as varchar) as item_name, ordinal,
  cast(row_number() over (partition by case when p_partkey % 10 < 3 then 0 else 1 + cast(floor(p_partkey / 50) as bigint) end, cast(floor(p_partkey / 50) as bigint) order by ordinal, p_partkey) as integer) as position
from (select *, case when p_partkey % 4 = 0 or p_partkey % 17 = 0 then 0 else cast((p_partkey * 7) % 13 as integer) end as ordinal
      from part)
order by model_id, file, position""")
def w4(spark, sf_dir):
    lines = segment.lines_of(defs.calc_group_files(read_table(spark, sf_dir, "part")), ["model_id", "file"])
    items = segment.calculation_items(segment.table_blocks(lines, ["model_id", "file"]), ["model_id", "file"])
    return (items.select("model_id", "file", "item_name", "ordinal", F.col("item_rank").alias("position"))
            .orderBy("model_id", "file", "position"))


_T2 = "\t\t"


@register("A10_definition_export", oracle=_SCOPE_CTES + _LP + f"""
, blocks AS (
  select model_id, 0 as part, '' as table_name, 0 as section, cast(0 as bigint) as block,
    [{q(scope.EXPORT_PREAMBLE[0])}, {q(scope.EXPORT_PREAMBLE[1])}] as lines from (select distinct model_id from scope)
  union all select model_id, 1, table_name, 0, cast(0 as bigint), ['table ''' || table_name || ''''] from scope
  union all select lp.model_id, 1, lp.table_name, 1, cast(0 as bigint),
    ['\tpartition ''' || lp.table_name || '-Partition'' = m', '\t\tmode: import',
     '\t\tsource = ' || chr(10) || '```' || chr(10)
       || {_redact_sensitive_sql("(case when lp.is_calculated then '' else lp.expression end)")} || chr(10) || '```' || chr(10)]
    from lp where exists (select 1 from scope s where s.model_id = lp.model_id and s.table_name = lp.table_name)
  union all select c.model_id, 1, c.table_name, 2,
    cast(dense_rank() over (partition by c.model_id, c.table_name order by c.column_name) as bigint),
    list_concat(['\tcolumn ''' || c.column_name || '''', '\t\tdataType: ' || coalesce(c.data_type, 'unknown')],
      case when coalesce(c.expression, '') <> ''
           then ['\t\texpression = ' || chr(10) || '\t\t\t```' || chr(10) || '\t\t\t' || c.expression || chr(10) || '\t\t\t```']
           else [] end, [''])
    from cat_columns c where c.is_calculated and exists (select 1 from scope s where s.model_id = c.model_id and s.table_name = c.table_name)
  union all select m.model_id, 1, m.table_name, 3, cast(m.ordinal as bigint),
    list_concat(['\tmeasure ''' || m.name || ''' = ' || chr(10) || '\t\t```' || chr(10) || '\t\t' || coalesce(m.expression, '')
                 || chr(10) || '\t\t```'],
      case when m.display_folder <> '' then ['\t\tdisplayFolder: ' || m.display_folder] else [] end,
      case when coalesce(m.format_string, '') <> '' then ['\t\tformatString: ' || m.format_string] else [] end,
      case when m.is_hidden then ['\t\tisHidden'] else [] end, [''])
    from cat_measures m where exists (select 1 from scope s where s.model_id = m.model_id and s.table_name = m.table_name)
  union all select model_id, 2, '', 0, cast(rel_id as bigint),
    ['relationship ''' || from_table || '_' || to_table || '''',
     '\tfromColumn: ''' || from_table || '''.''' || coalesce(cast(from_column as varchar), 'None') || '''',
     '\ttoColumn: ''' || to_table || '''.''' || coalesce(cast(to_column as varchar), 'None') || '''',
     '\tisActive: ' || is_active::varchar, '\tcrossFilteringBehavior: ' || coalesce(cross_filter, 'both'), '']
    from rin)
select model_id, part, table_name, section, block, cast(generate_subscripts(lines, 1) - 1 as integer) as seq, unnest(lines) as line
from blocks""")
def a10(spark, sf_dir):
    c, s = _scope(spark, sf_dir)
    return scope.definition_export(s, c["cat_partitions"], c["cat_columns"], c["cat_measures"], c["cat_relationships"])
