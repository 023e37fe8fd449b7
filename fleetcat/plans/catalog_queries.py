"""Registered catalog queries (Group A) with their DuckDB oracles."""

from __future__ import annotations

from fleetcat.operators import lineage, lint, usage
from fleetcat.plans.registry import register
from fleetcat.plans.sqlbits import case_map, clean_field, escape_html, is_system, pystrip, q, visual_description
from fleetcat.sources.fixtures import catalog, oracle_ctes

# ---------------------------------------------------------------- lineage

_LATEST_SQL = f"""
latest AS (
  select model_id, name, arg_max(expression, ordinal) as expression
  from cat_measures where name is not null and not {is_system('table_name')}
  group by model_id, name),
clean AS (
  select model_id, name,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(expression, ''),
      {q(lineage.BLOCK_COMMENT)}, '', 'g'), '--.*', '', 'g'), '//.*', '', 'g'), {q(lineage.STRING_LITERAL)}, '""', 'g') as e
  from latest),
refs AS (
  select model_id, name as measure,
    list_transform(regexp_extract_all(e, {q(lineage.VAR_DECL)}, 1), lambda x: lower(x)) as vars,
    unnest(regexp_extract_all(e, {q(lineage.REFERENCE)}, 1)) as tbl,
    unnest(regexp_extract_all(e, {q(lineage.REFERENCE)}, 2)) as dep
  from clean),
refs2 AS (select * from refs where not list_contains(vars, lower(dep))),
known_m AS (select distinct model_id, lower(name) as k from latest),
known_c AS (select distinct model_id, lower(column_name) as k from cat_columns where column_name is not null),
edges AS (
  select model_id, measure, 'column' as dep_kind, dep from refs2 where coalesce(tbl, '') <> ''
  union
  select r.model_id, r.measure, case when m.k is not null then 'measure' else 'column' end as dep_kind, r.dep
  from refs2 r left join known_m m on r.model_id = m.model_id and lower(r.dep) = m.k
  left join known_c c on r.model_id = c.model_id and lower(r.dep) = c.k
  where coalesce(r.tbl, '') = '' and (m.k is not null or c.k is not null))
"""


def _lineage_edges(spark, sf_dir):
    cat = catalog(spark, sf_dir, "cat_measures", "cat_columns")
    return lineage.lineage_edges(cat["cat_measures"], cat["cat_columns"])


@register("J3_lineage_edges", oracle=oracle_ctes("cat_measures", "cat_columns") + "," + _LATEST_SQL
          + "select model_id, measure, dep_kind, dep from edges")
def j3_lineage_edges(spark, sf_dir):
    return _lineage_edges(spark, sf_dir)


A9_SQL = (oracle_ctes("cat_measures", "cat_columns") + "," + _LATEST_SQL + """
select model_id, measure,
  coalesce(string_agg(distinct dep, ', ' order by dep) filter (where dep_kind = 'measure'), '--') as depends_on_measures,
  coalesce(string_agg(distinct dep, ', ' order by dep) filter (where dep_kind = 'column'), '--') as depends_on_columns
from edges group by model_id, measure
""")


@register("A9_lineage_summary", oracle=A9_SQL)
def a9_lineage_summary(spark, sf_dir):
    return lineage.lineage_summary(_lineage_edges(spark, sf_dir))


def flagship(spark, sf_dir):
    """The entry query: what does each measure depend on?"""
    return a9_lineage_summary(spark, sf_dir)


@register("A6_graph_nodes", oracle=oracle_ctes("cat_measures", "cat_columns", "cat_relationships") + "," + _LATEST_SQL + f"""
, rel AS (select * from cat_relationships
  where from_table is not null and to_table is not null and from_column is not null and to_column is not null
    and not {is_system('from_table')} and not {is_system('to_table')})
select distinct model_id, 'measure' as node_kind, measure as node from edges
union select model_id, dep_kind, dep from edges
union select model_id, 'table', from_table from rel
union select model_id, 'table', to_table from rel
""")
def a6_graph_nodes(spark, sf_dir):
    from fleetcat.operators.lint import clean_relationships
    cat = catalog(spark, sf_dir, "cat_measures", "cat_columns", "cat_relationships")
    edges = lineage.lineage_edges(cat["cat_measures"], cat["cat_columns"])
    return lineage.graph_nodes(edges, clean_relationships(cat["cat_relationships"]))


# ---------------------------------------------------------------- lint

_CLEAN_REL_SQL = f"""
select model_id, rel_id, from_table, from_column, to_table, to_column,
  case when coalesce(cross_filter, '1') = '2' or contains(lower(coalesce(cross_filter, '1')), 'both')
       then 'Both' else 'Single' end as cross_filter_label
from cat_relationships
where from_table is not null and from_column is not null and to_table is not null and to_column is not null
  and not {is_system('from_table')} and not {is_system('to_table')}
"""


@register("J5_clean_relationships", oracle=oracle_ctes("cat_relationships") + _CLEAN_REL_SQL)
def j5_clean_relationships(spark, sf_dir):
    rels = catalog(spark, sf_dir, "cat_relationships")["cat_relationships"]
    return lint.clean_relationships(rels).select(
        "model_id", "rel_id", "from_table", "from_column", "to_table", "to_column", "cross_filter_label")


_DUP_SQL = f"""
, m AS (select model_id, ordinal, name, {pystrip("coalesce(cast(expression as varchar), 'None')")} as expression
        from cat_measures),
m2 AS (select * from m where length(expression) > {lint.MIN_DUPLICATE_EXPR_CHARS}),
g AS (select model_id, expression, count(*) as n_sharing from m2 group by model_id, expression having count(*) > 1),
dups AS (select m2.model_id, m2.expression, m2.name, m2.ordinal, g.n_sharing from m2 join g using (model_id, expression))
"""


@register("A2_duplicate_expressions", oracle=oracle_ctes("cat_measures") + _DUP_SQL + "select * from dups")
def a2_duplicate_expressions(spark, sf_dir):
    return lint.duplicate_expressions(catalog(spark, sf_dir, "cat_measures")["cat_measures"])


# ---------------------------------------------------------------- usage

_USAGE_SQL = f"""
, um AS (select distinct model_id, name as measure, lower(name) as key from cat_measures
         where name is not null and not {is_system('table_name')}),
vf AS (select v.*, {clean_field('v.field', 'clean')} from cat_visuals v),
uv AS (select distinct vf.model_id, p.page_name, {visual_description('vf.type', 'vf.title')} as visual, lower(vf.clean) as key
       from vf join cat_pages p on vf.model_id = p.model_id and vf.page_id = p.page_id),
usage AS (select distinct um.model_id, um.measure, uv.page_name, uv.visual from um join uv using (model_id, key))
"""
_USAGE_CTES = oracle_ctes("cat_measures", "cat_visuals", "cat_pages") + _USAGE_SQL


def _usage(spark, sf_dir):
    cat = catalog(spark, sf_dir, "cat_measures", "cat_visuals", "cat_pages")
    return usage.measure_usage(cat["cat_measures"], cat["cat_visuals"], cat["cat_pages"])


@register("J1_measure_usage", oracle=_USAGE_CTES + "select * from usage")
def j1_measure_usage(spark, sf_dir):
    return _usage(spark, sf_dir)


@register("A11_usage_counts", oracle=_USAGE_CTES
          + "select model_id, measure, count(*) as n_visuals from usage group by model_id, measure")
def a11_usage_counts(spark, sf_dir):
    return usage.usage_counts(_usage(spark, sf_dir))


@register("L2_sorted_usage", oracle=_USAGE_CTES + "select * from usage order by model_id, measure, page_name, visual")
def l2_sorted_usage(spark, sf_dir):
    return usage.sorted_usage(_usage(spark, sf_dir))


@register("J6_visuals_with_page", oracle=oracle_ctes("cat_visuals", "cat_pages") + """
select v.model_id, v.page_id, v.pos, v.type, p.page_name, p.hidden as page_hidden
from cat_visuals v join cat_pages p on v.model_id = p.model_id and v.page_id = p.page_id
""")
def j6_visuals_with_page(spark, sf_dir):
    cat = catalog(spark, sf_dir, "cat_visuals", "cat_pages")
    return usage.visuals_with_page(cat["cat_visuals"], cat["cat_pages"]).select(
        "model_id", "page_id", "pos", "type", "page_name", "page_hidden")


_UNUSED_SQL = """
, un_names AS (select distinct model_id, cast(name as varchar) as name, lower(name) as key from cat_measures
               where name is not null and model_id in (select model_id from cat_visuals)),
un_fields AS (select distinct model_id, lower(field) as f from cat_visuals where field is not null),
unused AS (select model_id, name from un_names n
           where not exists (select 1 from un_fields f where f.model_id = n.model_id and contains(f.f, n.key))),
n_all AS (select model_id, count(distinct name) as n_all from cat_measures where name is not null group by model_id),
n_un AS (select model_id, count(*) as n_unused from unused group by model_id),
unused_report AS (select u.model_id, u.name from unused u join n_un using (model_id) join n_all using (model_id)
                  where n_un.n_unused < n_all.n_all)
"""
_UNUSED_CTES = oracle_ctes("cat_measures", "cat_visuals") + _UNUSED_SQL


def _measures_visuals(spark, sf_dir):
    cat = catalog(spark, sf_dir, "cat_measures", "cat_visuals")
    return cat["cat_measures"], cat["cat_visuals"]


@register("U3_unused_measures", oracle=_UNUSED_CTES + "select * from unused")
def u3_unused_measures(spark, sf_dir):
    return usage.unused_measures(*_measures_visuals(spark, sf_dir))


@register("J2_unused_report", oracle=_UNUSED_CTES + "select * from unused_report")
def j2_unused_report(spark, sf_dir):
    return usage.unused_report(*_measures_visuals(spark, sf_dir))


@register("L1_unused_top10", oracle=_UNUSED_CTES + f"""
select model_id, count(*) as n_unused,
  array_to_string(list_slice(list_sort(list(name)), 1, {usage.UNUSED_LISTED}), ', ')
  || case when count(*) > {usage.UNUSED_LISTED}
          then ' … and ' || cast(count(*) - {usage.UNUSED_LISTED} as varchar) || ' more' else '' end
  as unused_text
from unused_report group by model_id
""")
def l1_unused_top10(spark, sf_dir):
    return usage.unused_top10(usage.unused_report(*_measures_visuals(spark, sf_dir)))


def _well_sql():
    from fleetcat.functions.names import _WELL_ALT, WELL_LABELS
    well = f"coalesce(nullif(coalesce(regexp_extract(field, '^({_WELL_ALT}): ', 1), ''), ''), 'Values')"
    return well, case_map("well", WELL_LABELS)


_WELL, _WELL_LABEL = _well_sql()


@register("A4_fields_by_well", oracle=oracle_ctes("cat_visual_fields") + f"""
, f AS (select model_id, page_id, pos, type, field_no, {_WELL} as well, {clean_field('field', 'clean')},
          (contains(field, 'Agg(') or contains(field, 'Measure')) as is_m from cat_visual_fields),
d AS (select *, case when is_m then '<i>' || {escape_html('clean')} || '</i>' else {escape_html('clean')} end as display
      from f),
lab AS (select *, {_WELL_LABEL} as wl from d)
select model_id, page_id, pos, well,
  case when type in ('card', 'multiRowCard') and wl in ('X-axis', 'Value') then 'Value' else wl end as well_label,
  min(field_no) as well_order, string_agg(display, ', ' order by field_no) as fields
from lab group by model_id, page_id, pos, type, well, wl
""")
def a4_fields_by_well(spark, sf_dir):
    return usage.fields_by_well(catalog(spark, sf_dir, "cat_visual_fields")["cat_visual_fields"])


# ---------------------------------------------------------------- observations (A3)

_HANA_SQL = "contains(expression, 'SapHana.Database(\"') or contains(expression, 'SapHana.Database(''')"


@register("A3_observation_items", oracle=oracle_ctes("cat_measures", "cat_visuals", "cat_partitions") + _DUP_SQL + _UNUSED_SQL + f"""
select model_id, 'Hardcoded Connections' as title, table_name as item from cat_partitions where {_HANA_SQL}
union all select model_id, 'Duplicate DAX Logic', name from dups
union all select model_id, 'Unused Measures', name from unused_report""")
def a3_items(spark, sf_dir):
    cat = catalog(spark, sf_dir, "cat_measures", "cat_visuals", "cat_partitions")
    report = usage.unused_report(cat["cat_measures"], cat["cat_visuals"])
    return lint.observation_items(cat["cat_partitions"], cat["cat_measures"], report)


@register("A3_threshold_observations", oracle=oracle_ctes(
        "cat_measures", "cat_visuals", "cat_partitions", "cat_relationships", "cat_columns")
        + _DUP_SQL + _UNUSED_SQL + f"""
select model_id, 'warning' as severity, 'Hardcoded Connections' as title, count(*) as n from cat_partitions
  where {_HANA_SQL} group by model_id
union all
select model_id, 'important', 'Bidirectional Relationships', n from (
  select model_id, count(*) filter (where coalesce(cross_filter, '1') = '2'
                                    or contains(lower(coalesce(cross_filter, '1')), 'both')) as n
  from cat_relationships group by model_id) where n > {lint.BIDIRECTIONAL_LIMIT}
union all
select model_id, 'note', 'Measure Count', count(*) from cat_measures group by model_id having count(*) > {lint.MEASURE_LIMIT}
union all
select model_id, 'tip', 'Calculated Columns', n from (
  select model_id, count(*) filter (where is_calculated) as n from cat_columns group by model_id)
  where n > {lint.CALC_COLUMN_LIMIT}
union all
select model_id, 'tip', 'Duplicate DAX Logic', count(distinct expression) from dups group by model_id
union all
select model_id, 'note', 'Unused Measures', count(*) from unused_report group by model_id
""")
def a3_threshold_observations(spark, sf_dir):
    cat = catalog(spark, sf_dir, "cat_measures", "cat_visuals", "cat_partitions", "cat_relationships", "cat_columns")
    report = usage.unused_report(cat["cat_measures"], cat["cat_visuals"])
    return lint.threshold_observations(cat["cat_partitions"], cat["cat_relationships"], cat["cat_measures"],
                                       cat["cat_columns"], report)
