"""Model scope, universes, sources and export.

Everything is keyed by model_id; unions, semi/anti joins and grouped counts
only.  The export (A10) is produced as ordered line rows per model rather
than one collected string, so no model's text is ever gathered in one group;
the sink writes each model's lines in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetcat.operators.common import row_number_within
from fleetcat.session import cut_lineage
from fleetcat.functions import (
    classify_parameter, classify_source, computed_excerpt, is_system_table, parameter_excerpt, redact_sensitive,
)

# Fixed values that must equal the reference's rules.
SOURCE_SECTIONS = ("File", "Database", "Power Platform", "Azure", "Online Services", "Other",
                   "Computed Tables", "Parameters", "Helper Functions")
EXPORT_PREAMBLE = (
    "// The model is represented in Tabular Model Definition Language (TMDL)-style format.",
    "// Pay close attention to indentation, which strictly denotes parent-child hierarchy.\n",
)
M_TABLE_TYPE = "M (Power Query)"
DAX_TABLE_TYPE = "DAX Calculated Table"


# ------------------------------------------------------------------ universes and latest rows

def latest_partition(partitions: DataFrame) -> DataFrame:
    """One expression per (model, table); the last partition row wins."""
    return (partitions.where(F.col("table_name").isNotNull())
            .groupBy("model_id", "table_name")
            .agg(F.max_by("expression", "ordinal").alias("expression"),
                 F.max_by("is_calculated", "ordinal").alias("is_calculated")))


def calculated_tables(partitions: DataFrame) -> DataFrame:
    """Calculated (DAX) tables: partitions flagged calculated; one expression per table."""
    return latest_partition(partitions.where(F.col("is_calculated"))).select("model_id", "table_name", "expression")


def exclude_calculated_tables(partitions: DataFrame) -> DataFrame:
    """M tables (one expression each) that are not calculated tables (anti join on the name)."""
    return latest_partition(partitions).join(calculated_tables(partitions).select("model_id", "table_name"),
                                             ["model_id", "table_name"], "left_anti").select(
        "model_id", "table_name", "expression")


def table_universe(measures: DataFrame, columns: DataFrame, partitions: DataFrame) -> DataFrame:
    """Distinct table names over the model's tables: partitions (M and calculated), columns and measures."""
    parts = [measures.select("model_id", "table_name"), columns.select("model_id", "table_name"),
             partitions.select("model_id", "table_name")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("table_name").isNotNull()).distinct()


def column_universe(columns: DataFrame) -> DataFrame:
    """Distinct column names (schema columns and calculated columns)."""
    return columns.where(F.col("column_name").isNotNull()).select("model_id", "column_name").distinct()


def calculated_columns_with_table(columns: DataFrame) -> DataFrame:
    """Calculated columns with their owning table carried along (no lookup join)."""
    return columns.where(F.col("is_calculated")).select("model_id", "table_name", "column_name", "expression")


# ------------------------------------------------------------------ data sources (P10 applied, U1, U2, W3)

def classified_sources(partitions: DataFrame, include_system_tables: bool = False) -> DataFrame:
    """M tables with (category, connection_type); calculated and (by default) system tables removed."""
    t = exclude_calculated_tables(partitions)
    if not include_system_tables:
        t = t.where(~is_system_table("table_name"))
    c = classify_source(F.col("expression"))
    return t.select("model_id", "table_name", "expression", c["category"].alias("category"),
                    c["connection_type"].alias("connection_type"))


def computed_tables(partitions: DataFrame, include_system_tables: bool = False) -> DataFrame:
    """Unclassified M tables and calculated tables, with type and excerpt."""
    m = (classified_sources(partitions, include_system_tables).where(F.col("category") == "Computed")
         .select("model_id", "table_name", "expression", F.lit(M_TABLE_TYPE).alias("table_type")))
    d = calculated_tables(partitions)
    if not include_system_tables:
        d = d.where(~is_system_table("table_name"))
    d = d.select("model_id", "table_name", "expression", F.lit(DAX_TABLE_TYPE).alias("table_type"))
    return m.unionByName(d).select("model_id", "table_name", "table_type", computed_excerpt(F.col("expression")).alias("excerpt"))


HELPER_FALLBACK = "Custom M function"


def all_parameters(expressions: DataFrame) -> DataFrame:
    """Parameters and helper functions together, each tagged by the ordered rules.

    ``display`` is what the sources section shows: a parameter's first 150
    characters (P19), a helper's description or a fixed fallback.
    """
    kind = classify_parameter(F.col("name"), F.col("expression"))
    desc = F.coalesce(F.col("description").cast("string"), F.lit("")) if "description" in expressions.columns else F.lit("")
    params = expressions.where(kind == "parameter").select(
        "model_id", "name", F.lit("parameter").alias("kind"), "expression", parameter_excerpt("expression").alias("display"))
    helpers = expressions.where(kind == "helper").select(
        "model_id", "name", F.lit("helper").alias("kind"), "expression",
        F.when(desc != "", desc).otherwise(F.lit(HELPER_FALLBACK)).alias("display"))
    return params.unionByName(helpers)


def source_sections(partitions: DataFrame, expressions: DataFrame) -> DataFrame:
    """Data-source sections per model, numbered consecutively over the non-empty ones only."""
    cats = classified_sources(partitions).select(
        "model_id", F.when(F.col("category") == "Computed", F.lit("Computed Tables")).otherwise(F.col("category")).alias("section"))
    dax = calculated_tables(partitions).where(~is_system_table("table_name")).select("model_id", F.lit("Computed Tables").alias("section"))
    params = all_parameters(expressions).select(
        "model_id", F.when(F.col("kind") == "parameter", F.lit("Parameters")).otherwise(F.lit("Helper Functions")).alias("section"))
    counts = cats.unionByName(dax).unionByName(params).groupBy("model_id", "section").agg(F.count(F.lit(1)).alias("n_items"))
    order = F.array_position(F.array(*[F.lit(s) for s in SOURCE_SECTIONS]), F.col("section"))
    w = Window.partitionBy("model_id").orderBy(order)
    return counts.withColumn("section_no", F.dense_rank().over(w))


# ------------------------------------------------------------------ grouping (A5) and counts (A1)

def columns_by_table(columns: DataFrame, include_system_tables: bool = False) -> DataFrame:
    """A5 for columns: tables sorted, a table's columns in input order."""
    return items_by_table(columns, "column_name", include_system_tables, by=("ordinal",))


def items_by_table(items: DataFrame, name_col: str, include_system_tables: bool = False, by=None) -> DataFrame:
    """A5: per (model, table) section number (tables sorted, non-empty only) and item number (names sorted, or ``by``)."""
    it = items if include_system_tables else items.where(~is_system_table("table_name"))
    tables = row_number_within(it.select("model_id", "table_name").distinct(), ["model_id"], ["table_name"], "section_no")
    # the items of one table are few; a model's tables need not be
    numbered = it.select("model_id", "table_name", name_col, "ordinal").withColumn(
        "item_no", F.row_number().over(Window.partitionBy("model_id", "table_name").orderBy(*(by or (name_col, "ordinal")))))
    return (numbered.join(tables, ["model_id", "table_name"])
            .select("model_id", "table_name", "section_no", F.col(name_col).alias("name"), "item_no"))


def model_summary(tables: DataFrame, columns: DataFrame, measures: DataFrame, relationships: DataFrame,
                  expressions: DataFrame, partitions: DataFrame, pages: DataFrame, visuals: DataFrame) -> DataFrame:
    """A1: per-model counts from each catalog table, outer-joined, missing counts as 0."""
    kind = classify_parameter(F.col("name"), F.col("expression"))
    parts = [
        tables.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_tables")),
        columns.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_columns"),
                                        F.count_if(F.col("is_calculated")).alias("n_calculated_columns")),
        measures.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_measures")),
        relationships.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_relationships")),
        expressions.groupBy("model_id").agg(F.count_if(kind == "parameter").alias("n_parameters"),
                                            F.count_if(kind == "helper").alias("n_functions")),
        partitions.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_queries")),
        pages.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_pages")),
        visuals.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_visuals")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "model_id", "full")
    return out.fillna(0)


# ------------------------------------------------------------------ scope

def fact_scope(relationships: DataFrame, universe: DataFrame) -> DataFrame:
    """Tables on a 'many' side plus their one-hop neighbours; a model without facts keeps every table."""
    r = relationships
    facts = (r.where(F.lower("to_cardinality") == "many").select("model_id", F.col("to_table").alias("table_name"))
             .unionByName(r.where(F.lower("from_cardinality") == "many").select("model_id", F.col("from_table").alias("table_name")))
             .where(F.col("table_name").isNotNull()).distinct())
    f_from = facts.select("model_id", F.col("table_name").alias("from_table"))
    f_to = facts.select("model_id", F.col("table_name").alias("to_table"))
    hop = (r.join(f_from, ["model_id", "from_table"], "left_semi").select("model_id", F.col("to_table").alias("table_name"))
           .unionByName(r.join(f_to, ["model_id", "to_table"], "left_semi").select("model_id", F.col("from_table").alias("table_name"))))
    scoped = facts.unionByName(hop).where(F.col("table_name").isNotNull()).distinct()
    no_facts = universe.join(facts.select("model_id").distinct(), "model_id", "left_anti")
    return scoped.unionByName(no_facts.select("model_id", "table_name")).distinct()


def relationships_in_scope(relationships: DataFrame, scope: DataFrame) -> DataFrame:
    """Relationships whose two ends are both in scope (two semi joins)."""
    return (relationships
            .join(scope.select("model_id", F.col("table_name").alias("from_table")), ["model_id", "from_table"], "left_semi")
            .join(scope.select("model_id", F.col("table_name").alias("to_table")), ["model_id", "to_table"], "left_semi"))


# ------------------------------------------------------------------ definition matching (J11) and search

DEFINITION_SCHEMA = ("array<struct<schema_version:string, object_type:string, table:string, object_name:string, "
                     "definition:string, business_logic:string>>")


def catalog_objects(measures: DataFrame, columns: DataFrame) -> DataFrame:
    """Documented objects a definition can attach to: non-system measures and calculated columns."""
    m = measures.where(~is_system_table("table_name")).select(
        "model_id", F.lit("measure").alias("object_type"), F.col("name").alias("object_name"), "table_name")
    c = columns.where(F.col("is_calculated") & ~is_system_table("table_name")).select(
        "model_id", F.lit("column").alias("object_type"), F.col("column_name").alias("object_name"), "table_name")
    return m.unionByName(c)


# Fixed value: the array of objects inside a reply, from its first "[{" to the first "}]".
REPLY_ARRAY = r"(?s)\[\s*\{.*?\}\s*\]"


def enrich_definitions(payloads: DataFrame, objects: DataFrame) -> DataFrame:
    """Per pasted reply, items, matched objects and skipped count; every reply gives one row.

    The JSON array is found inside the reply's text.  A reply without one, or
    whose array does not parse, has the status 'unreadable' and no items.
    Only schema_version '1' items apply; type and name match case-insensitively
    and the table too when the item gives one.  Matched counts objects, so an
    item may match several.
    """
    array = F.regexp_extract("payload", REPLY_ARRAY, 0)
    parsed = payloads.select("model_id", "ordinal", F.from_json(F.nullif(array, F.lit("")), DEFINITION_SCHEMA).alias("items"))
    items = parsed.select("model_id", "ordinal", F.posexplode("items").alias("item_no", "it"))
    ok = items.where(F.col("it.schema_version") == "1").select(
        "model_id", "ordinal", "item_no", F.lower("it.object_type").alias("t"), F.lower("it.object_name").alias("n"),
        F.lower("it.table").alias("tb"))
    obj = objects.select("model_id", F.lower("object_type").alias("t"), F.lower("object_name").alias("n"),
                         F.lower("table_name").alias("otb"))
    matched = (ok.join(obj, ["model_id", "t", "n"])
               .where(F.col("tb").isNull() | (F.col("tb") == "") | (F.col("tb") == F.col("otb")))
               .groupBy("model_id", "ordinal").agg(F.count(F.lit(1)).alias("n_matched")))
    return (parsed.join(matched, ["model_id", "ordinal"], "left")
            .select("model_id", "ordinal", F.when(F.col("items").isNull(), "unreadable").otherwise("ok").alias("status"),
                    F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.coalesce("n_matched", F.lit(0)).alias("n_matched"))
            .withColumn("n_items", F.greatest(F.col("n_items"), F.lit(0)))
            .withColumn("n_skipped", F.greatest(F.col("n_items") - F.col("n_matched"), F.lit(0))))


def catalog_search(measures: DataFrame, query: str) -> DataFrame:
    """Table and measure entries whose label contains the query (case-insensitive), plus their parent tables."""
    q = query.strip().lower()
    m = measures.where(~is_system_table("table_name")).select("model_id", "table_name", "name")
    hits = m.where(F.lower("name").contains(q)).select("model_id", F.lit("measure").alias("kind"), "table_name", "name")
    tables = m.select("model_id", "table_name").distinct()
    table_hits = tables.where(F.lower("table_name").contains(q))
    parents = tables.join(hits.select("model_id", "table_name"), ["model_id", "table_name"], "left_semi")
    t = table_hits.unionByName(parents).distinct().select("model_id", F.lit("table").alias("kind"), "table_name",
                                                          F.lit(None).cast("string").alias("name"))
    return hits.unionByName(t)


# ------------------------------------------------------------------ export (A10)

def _text(df: DataFrame, name: str):
    """An optional column as text (null where the table has none)."""
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _flag(df: DataFrame, name: str):
    return F.coalesce(F.lower(_text(df, name)) == "true", F.lit(False))


def _line_if(condition, line):
    return F.when(condition, F.array(line)).otherwise(F.array().cast("array<string>"))


def definition_export(scope: DataFrame, partitions: DataFrame, columns: DataFrame, measures: DataFrame,
                      relationships: DataFrame, redact: bool = True) -> DataFrame:
    """A10: the model definition text as ordered line rows (model_id, part, table_name, section, block, seq, line).

    Tables in scope (sorted by name) with their M source (optionally redacted,
    P7), calculated columns and measures; then the in-scope relationships.
    Within a model, ordering by (part, table_name, section, block, seq) gives the text.
    """
    scope = cut_lineage(scope, "scope")  # used by every block below
    lit_lines = lambda *ls: F.array(*[F.lit(x) if isinstance(x, str) else x for x in ls])
    pre = scope.select("model_id").distinct().select(
        "model_id", F.lit(0).alias("part"), F.lit("").alias("table_name"), F.lit(0).alias("section"), F.lit(0).cast("long").alias("block"),
        lit_lines(*EXPORT_PREAMBLE).alias("lines"))
    hdr = scope.select("model_id", F.lit(1).alias("part"), "table_name", F.lit(0).alias("section"), F.lit(0).cast("long").alias("block"),
                       F.array(F.concat(F.lit("table '"), F.col("table_name"), F.lit("'"))).alias("lines"))
    # a calculated partition carries no M source text (its text is a DAX expression)
    src = latest_partition(partitions).select(
        "model_id", "table_name", F.when(F.col("is_calculated"), F.lit("")).otherwise(F.col("expression")).alias("expression"))
    expr = redact_sensitive(F.col("expression")) if redact else F.col("expression")
    part = (src.join(scope, ["model_id", "table_name"], "left_semi")
            .select("model_id", F.lit(1).alias("part"), "table_name", F.lit(1).alias("section"), F.lit(0).cast("long").alias("block"),
                    F.array(F.concat(F.lit("\tpartition '"), F.col("table_name"), F.lit("-Partition' = m")),
                            F.lit("\t\tmode: import"),
                            F.concat(F.lit("\t\tsource = \n```\n"), expr, F.lit("\n```\n"))).alias("lines")))
    calc = columns.where(F.col("is_calculated")).join(scope, ["model_id", "table_name"], "left_semi")
    calc = calc.select("model_id", "table_name", "column_name", "data_type", "expression", *(["is_hidden"] if "is_hidden" in columns.columns else [])).withColumn(
        "_col_no", F.row_number().over(Window.partitionBy("model_id", "table_name").orderBy("column_name", "data_type", "expression")))
    cols = (calc
            .select("model_id", F.lit(1).alias("part"), "table_name",
                    F.lit(2).alias("section"), F.col("_col_no").cast("long").alias("block"),
                    F.flatten(F.array(
                        F.array(F.concat(F.lit("\tcolumn '"), F.col("column_name"), F.lit("'")),
                                F.concat(F.lit("\t\tdataType: "), F.coalesce("data_type", F.lit("unknown")))),
                        _line_if(_flag(columns, "is_hidden"), F.lit("\t\tisHidden")),
                        F.when(F.coalesce("expression", F.lit("")) != "",
                               F.array(F.concat(F.lit("\t\texpression = \n\t\t\t```\n\t\t\t"), F.col("expression"),
                                                F.lit("\n\t\t\t```")))).otherwise(F.array().cast("array<string>")),
                        F.array(F.lit("")))).alias("lines")))
    meas = (measures.join(scope, ["model_id", "table_name"], "left_semi")
            .select("model_id", F.lit(1).alias("part"), "table_name",
                    F.lit(3).alias("section"), F.col("ordinal").cast("long").alias("block"),
                    F.flatten(F.array(
                        F.array(F.concat(F.lit("\tmeasure '"), F.col("name"), F.lit("' = \n\t\t```\n\t\t"),
                                         F.coalesce("expression", F.lit("")), F.lit("\n\t\t```"))),
                        _line_if(F.coalesce(_text(measures, "display_folder"), F.lit("")) != "",
                                 F.concat(F.lit("\t\tdisplayFolder: "), _text(measures, "display_folder"))),
                        F.when(F.coalesce("format_string", F.lit("")) != "",
                               F.array(F.concat(F.lit("\t\tformatString: "), F.col("format_string"))))
                        .otherwise(F.array().cast("array<string>")),
                        _line_if(_flag(measures, "is_hidden"), F.lit("\t\tisHidden")),
                        F.array(F.lit("")))).alias("lines")))
    active = F.coalesce(F.lower(_text(relationships, "is_active")), F.lit("true"))
    rels = (relationships_in_scope(relationships, scope)
            .select("model_id", F.lit(2).alias("part"), F.lit("").alias("table_name"), F.lit(0).alias("section"), F.col("rel_id").cast("long").alias("block"),
                    F.array(F.concat(F.lit("relationship '"), F.col("from_table"), F.lit("_"), F.col("to_table"), F.lit("'")),
                            F.concat(F.lit("\tfromColumn: '"), F.col("from_table"), F.lit("'.'"), F.coalesce(F.col("from_column").cast("string"), F.lit("None")), F.lit("'")),
                            F.concat(F.lit("\ttoColumn: '"), F.col("to_table"), F.lit("'.'"), F.coalesce(F.col("to_column").cast("string"), F.lit("None")), F.lit("'")),
                            F.concat(F.lit("\tisActive: "), active),
                            F.concat(F.lit("\tcrossFilteringBehavior: "), F.coalesce("cross_filter", F.lit("both"))),
                            F.lit("")).alias("lines")))
    blocks = pre.unionByName(hdr).unionByName(part).unionByName(cols).unionByName(meas).unionByName(rels)
    return blocks.select("model_id", "part", "table_name", "section", "block", F.posexplode("lines").alias("seq", "line"))


def export_text_order() -> list[str]:
    """Sort keys that turn A10 line rows into the model's text."""
    return ["model_id", "part", "table_name", "section", "block", "seq"]
