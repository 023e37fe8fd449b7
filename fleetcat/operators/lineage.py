"""Measure lineage: which measures and columns each measure reads.

Plan shape: one projection extracts every bracket reference of an expression
with ``regexp_extract_all`` (no Python), an ``explode`` turns references into
rows, and two equi-joins on ``(model_id, lower(name))`` resolve bare ``[name]``
references against the model's known measures and columns.  Every shuffle is
keyed by model plus name, so a model holding a third of the fleet still
spreads over many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcat.functions import is_system_table

# Fixed values that must equal the reference's rules: comment and string removal,
# declared variables, and the reference pattern 'table'[name] / table[name] / [name].
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENTS = (r"(?d)--.*", r"(?d)//.*")
STRING_LITERAL = r'"[^"]*"'
VAR_DECL = r"(?i)\bVAR\s+([a-zA-Z0-9_]+)\b"
REFERENCE = r"(?:('[^']+'|[a-zA-Z0-9_]+)\s*)?\[([^\]]+)\]"
NONE_MARK = "--"


def strip_comments_and_strings(expr) -> Column:
    """Remove block and line comments (in that order), then blank string literals."""
    e = F.regexp_replace(F.coalesce(expr, F.lit("")), BLOCK_COMMENT, "")
    for p in LINE_COMMENTS:
        e = F.regexp_replace(e, p, "")
    return F.regexp_replace(e, STRING_LITERAL, '""')


CALL = r"([A-Za-z][A-Za-z0-9_.]*)\s*\("


def function_calls(measures: DataFrame) -> DataFrame:
    """How often each measure calls each function: (model_id, measure, function in upper case, n_calls).

    Names before an opening parenthesis, outside comments, strings and [names].
    """
    code = F.regexp_replace(strip_comments_and_strings(F.col("expression")), r"\[[^\]]*\]|'[^']*'", "")
    calls = latest_by_name(measures, include_system_tables=True).select(
        "model_id", F.col("name").alias("measure"), F.explode(F.regexp_extract_all(code, F.lit(CALL), 1)).alias("function"))
    return calls.groupBy("model_id", "measure", F.upper("function").alias("function")).agg(F.count(F.lit(1)).alias("n_calls"))


def latest_by_name(measures: DataFrame, include_system_tables: bool = False) -> DataFrame:
    """One row per (model, measure name): the last definition wins, as in a dict rebuild."""
    m = measures
    if not include_system_tables:
        m = m.where(~is_system_table("table_name"))
    return (m.where(F.col("name").isNotNull())
            .groupBy("model_id", "name")
            .agg(F.max_by("expression", "ordinal").alias("expression"),
                 F.max_by("table_name", "ordinal").alias("table_name")))


def lineage_edges(measures: DataFrame, columns: DataFrame, include_system_tables: bool = False) -> DataFrame:
    """Direct dependency edges (model_id, measure, dep_kind, dep).

    ``table[name]`` is always a column; a bare ``[name]`` is a measure when the
    model defines one by that name (case-insensitive), else a column when the
    model has such a column, else dropped.  Names declared with ``VAR`` are
    skipped.  Comments go before strings (so '//' inside a string cuts the
    line), as in the reference.
    """
    latest = latest_by_name(measures, include_system_tables)
    known_measures = latest.select("model_id", F.lower("name").alias("ref_key"), F.lit(True).alias("is_measure")).distinct()
    known_columns = (columns.where(F.col("column_name").isNotNull())
                     .select("model_id", F.lower("column_name").alias("ref_key"), F.lit(True).alias("is_column"))
                     .distinct())

    clean = strip_comments_and_strings(F.col("expression"))
    refs = (latest
            .select("model_id", "name", clean.alias("e"))
            .select("model_id", "name",
                    F.transform(F.regexp_extract_all("e", F.lit(VAR_DECL), 1), F.lower).alias("vars"),
                    F.arrays_zip(F.regexp_extract_all("e", F.lit(REFERENCE), 1).alias("tbl"),
                                 F.regexp_extract_all("e", F.lit(REFERENCE), 2).alias("ref")).alias("refs"))
            .select("model_id", "name", "vars", F.explode("refs").alias("r"))
            .select("model_id", F.col("name").alias("measure"), F.col("r.tbl").alias("tbl"),
                    F.col("r.ref").alias("dep"), "vars")
            .where(~F.array_contains("vars", F.lower("dep")))
            .withColumn("ref_key", F.lower("dep")))

    qualified = refs.where(F.col("tbl") != "").select("model_id", "measure", F.lit("column").alias("dep_kind"), "dep")
    bare = (refs.where(F.col("tbl") == "")
            .join(known_measures, ["model_id", "ref_key"], "left")
            .join(known_columns, ["model_id", "ref_key"], "left")
            .where(F.col("is_measure").isNotNull() | F.col("is_column").isNotNull())
            .select("model_id", "measure",
                    F.when(F.col("is_measure").isNotNull(), F.lit("measure")).otherwise(F.lit("column")).alias("dep_kind"),
                    "dep"))
    return qualified.unionByName(bare).distinct()


def lineage_summary(edges: DataFrame) -> DataFrame:
    """Per measure, sorted measure deps and column deps; '--' when a side is empty."""
    def joined(kind: str) -> Column:
        deps = F.array_sort(F.collect_set(F.when(F.col("dep_kind") == kind, F.col("dep"))))
        return F.when(F.size(deps) == 0, F.lit(NONE_MARK)).otherwise(F.array_join(deps, ", "))

    return (edges.groupBy("model_id", "measure")
            .agg(joined("measure").alias("depends_on_measures"), joined("column").alias("depends_on_columns")))


def graph_nodes(edges: DataFrame, relationships: DataFrame | None = None) -> DataFrame:
    """Distinct node set (model_id, node_kind, node) of the lineage and relationship graphs.

    Lineage nodes are measures having a dependency, the measures they depend
    on, and the columns they read.  Relationship nodes are the tables on
    either end of a (cleaned) relationship.
    """
    nodes = (edges.select("model_id", F.lit("measure").alias("node_kind"), F.col("measure").alias("node"))
             .unionByName(edges.select("model_id", "dep_kind", "dep").toDF("model_id", "node_kind", "node")))
    if relationships is not None:
        nodes = (nodes
                 .unionByName(relationships.select("model_id", F.lit("table").alias("node_kind"), F.col("from_table").alias("node")))
                 .unionByName(relationships.select("model_id", F.lit("table").alias("node_kind"), F.col("to_table").alias("node"))))
    return nodes.distinct()
