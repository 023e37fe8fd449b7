"""Model lint: relationship cleaning, duplicated logic, threshold observations.

All per-model counts are plain ``groupBy(model_id)`` aggregates, which Spark
plans as partial (map-side) plus final aggregation, so no model's rows are
ever gathered in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcat.functions import is_hardcoded_connection, is_system_table
from fleetcat.functions.common import py_strip

# Fixed values that must equal the reference's rules.
MIN_DUPLICATE_EXPR_CHARS = 10  # trimmed expression must be longer than this
BIDIRECTIONAL_LIMIT = 3
MEASURE_LIMIT = 30
CALC_COLUMN_LIMIT = 10
HARDCODED, BIDIRECTIONAL, MEASURE_COUNT = "Hardcoded Connections", "Bidirectional Relationships", "Measure Count"
CALC_COLUMNS, DUPLICATES, UNUSED = "Calculated Columns", "Duplicate DAX Logic", "Unused Measures"
OBSERVATIONS = {  # title: severity, and the count that must be exceeded
    HARDCODED: ("warning", 0), BIDIRECTIONAL: ("important", BIDIRECTIONAL_LIMIT), MEASURE_COUNT: ("note", MEASURE_LIMIT),
    CALC_COLUMNS: ("tip", CALC_COLUMN_LIMIT), DUPLICATES: ("tip", 0), UNUSED: ("note", 0),
}
REL_END_COLUMNS = ("from_table", "from_column", "to_table", "to_column")


def cross_filter_label(raw) -> F.Column:
    """'Both' when the raw behaviour is '2' or contains 'both' (any case), else 'Single'."""
    r = F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit("1")).cast("string")
    return F.when((r == "2") | F.lower(r).contains("both"), F.lit("Both")).otherwise(F.lit("Single"))


def clean_relationships(rels: DataFrame, include_system_tables: bool = False) -> DataFrame:
    """Drop rows with a null end, drop system-table ends, label the cross filter."""
    out = rels.dropna(subset=list(REL_END_COLUMNS))
    if not include_system_tables:
        out = out.where(~is_system_table("from_table") & ~is_system_table("to_table"))
    return out.withColumn("cross_filter_label", cross_filter_label("cross_filter"))


def duplicate_expressions(measures: DataFrame) -> DataFrame:
    """A2: measures whose trimmed expression (over 10 chars) is shared by 2+ measures.

    One row per measure in a duplicated group, with the group size.  The
    group count is a partial aggregate; the rows come back through an
    equi-join on (model_id, expression), so a huge group is never collected.
    """
    m = (measures.select("model_id", "ordinal", "name",
                         py_strip(F.coalesce(F.col("expression").cast("string"), F.lit("None"))).alias("expression"))
         .where(F.length("expression") > MIN_DUPLICATE_EXPR_CHARS))
    groups = (m.groupBy("model_id", "expression").agg(F.count(F.lit(1)).alias("n_sharing"))
              .where(F.col("n_sharing") > 1))
    return m.join(groups, ["model_id", "expression"]).select("model_id", "expression", "name", "ordinal", "n_sharing")


def observation_items(partitions: DataFrame, measures: DataFrame, unused_report: DataFrame) -> DataFrame:
    """A3 lists: one row per (model, observation, item): tables with hardcoded servers, measures that share logic, unused measures."""
    hard = partitions.where(is_hardcoded_connection(F.col("expression"))).select(
        "model_id", F.lit(HARDCODED).alias("title"), F.col("table_name").alias("item"))
    shared = duplicate_expressions(measures).select("model_id", F.lit(DUPLICATES), "name")
    unused = unused_report.select("model_id", F.lit(UNUSED), "name")
    return hard.union(shared).union(unused)


def threshold_observations(partitions: DataFrame, relationships: DataFrame, measures: DataFrame,
                           columns: DataFrame, unused_report: DataFrame | None = None) -> DataFrame:
    """A3: (model_id, severity, title, n) observations.

    Hardcoded HANA server (any), bidirectional relationships (> 3), measure
    count (> 30), calculated columns (> 10), duplicated logic (any group),
    unused measures (any, from J2).  Observations do not drop system tables.
    What the rules count is one tagged union, summed once per (model, title).
    """
    shared = measures.select("model_id", py_strip(F.coalesce(F.col("expression").cast("string"), F.lit("None"))).alias("expression"))
    shared = (shared.groupBy("model_id", F.when(F.length("expression") > MIN_DUPLICATE_EXPR_CHARS, F.col("expression")).alias("expression"))
              .agg(F.count(F.lit(1)).alias("n")))
    repeated = F.when(F.col("expression").isNotNull() & (F.col("n") > 1), 1).otherwise(0)
    one = F.lit(1)
    found = [
        partitions.where(is_hardcoded_connection(F.col("expression"))).select("model_id", F.lit(HARDCODED).alias("title"), one.alias("n")),
        relationships.where(cross_filter_label("cross_filter") == "Both").select("model_id", F.lit(BIDIRECTIONAL), one),
        columns.where("is_calculated").select("model_id", F.lit(CALC_COLUMNS), one),
        # both counts of a group of equal expressions: its measures, and whether it repeats
        shared.select("model_id", F.explode(F.create_map(F.lit(MEASURE_COUNT), F.col("n"), F.lit(DUPLICATES), repeated.cast("long")))),
    ]
    if unused_report is not None:
        found.append(unused_report.select("model_id", F.lit(UNUSED), one))
    counted = reduce(DataFrame.union, found).groupBy("model_id", "title").agg(F.sum("n").alias("n"))
    rule = F.create_map(*[x for title, (severity, limit) in OBSERVATIONS.items() for x in (F.lit(title), F.struct(F.lit(severity).alias("severity"), F.lit(limit).alias("limit")))])
    return (counted.withColumn("rule", rule[F.col("title")]).where(F.col("n") > F.col("rule.limit"))
            .select("model_id", "rule.severity", "title", "n"))
