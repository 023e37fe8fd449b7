"""Registered queries over one large definition file: the segmented scan (T4-T10 over many tasks).

All blocks of a catalog table stand in one file, whose length grows with the
table; the rows must be those that the many small files give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcat.operators import scan
from fleetcat.operators import segment as seg
from fleetcat.operators.common import row_number_within
from fleetcat.plans import source_queries as S
from fleetcat.plans.registry import ORACLES, register
from fleetcat.session import read_table
from fleetcat.sources import definitions as defs
from fleetcat.sources.fixtures import catalog

FILE = ["file"]


def one_file(files: DataFrame) -> DataFrame:
    """(file, line_no, line): the lines of all files in turn, as the lines of one file."""
    lines = seg.lines_of(files, S.KEYS).withColumnRenamed("file", "part")
    lines = row_number_within(lines.withColumn("file", F.lit("all")), FILE, ["model_id", "part", "line_no"], "number")
    return lines.select("file", (F.col("number") - 1).alias("line_no"), "line")


def _without_file(name: str, *columns: str) -> str:
    return f"select {', '.join(columns)} from ({ORACLES[name]})"


def _parsed(files: DataFrame, kind: str, parse) -> DataFrame:
    return scan.parse_in_pieces(one_file(files), FILE, kind, parse)


_COLUMNS = ["column_name", "is_calculated", "expression", "data_type", "source_column", "sort_by_column", "format_string", "is_key", "summarize_by"]


@register("T4_columns_one_file", oracle=_without_file("T4_columns", *_COLUMNS))
def t4(spark, sf_dir):
    files = defs.table_files(columns=catalog(spark, sf_dir, "cat_columns")["cat_columns"])
    return _parsed(files, "table", scan.of_blocks(seg.columns)).select(*_COLUMNS)


_MEASURES = ["name", "expression", "format_string"]


@register("T5_measures_one_file", oracle=_without_file("T5_measures", *_MEASURES))
def t5(spark, sf_dir):
    files = defs.table_files(measures=catalog(spark, sf_dir, "cat_measures")["cat_measures"])
    return _parsed(files, "table", scan.of_blocks(seg.measures)).select(*_MEASURES)


_PARTITIONS = ["partition_name", "partition_type", "mode", "is_calculated", "source_code", "dax_expression"]


@register("T6_partitions_one_file", oracle=_without_file("T6_partitions", *_PARTITIONS))
def t6(spark, sf_dir):
    files = defs.table_files(partitions=catalog(spark, sf_dir, "cat_partitions")["cat_partitions"])
    return _parsed(files, "table", scan.of_blocks(seg.partitions)).select(*_PARTITIONS)


_ITEMS = ["group_column", "item_name", "expression", "ordinal", "item_rank"]


@register("T7_items_one_file", oracle=_without_file("T7_calculation_items", *_ITEMS))
def t7(spark, sf_dir):
    files = defs.calc_group_files(read_table(spark, sf_dir, "part"))
    return _parsed(files, "table", scan.of_blocks(seg.calculation_items)).select(*_ITEMS)


_LEVELS = ["hierarchy", "level_no", "level", "level_column"]


@register("T8_levels_one_file", oracle=_without_file("T8_hierarchy_levels", *_LEVELS))
def t8(spark, sf_dir):
    files = defs.hierarchy_files(read_table(spark, sf_dir, "part"))
    return _parsed(files, "table", scan.of_blocks(seg.hierarchy_levels)).select(*_LEVELS)


_RELATIONSHIPS = ["rel_name", "from_table", "from_column", "to_table", "to_column", "cross_filter", "from_cardinality", "to_cardinality"]


@register("T9_relationships_one_file", oracle=_without_file("T9_relationships", *_RELATIONSHIPS))
def t9(spark, sf_dir):
    files = defs.relationship_files(catalog(spark, sf_dir, "cat_relationships")["cat_relationships"])
    return _parsed(files, "relationships", seg.relationships).select(*_RELATIONSHIPS)


_EXPRESSIONS = ["name", "kind", "default_value", "param_type", "is_required", "allowed_values", "code"]


@register("T10_expressions_one_file", oracle=_without_file("T10_shared_expressions", *_EXPRESSIONS))
def t10(spark, sf_dir):
    files = defs.expression_files(catalog(spark, sf_dir, "cat_expressions")["cat_expressions"])
    rows = _parsed(files, "expressions", seg.shared_expressions)
    return rows.withColumn("allowed_values", F.array_join("allowed_values", "|")).select(*_EXPRESSIONS)
