"""Definition files: render catalog rows as definition text, write and scan them.

Rendering is used for round trips (rows -> text -> segmentation -> rows) and
to materialise a fleet of definition folders that the file scan reads back.
Text is built with Catalyst string functions; every file is one group of its
own lines (a file is the unit a reader handles).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetcat.operators.segment import BIG, FENCE, lines_of
from fleetcat.session import ensure_checkpoint_dir
from fleetcat.sources.fixtures import block_of, model_of

T, T2, T3, T4 = "\t", "\t\t", "\t\t\t", "\t\t\t\t"


def _lines(*parts: Column) -> Column:
    """Concatenate arrays of lines (nulls skipped)."""
    return F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))


def _expr_lines(expr: Column, mode: Column, header: Column, cont: str, inline_sep: str = " ") -> Column:
    """Header line plus an expression: 0 inline (first line on the header), 1 fenced, 2 continued at ``cont``."""
    ls = F.split(expr, "\n")
    inline = F.concat(
        F.array(F.concat(header, F.lit(inline_sep), F.element_at(ls, 1))),
        F.transform(F.slice(ls, F.lit(2), F.size(ls)), lambda x: F.concat(F.lit(cont), x)))
    fenced = F.concat(F.array(header, F.lit(cont + FENCE)),
                      F.transform(ls, lambda x: F.concat(F.lit(cont), x)), F.array(F.lit(cont + FENCE)))
    continued = F.concat(F.array(header), F.transform(ls, lambda x: F.concat(F.lit(cont), x)))
    return F.when(mode == 0, inline).when(mode == 1, fenced).otherwise(continued)


def render_measure_blocks(measures: DataFrame) -> DataFrame:
    """One block per measure, in its table's file: inline, fenced or continued by ordinal."""
    hdr = F.concat(F.lit(T + "measure '"), F.col("name"), F.lit("' ="))
    body = _expr_lines(F.col("expression"), F.col("ordinal") % 3, hdr, T3)
    fmt = F.when(F.col("format_string") != "", F.array(F.concat(F.lit(T2 + "formatString: "), F.col("format_string"))))
    return measures.select("model_id", F.col("table_name").alias("file"), F.col("ordinal").alias("block_order"),
                           _lines(body, fmt, F.array(F.lit(""))).alias("lines"))


def render_column_blocks(columns: DataFrame) -> DataFrame:
    """One block per column; calculated columns carry a fenced expression."""
    calc = F.col("is_calculated")
    hdr = F.concat(F.lit(T + "column "), F.col("column_name"))
    head = F.when(calc, F.concat(F.array(F.concat(hdr, F.lit(" ="))), F.array(F.lit(T3 + FENCE)),
                                 F.transform(F.split("expression", "\n"), lambda x: F.concat(F.lit(T3), x)),
                                 F.array(F.lit(T3 + FENCE)))).otherwise(F.array(hdr))
    props = F.array(F.concat(F.lit(T2 + "dataType: "), F.col("data_type")),
                    F.concat(F.lit(T2 + "sourceColumn: '"), F.col("column_name"), F.lit("'")),
                    F.lit(T2 + "summarizeBy: none"))
    key = F.when(F.col("column_name").endswith("key"), F.array(F.lit(T2 + "isKey: true")))
    order = F.row_number().over(Window.partitionBy("model_id", "table_name").orderBy("column_name"))
    return columns.select("model_id", F.col("table_name").alias("file"), order.alias("block_order"),
                          _lines(head, props, key, F.array(F.lit(""))).alias("lines"))


def render_partition_blocks(partitions: DataFrame) -> DataFrame:
    """One table file per partition row: mode, then the source inline, fenced or continued."""
    ptype = F.when(F.col("is_calculated"), F.lit("calculated")).otherwise(F.lit("m"))
    hdr = F.array(F.concat(F.lit(T + "partition '"), F.col("table_name"), F.lit("-Partition' = "), ptype),
                  F.lit(T2 + "mode: import"))
    src = _expr_lines(F.col("expression"), F.col("ordinal") % 3, F.lit(T2 + "source ="), T3)
    return partitions.select("model_id", F.col("table_name").alias("file"), F.lit(0).alias("block_order"),
                             _lines(hdr, src, F.array(F.lit(""))).alias("lines"))


def table_headers(blocks: DataFrame) -> DataFrame:
    """The first line of every table file."""
    return (blocks.select("model_id", "file").distinct()
            .select("model_id", "file", F.lit(-1).cast("long").alias("block_order"),
                    F.array(F.concat(F.lit("table '"), F.col("file"), F.lit("'"))).alias("lines")))


def assemble(blocks: DataFrame) -> DataFrame:
    """(model_id, file, text): lines of every block in (block_order, sub_order, line) order."""
    if "sub_order" not in blocks.columns:
        blocks = blocks.withColumn("sub_order", F.lit(0).cast("long"))
    rows = blocks.select("model_id", "file", "block_order", "sub_order", F.posexplode("lines").alias("pos", "line"))
    return (rows.groupBy("model_id", "file")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_order", "sub_order", "pos", "line"))),
                                          lambda s: s["line"]), "\n").alias("value")))


def table_files(measures: DataFrame | None = None, columns: DataFrame | None = None,
                partitions: DataFrame | None = None) -> DataFrame:
    blocks = None
    for df, fn in ((measures, render_measure_blocks), (columns, render_column_blocks),
                   (partitions, render_partition_blocks)):
        if df is not None:
            b = fn(df).withColumn("block_order", F.col("block_order").cast("long"))
            blocks = b if blocks is None else blocks.unionByName(b)
    return assemble(blocks.unionByName(table_headers(blocks)))


def write_definition_files(files: DataFrame, path: str | None = None) -> str:
    """Write (model_id, file, value) as one text file per (model, file) under a shared folder.

    The text writer ends the single row with a line break.
    """
    spark = files.sparkSession
    if path is None:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/definitions-{uuid.uuid4().hex}"
    (files.select("model_id", "file", "value")
     .repartition("model_id", "file")
     .write.partitionBy("model_id", "file").text(path))
    return path


def pack_definition_files(files: DataFrame, path: str) -> str:
    """Write (model_id, file, value) as packs: a row is a whole definition file, a stored file holds many of them.

    A fleet has a file per table; a stored file for each costs more in opening,
    committing and listing than its few lines.  A file ends with a line break,
    as the text writer ends it.
    """
    files.select("model_id", "file", F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).alias("value")).write.parquet(path)
    return path


def scan_definition_lines(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(model_id, file, file_path, line_no, line) from a folder of definition files, or of packs of them."""
    if packed:
        packs = spark.read.parquet(path).select("model_id", "file", F.col("_metadata.file_path").alias("file_path"), "value")
        return lines_of(packs, ["model_id", "file", "file_path"])
    files = (spark.read.text(path, wholetext=True)
             .select(F.col("model_id").cast("long").alias("model_id"), "file",
                     F.col("_metadata.file_path").alias("file_path"), "value"))
    return lines_of(files, ["model_id", "file", "file_path"])


def calc_group_files(parts: DataFrame) -> DataFrame:
    """One calculation-group table per model and block of parts; one item per part, ordinals out of order, some missing or invalid."""
    p = F.col("p_partkey")
    model = F.expr(model_of("p_partkey")).alias("model_id")
    file = F.concat(F.lit("Calc Group "), F.expr(block_of("p_partkey")).cast("string")).alias("file")
    item_expr = F.concat(F.lit("SELECTEDMEASURE() * "), p.cast("string"))
    body = _expr_lines(item_expr, p % 3, F.lit(T3 + "expression ="), T4)
    ordinal = (F.when(p % 4 == 0, F.array().cast("array<string>"))
               .when(p % 17 == 0, F.array(F.lit(T3 + "ordinal = x")))
               .otherwise(F.array(F.concat(F.lit(T3 + "ordinal = "), ((p * 7) % 13).cast("string")))))
    items = parts.select(model, file, p.cast("long").alias("block_order"),
                         _lines(F.array(F.concat(F.lit(T2 + "calculationItem 'Item "), p.cast("string"), F.lit("'"))),
                                body, ordinal).alias("lines"))
    heads = (items.select("model_id", "file").distinct()
             .select("model_id", "file", F.lit(-1).cast("long").alias("block_order"),
                     F.array(F.lit(T + "calculationGroup"), F.lit(T2 + "column: 'Calc Item'")).alias("lines")))
    blocks = items.unionByName(heads)
    return assemble(blocks.unionByName(table_headers(blocks).withColumn("block_order", F.lit(-2).cast("long"))))


def hierarchy_files(parts: DataFrame) -> DataFrame:
    """One table per model and block of parts with a hierarchy per part type; one level per part."""
    p = F.col("p_partkey")
    base = parts.select(F.expr(model_of("p_partkey")).alias("model_id"), F.concat(F.lit("Hierarchy "), F.expr(block_of("p_partkey")).cast("string")).alias("file"),
                        F.col("p_type"), p.cast("long").alias("p"))
    first = base.groupBy("model_id", "file", "p_type").agg(F.min("p").alias("block_order"))
    levels = base.join(first, ["model_id", "file", "p_type"]).select(
        "model_id", "file", "block_order", F.col("p").alias("sub_order"),
        F.array(F.concat(F.lit(T2 + "level 'Level "), F.col("p").cast("string"), F.lit("'")),
                F.when(F.col("p") % 2 == 0, F.lit(T3 + "column: p_size"))
                .otherwise(F.concat(F.lit(T3 + "column: 'Col "), F.col("p").cast("string"), F.lit("'")))).alias("lines"))
    heads = first.select("model_id", "file", "block_order", F.lit(-1).cast("long").alias("sub_order"),
                         F.array(F.concat(F.lit(T + "hierarchy '"), F.col("p_type"), F.lit("'"))).alias("lines"))
    tails = first.select("model_id", "file", "block_order", F.lit(BIG).alias("sub_order"),
                         F.array(F.lit("")).alias("lines"))
    blocks = levels.unionByName(heads).unionByName(tails)
    th = table_headers(blocks).withColumn("sub_order", F.lit(0).cast("long"))
    return assemble(blocks.unionByName(th))


def _ref(table: Column, column: Column, quoted: Column) -> Column:
    return F.when(quoted, F.concat(F.lit("'"), table, F.lit("'.'"), column, F.lit("'"))).otherwise(
        F.concat(table, F.lit("."), column))


def relationship_files(rels: DataFrame) -> DataFrame:
    """One relationships file per model; optional lines only when they differ from the defaults."""
    q = F.col("rel_id") % 2 == 0
    lines = _lines(
        F.array(F.concat(F.lit("relationship R"), F.col("rel_id").cast("string")),
                F.concat(F.lit(T + "fromColumn: "), _ref(F.col("from_table"), F.col("from_column"), q))),
        F.when(F.col("to_column").isNotNull(),
               F.array(F.concat(F.lit(T + "toColumn: "), _ref(F.col("to_table"), F.col("to_column"), q)))),
        F.when(F.col("cross_filter") == "Both", F.array(F.lit(T + "crossFilteringBehavior: bothDirections"))),
        F.when(F.col("to_cardinality") != "one", F.array(F.concat(F.lit(T + "toCardinality: "), F.col("to_cardinality")))),
        F.when(F.col("from_cardinality") != "many",
               F.array(F.concat(F.lit(T + "fromCardinality: "), F.col("from_cardinality")))),
        F.array(F.lit("")))
    return assemble(rels.select("model_id", F.concat(F.lit("relationships "), F.floor(F.col("rel_id") / 100).cast("string")).alias("file"),
                                F.col("rel_id").cast("long").alias("block_order"), lines.alias("lines")))


def expression_files(exprs: DataFrame) -> DataFrame:
    """One shared-expressions file per model; multi-line bodies continue at indent 2; meta lines at indent 1."""
    e = F.col("expression")
    multi = e.contains("\n")
    head = F.when(multi, F.concat(F.array(F.concat(F.lit("expression "), F.col("name"), F.lit(" ="))),
                                  F.transform(F.split(e, "\n"), lambda x: F.concat(F.lit(T2), x))))
    head = F.coalesce(head, F.array(F.concat(F.lit("expression "), F.col("name"), F.lit(" = "), e)))
    meta = F.concat(F.array(F.concat(F.lit(T + "lineageTag: t"), F.col("ordinal").cast("string"))),
                    F.when(F.col("ordinal") % 4 == 0, F.array(F.lit(T + "queryGroup: Params")))
                    .otherwise(F.array().cast("array<string>")))
    return assemble(exprs.select("model_id", F.concat(F.lit("expressions "), F.floor(F.col("ordinal") / 50).cast("string")).alias("file"),
                                 F.col("ordinal").cast("long").alias("block_order"), _lines(head, meta).alias("lines")))
