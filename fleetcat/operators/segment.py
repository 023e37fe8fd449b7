"""Definition-text segmentation as window jobs (T1-T11), M steps (P25), HTML blocks.

The reference parses each definition file with a sequential loop.  Here a
file is a table of lines ``(keys..., line_no, line)`` and every decision of
that loop becomes a column:

* ``indent`` (T1) and ``stripped``;
* fence state: a fence opens only on the line after an expression opener and
  runs to the next fence line; other fence lines are ordinary lines.  Of a run
  of fence lines that all follow an opener every second one closes, which is
  the parity of a running count since the last one that does not;
* block ids: ``last(when(is_header, line_no), ignorenulls)`` over the file;
* block ends: the first later "terminator" line (indent < 2, not fenced),
  found with a forward running ``min``;
* expression regions (T3): per opener line, either the fence that starts on
  the next line or the continuation lines at a minimum indent;
* properties: conditional aggregates per block, the last value winning.

Windows are partitioned by file; a file is parsed in one task, as a file is
read by one task anyway.  Known limits against the reference's loop: level
headers must sit at indent 2; relationship headers at indent 0; expression
headers at indent 0 or 1; a text that looks like an opener of another block
kind counts as one for a fence on its next line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcat.functions.code import is_binary_payload
from fleetcat.functions.common import let, py_strip

FENCE = "```"
BIG = 1 << 62  # beyond every line number


def _following(keys, skip: int = 1):
    """Frame over the rows after the current one (skipping ``skip - 1`` more), as a growing frame.

    Spark evaluates ``rowsBetween(k, unboundedFollowing)`` with a shrinking
    frame that re-aggregates every following row (quadratic in file length);
    the same rows in reverse line order are a growing frame, linear.
    """
    return Window.partitionBy(*keys).orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, -skip)
# Minimum continuation indents of the reference's collectors:
CONT_INDENT_TABLE = 3   # columns, measures, partition sources
CONT_INDENT_ITEM = 4    # calculation item expressions
CONT_INDENT_SHARED = 2  # shared expressions (parameters and functions)


# ------------------------------------------------------------------ S1 lines

def split_lines(text: Column) -> Column:
    """Lines of a text as a reading loop sees them: \\r\\n, \\r and \\n end a line; a final break adds none."""
    parts = F.split(text, r"\r\n|\r|\n")
    parts = F.when(text.rlike(r"(\r\n|\r|\n)$"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


def lines_of(files: DataFrame, keys, text_col: str = "value") -> DataFrame:
    """(keys..., line_no, line) with 0-based line numbers."""
    return files.select(*keys, F.posexplode(split_lines(F.col(text_col))).alias("line_no", "line"))


# ------------------------------------------------------------------ T1/T2 helpers

def indent_level(line) -> Column:
    """Number of leading tab characters (spaces do not count)."""
    return F.length(F.regexp_extract(line, r"^(\t*)", 1))


def _tail(c: Column, start: int) -> Column:
    """The text from a 1-based position to its end."""
    return F.substring(c, F.lit(start), F.length(c))


def unquote(c: Column) -> Column:
    """Strip, then remove one pair of surrounding single quotes."""
    s = py_strip(c)
    return F.when(s.startswith("'") & s.endswith("'"), F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)


def header_name(stripped: Column, keyword: str) -> Column:
    """struct(name, remainder) after a keyword; quoted names end at the next quote."""
    lower_kw = keyword.lower()
    starts = F.lower(stripped).startswith(lower_kw)
    text = py_strip(_tail(stripped, len(keyword) + 1))
    quoted_name = F.regexp_extract(text, r"^'([^']*)'", 1)
    quoted_rest = py_strip(F.regexp_extract(text, r"^'[^']*'(.*)$", 1))
    plain_name = F.regexp_extract(text, r"^(\S+)", 1)
    plain_rest = py_strip(F.regexp_extract(text, r"^\S+(.*)$", 1))
    is_q = text.startswith("'")
    name = F.when(is_q, quoted_name).when(plain_name != "", plain_name).otherwise(text)
    rest = F.when(is_q, quoted_rest).when(plain_name != "", plain_rest).otherwise(F.lit(""))
    return F.struct(F.when(starts, name).otherwise(stripped).alias("name"),
                    F.when(starts, rest).otherwise(F.lit("")).alias("remainder"))


def _prop_value(stripped: Column) -> Column:
    return py_strip(F.regexp_extract(stripped, r"^[^:]*:(.*)$", 1))


def _format_value(stripped: Column, prop: str) -> Column:
    v = F.regexp_extract(stripped, "^" + prop.replace(":", r"\:") + "(.*)$", 1)
    v = py_strip(v)
    return F.when(v.startswith('"') & v.endswith('"') & (F.length(v) >= 2),
                  F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


# ------------------------------------------------------------------ annotation

def _table_opener() -> Column:
    """Lines of a table file whose expression may follow in a fence: measures, calculated columns, sources, items."""
    s, i = F.col("stripped"), F.col("indent")
    calculated = header_name(s, "column")["remainder"].startswith("=")
    return ((i == 1) & (s.startswith("measure ") | (s.startswith("column ") & calculated))) \
        | ((i >= 2) & s.rlike(r"^source\s*=")) | ((i >= 3) & s.startswith("expression") & s.contains("="))


def _shared_opener() -> Column:
    return (F.col("indent") <= 1) & F.col("stripped").startswith("expression ")


def annotate(lines: DataFrame, keys, opener: Column | None = None) -> DataFrame:
    """Add indent, stripped text and fence state per line.

    ``is_fence`` marks lines that open or close a fence, ``in_fence`` lines
    after an opening one up to and including its close.
    """
    w = Window.partitionBy(*keys).orderBy("line_no")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    df = lines.withColumn("indent", indent_level(F.col("line"))).withColumn("stripped", py_strip(F.col("line")))
    if opener is None:
        return df.withColumn("is_fence", F.lit(False)).withColumn("in_fence", F.lit(False))
    fence = F.col("stripped") == FENCE
    df = (df.withColumn("_mark", fence)
          .withColumn("_after", fence & F.coalesce(F.lag(opener).over(w), F.lit(False)))
          .withColumn("_run", F.sum(F.col("_after").cast("int")).over(upto))
          .withColumn("_base", F.last(F.when(F.col("_mark") & ~F.col("_after"), F.col("_run")), ignorenulls=True).over(upto))
          .withColumn("_opens", F.col("_after") & ((F.col("_run") - F.coalesce("_base", F.lit(0))) % 2 == 1))
          .withColumn("in_fence", F.coalesce(F.last(F.when(F.col("_mark"), F.col("_opens")), ignorenulls=True).over(before), F.lit(False)))
          .withColumn("is_fence", F.col("_opens") | (F.col("_mark") & F.col("in_fence"))))
    return df.drop("_mark", "_after", "_run", "_base", "_opens")


def _expression_regions(df: DataFrame, keys, opener: Column, k_col: Column, inline: Column) -> DataFrame:
    """Per opener line, mark inline/continuation/fenced expression lines.

    Adds ``expr_id`` (the opener's line_no) and ``expr_text`` for lines that
    belong to an expression, plus ``in_expr`` for every line of a region
    (fence delimiters included).
    """
    w = Window.partitionBy(*keys).orderBy("line_no")
    after1 = _following(keys, 1)
    after2 = _following(keys, 2)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = (df.withColumn("_open", opener)
          .withColumn("_k", k_col)
          .withColumn("_inline", inline)
          .withColumn("_next_fence", F.coalesce(F.lead("is_fence", 1).over(w), F.lit(False)))
          .withColumn("_close", F.min(F.when(F.col("is_fence"), F.col("line_no"))).over(after2))
          .withColumn("_lt3", F.min(F.when(F.col("indent") < 3, F.col("line_no"))).over(after1))
          .withColumn("_lt4", F.min(F.when(F.col("indent") < 4, F.col("line_no"))).over(after1))
          .withColumn("_lt2", F.min(F.when(F.col("indent") < 2, F.col("line_no"))).over(after1)))
    cont_end = (F.when(F.col("_k") == 4, F.col("_lt4")).when(F.col("_k") == 2, F.col("_lt2"))
                .otherwise(F.col("_lt3")))
    last = F.when(F.col("_next_fence"), F.coalesce(F.col("_close"), F.lit(BIG))).otherwise(
        F.coalesce(cont_end, F.lit(BIG)) - 1)
    df = (df.withColumn("_last", F.when(F.col("_open"), last))
          .withColumn("expr_id", F.last(F.when(F.col("_open"), F.col("line_no")), ignorenulls=True).over(upto))
          .withColumn("_elast", F.last(F.col("_last"), ignorenulls=True).over(upto))
          .withColumn("_efenced", F.last(F.when(F.col("_open"), F.col("_next_fence")), ignorenulls=True).over(upto)))
    in_region = (F.col("line_no") > F.col("expr_id")) & (F.col("line_no") <= F.col("_elast"))
    delimiter = F.col("_efenced") & ((F.col("line_no") == F.col("expr_id") + 1)
                                     | ((F.col("line_no") == F.col("_elast")) & F.col("is_fence")))
    return (df.withColumn("in_expr", F.coalesce(in_region, F.lit(False)))
            .withColumn("expr_text",
                        F.when(F.col("_open") & (F.col("_inline") != ""), F.col("_inline"))
                        .when(F.col("in_expr") & ~delimiter, F.col("line"))))


def collect_expressions(df: DataFrame, keys) -> DataFrame:
    """(keys..., expr_id, expression): join region lines, dedent by the smallest tab count, strip."""
    lines = df.where(F.col("expr_text").isNotNull())
    return (lines.groupBy(*keys, "expr_id")
            .agg(F.collect_list(F.struct(F.lit(0).alias("o"), F.col("line_no"), F.col("expr_text").alias("t"))).alias("ls"))
            .select(*keys, "expr_id", _dedent_join(F.col("ls")).alias("expression")))


# ------------------------------------------------------------------ table files

_TABLE_KINDS = (("column", "column "), ("measure", "measure "), ("partition", "partition "), ("hierarchy", "hierarchy "))


def table_blocks(lines: DataFrame, keys) -> DataFrame:
    """Annotated table-file lines with block id, block kind, block end and expression regions."""
    df = annotate(lines, keys, _table_opener())
    w = Window.partitionBy(*keys).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    after1 = _following(keys, 1)
    free = (F.col("indent") == 1) & ~F.col("in_fence") & ~F.col("is_fence") & (F.col("line_no") > 0)
    kind = None
    for name, prefix in _TABLE_KINDS:
        cond = free & F.col("stripped").startswith(prefix)
        kind = F.when(cond, F.lit(name)) if kind is None else kind.when(cond, F.lit(name))
    kind = kind.when(free & (F.col("stripped") == "calculationGroup"), F.lit("calculationGroup"))
    is_term = ~F.col("in_fence") & ~F.col("is_fence") & (F.col("indent") < 2)
    df = (df.withColumn("kind", kind)
          .withColumn("_next_term", F.min(F.when(is_term, F.col("line_no"))).over(after1))
          .withColumn("block_id", F.last(F.when(F.col("kind").isNotNull(), F.col("line_no")), ignorenulls=True).over(upto))
          .withColumn("block_kind", F.last(F.col("kind"), ignorenulls=True).over(upto))
          .withColumn("block_end", F.last(F.when(F.col("kind").isNotNull(), F.coalesce(F.col("_next_term"), F.lit(BIG))),
                                          ignorenulls=True).over(upto)))
    df = df.withColumn("in_block", F.col("block_id").isNotNull() & (F.col("line_no") < F.col("block_end")))

    # calculation items: headers at indent 2 inside a calculationGroup block
    item_hdr = (F.col("in_block") & (F.col("block_kind") == "calculationGroup") & (F.col("indent") == 2)
                & ~F.col("in_fence") & F.col("stripped").startswith("calculationItem "))
    item_term = ~F.col("in_fence") & ~F.col("is_fence") & (F.col("indent") < 3)
    df = (df.withColumn("is_item", item_hdr)
          .withColumn("_item_end0", F.when(item_hdr, F.coalesce(F.min(F.when(item_term, F.col("line_no"))).over(after1), F.lit(BIG))))
          .withColumn("item_id", F.last(F.when(item_hdr, F.col("line_no")), ignorenulls=True).over(upto))
          .withColumn("_item_end", F.last(F.col("_item_end0"), ignorenulls=True).over(upto)))
    df = df.withColumn("in_item", F.col("in_block") & (F.col("block_kind") == "calculationGroup")
                       & F.col("item_id").isNotNull() & (F.col("item_id") >= F.col("block_id"))
                       & (F.col("line_no") < F.col("_item_end")))

    # expression openers
    s = F.col("stripped")
    measure_hdr = F.col("kind") == "measure"
    col_hdr = F.col("kind") == "column"
    col_parts = header_name(s, "column")
    col_calc = col_hdr & col_parts["remainder"].startswith("=")
    source_line = (F.col("in_block") & (F.col("block_kind") == "partition") & (F.col("line_no") > F.col("block_id"))
                   & (F.col("indent") >= 2) & ~F.col("in_fence") & ~F.col("is_fence") & s.rlike(r"^source\s*="))
    item_expr = (F.col("in_item") & ~F.col("is_item") & (F.col("indent") >= 3) & ~F.col("in_fence")
                 & ~F.col("is_fence") & s.startswith("expression") & s.contains("="))
    opener = F.coalesce(measure_hdr | col_calc | source_line | item_expr, F.lit(False))
    k = F.when(item_expr, F.lit(CONT_INDENT_ITEM)).otherwise(F.lit(CONT_INDENT_TABLE))
    inline = (F.when(measure_hdr, _measure_header(s)["remainder"])
              .when(col_calc, py_strip(_tail(col_parts["remainder"], 2)))
              .when(source_line | item_expr, py_strip(F.regexp_extract(s, r"^[^=]*=(.*)$", 1)))
              .otherwise(F.lit("")))
    return _expression_regions(df, keys, opener, k, inline)


def _measure_header(stripped: Column) -> Column:
    """struct(name, remainder) of a measure header: quoted name, else the text before '='."""
    ak = py_strip(_tail(stripped, len("measure ") + 1))
    q_name = F.regexp_extract(ak, r"^'([^']*)'", 1)
    q_rest = py_strip(F.regexp_extract(ak, r"^'[^']*'(.*)$", 1))
    has_eq = ak.contains("=")
    p_name = F.when(has_eq, py_strip(F.substring_index(ak, "=", 1))).otherwise(ak)
    p_rest = F.when(has_eq, py_strip(F.regexp_extract(ak, r"^[^=]*(=.*)$", 1))).otherwise(F.lit(""))
    is_q = ak.startswith("'")
    name = F.when(is_q, q_name).otherwise(p_name)
    rest = F.when(is_q, q_rest).otherwise(p_rest)
    rest = F.when(rest.startswith("="), py_strip(_tail(rest, 2))).otherwise(rest)
    return F.struct(name.alias("name"), rest.alias("remainder"))


def _last(cond: Column, value: Column) -> Column:
    """Aggregate: the value on the last (highest line_no) row where ``cond`` holds."""
    return F.max_by(F.when(cond, value), F.when(cond, F.col("line_no")))


def _first(cond: Column, value: Column) -> Column:
    """Aggregate: the value on the row where ``cond`` holds (at most one such row per group)."""
    return F.max(F.when(cond, value))


def _lines_of(cond: Column, text: Column, order: Column | None = None) -> Column:
    """Aggregate: (order, line_no, text) structs of the rows where ``cond`` holds (collect skips nulls)."""
    o = order if order is not None else F.lit(0)
    return F.collect_list(F.when(cond, F.struct(o.alias("o"), F.col("line_no").alias("line_no"), text.alias("t"))))


def _dedent_join(ls: Column) -> Column:
    """T3 on collected lines: sort, dedent by the smallest tab count of non-blank lines, join, strip."""
    def body(a):
        nonblank = F.filter(a, lambda s: py_strip(s["t"]) != "")
        m = F.coalesce(F.array_min(F.transform(nonblank, lambda s: indent_level(s["t"]))), F.lit(0))
        return let(m, lambda mm: py_strip(F.array_join(F.transform(
            a, lambda s: F.when(F.length(s["t"]) >= mm, F.substring(s["t"], mm + 1, F.length(s["t"]))).otherwise(s["t"])), "\n")))
    return let(F.array_sort(ls), body)


def _last_group(ls: Column) -> Column:
    """Keep the lines of the last expression (highest opener ``o``) among collected lines."""
    return let(ls, lambda a: F.filter(a, lambda s: s["o"] == F.array_max(F.transform(a, lambda x: x["o"]))))


def table_names(lines: DataFrame, keys, file_col: str = "file") -> DataFrame:
    """Table name from the first line's header."""
    return lines.where(F.col("line_no") == 0).select(
        *keys, header_name(py_strip(F.col("line")), "table")["name"].alias("table_name"))


def table_names_of_files(files: DataFrame, keys, file_col: str = "file", text_col: str = "value") -> DataFrame:
    """T11 on whole files: the first line's header name; a file without lines is named by its stem."""
    first = F.try_element_at(split_lines(F.col(text_col)), F.lit(1))
    stem = F.regexp_extract(F.element_at(F.split(F.col(file_col), "/"), -1), r"^(.*?)(\.[^.]*)?$", 1)
    return files.select(*keys, F.when(first.isNull(), stem)
                        .otherwise(header_name(py_strip(first), "table")["name"]).alias("table_name"))


def _block_lines(blocks: DataFrame, kind: str) -> DataFrame:
    return blocks.where(F.col("in_block") & (F.col("block_kind") == kind))


def _hdr() -> Column:
    return F.col("line_no") == F.col("block_id")


def _prop_line() -> Column:
    return (F.col("line_no") > F.col("block_id")) & ~F.col("in_expr") & (F.col("indent") >= 2)


def _own_expr() -> Column:
    return F.col("expr_text").isNotNull() & (F.col("expr_id") == F.col("block_id"))


# Each block kind below is one aggregation per block over the windowed lines:
# the window pipeline runs once, and the aggregate is partial + final.

def columns(blocks: DataFrame, keys) -> DataFrame:
    """T4: columns with calculated flag, expression and six properties."""
    b = _block_lines(blocks, "column")
    s, p = F.col("stripped"), _prop_line()
    h = header_name(s, "column")
    agg = b.groupBy(*keys, "block_id").agg(
        _first(_hdr(), h["name"]).alias("column_name"),
        _first(_hdr(), h["remainder"].startswith("=")).alias("is_calculated"),
        _lines_of(_own_expr(), F.col("expr_text")).alias("ls"),
        _last(p & s.startswith("dataType:"), _prop_value(s)).alias("data_type"),
        _last(p & s.startswith("sourceColumn:"), unquote(_prop_value(s))).alias("source_column"),
        _last(p & s.startswith("sortByColumn:"), unquote(_prop_value(s))).alias("sort_by_column"),
        _last(p & s.startswith("formatString:"), _format_value(s, "formatString:")).alias("format_string"),
        _last(p & s.startswith("isKey:"), F.lower(_prop_value(s)) == "true").alias("is_key"),
        _last(p & s.startswith("summarizeBy:"), _prop_value(s)).alias("summarize_by"))
    return agg.select(*keys, "block_id", "column_name", "is_calculated",
                      F.when(F.col("is_calculated"), _dedent_join(F.col("ls"))).alias("expression"),
                      F.coalesce("data_type", F.lit("")).alias("data_type"), "source_column", "sort_by_column",
                      "format_string", F.coalesce("is_key", F.lit(False)).alias("is_key"), "summarize_by")


def measures(blocks: DataFrame, keys) -> DataFrame:
    """T5: measures with expression and formatString."""
    b = _block_lines(blocks, "measure")
    s = F.col("stripped")
    agg = b.groupBy(*keys, "block_id").agg(
        _first(_hdr(), _measure_header(s)["name"]).alias("name"),
        _lines_of(_own_expr(), F.col("expr_text")).alias("ls"),
        _last(_prop_line() & s.startswith("formatString:"), _format_value(s, "formatString:")).alias("format_string"))
    return agg.select(*keys, "block_id", "name", _dedent_join(F.col("ls")).alias("expression"), "format_string")


def partitions(blocks: DataFrame, keys) -> DataFrame:
    """Partitions: name, type, mode (default import), source; a 'calculated' type routes text to dax_expression.

    The last ``source =`` property of a block wins.
    """
    b = _block_lines(blocks, "partition")
    s = F.col("stripped")
    ak = py_strip(_tail(s, len("partition ") + 1))
    src_line = F.col("expr_text").isNotNull() & (F.col("expr_id") > F.col("block_id"))
    agg = b.groupBy(*keys, "block_id").agg(
        _first(_hdr() & ak.contains("="), unquote(F.substring_index(ak, "=", 1))).alias("partition_name"),
        _first(_hdr() & ak.contains("="), F.lower(py_strip(F.regexp_extract(ak, r"^[^=]*=(.*)$", 1)))).alias("partition_type"),
        _last(_prop_line() & s.startswith("mode:"), _prop_value(s)).alias("mode"),
        _lines_of(src_line, F.col("expr_text"), F.col("expr_id")).alias("ls"))
    is_calc = F.col("partition_type").startswith("calculated")
    text = _dedent_join(_last_group(F.col("ls")))
    return (agg.where(F.col("partition_name").isNotNull())
            .select(*keys, "block_id", "partition_name", "partition_type",
                    F.coalesce("mode", F.lit("import")).alias("mode"), is_calc.alias("is_calculated"),
                    F.when(is_calc, F.lit("")).otherwise(text).alias("source_code"),
                    F.when(is_calc, text).alias("dax_expression")))


def calculation_items(blocks: DataFrame, keys) -> DataFrame:
    """Calculation items with expression and ordinal (default 0), ranked by (ordinal, file order).

    The group's ``column:`` property is a whole-block window aggregate; items
    are one aggregation per item; the rank is a window over the item rows.
    """
    b = _block_lines(blocks, "calculationGroup")
    s = F.col("stripped")
    col_prop = ~F.col("in_item") & (F.col("line_no") > F.col("block_id")) & s.startswith("column:")
    b = b.withColumn("group_column", F.max_by(F.when(col_prop, unquote(_prop_value(s))), F.when(col_prop, F.col("line_no")))
                     .over(Window.partitionBy(*keys, "block_id")))
    it = b.where(F.col("in_item"))
    ordv = py_strip(F.regexp_extract(s, r"^[^=]*=(.*)$", 1)).try_cast("int")
    prop = ~F.col("is_item") & ~F.col("in_expr") & (F.col("indent") >= 3)
    expr_line = F.col("expr_text").isNotNull() & (F.col("expr_id") > F.col("item_id"))
    agg = it.groupBy(*keys, "block_id", "item_id").agg(
        F.max("group_column").alias("group_column"),
        _first(F.col("is_item"), header_name(s, "calculationItem")["name"]).alias("item_name"),
        _last(prop & s.startswith("ordinal") & s.contains("="), ordv).alias("ordinal"),
        _lines_of(expr_line, F.col("expr_text"), F.col("expr_id")).alias("ls"))
    out = agg.select(*keys, "block_id", "item_id", "group_column", "item_name",
                     _dedent_join(_last_group(F.col("ls"))).alias("expression"),
                     F.coalesce("ordinal", F.lit(0)).alias("ordinal"))
    # the items of one block of one file: a bounded group
    return out.withColumn("item_rank", F.row_number().over(Window.partitionBy(*keys, "block_id").orderBy("ordinal", "item_id")))


def hierarchy_levels(blocks: DataFrame, keys) -> DataFrame:
    """Hierarchy levels with their column, numbered in file order (a running count of level headers)."""
    b = _block_lines(blocks, "hierarchy")
    w = Window.partitionBy(*keys).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("stripped")
    is_level = (F.col("line_no") > F.col("block_id")) & (F.col("indent") == 2) & s.startswith("level ")
    block = Window.partitionBy(*keys, "block_id")
    b = (b.withColumn("is_level", is_level)
         .withColumn("_lend", F.when(is_level, F.coalesce(F.min(F.when(F.col("indent") < 3, F.col("line_no")))
                                                           .over(_following(keys, 1)), F.lit(BIG))))
         .withColumn("level_id", F.last(F.when(is_level, F.col("line_no")), ignorenulls=True).over(upto))
         .withColumn("level_end", F.last("_lend", ignorenulls=True).over(upto))
         .withColumn("level_no", F.sum(is_level.cast("int")).over(block.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("hierarchy", F.max(F.when(_hdr(), header_name(s, "hierarchy")["name"])).over(block)))
    lv = b.where(F.col("level_id") > F.col("block_id"))
    in_props = (F.col("line_no") > F.col("level_id")) & (F.col("line_no") < F.col("level_end"))
    return (lv.groupBy(*keys, "block_id", "level_id")
            .agg(F.max("hierarchy").alias("hierarchy"),
                 _first(F.col("is_level"), F.col("level_no")).alias("level_no"),
                 _first(F.col("is_level"), header_name(s, "level")["name"]).alias("level"),
                 _last(in_props & s.startswith("column:"), unquote(_prop_value(s))).alias("level_column"))
            .select(*keys, "hierarchy", F.col("level_no").cast("int").alias("level_no"), "level", "level_column"))


# ------------------------------------------------------------------ relationships

REL_REF = r"^\s*('(?:[^']|'')*'|[^.]*)\.(.*)$"


def _split_ref(ref: Column) -> Column:
    """Table and column of 'T'.'C' / T.C split at the first dot outside quotes."""
    t = F.regexp_extract(ref, REL_REF, 1)
    c = F.regexp_extract(ref, REL_REF, 2)
    fix = lambda x: F.replace(unquote(x), F.lit("''"), F.lit("'"))
    return F.struct(fix(t).alias("table"), fix(c).alias("column"))


def relationships(lines: DataFrame, keys) -> DataFrame:
    """Relationship blocks; cross filter 'Both' when the value holds 'both'; cardinality lower-cased."""
    df = annotate(lines, keys)
    w = Window.partitionBy(*keys).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("stripped")
    hdr = (F.col("indent") == 0) & s.startswith("relationship ")
    df = (df.withColumn("is_rel", hdr)
          .withColumn("_end", F.when(hdr, F.coalesce(F.min(F.when(F.col("indent") < 1, F.col("line_no")))
                                                     .over(_following(keys, 1)), F.lit(BIG))))
          .withColumn("rel_id", F.last(F.when(hdr, F.col("line_no")), ignorenulls=True).over(upto))
          .withColumn("rel_end", F.last("_end", ignorenulls=True).over(upto)))
    r = df.where(F.col("rel_id").isNotNull() & (F.col("line_no") < F.col("rel_end")))
    v = _prop_value(s)
    p = F.col("line_no") > F.col("rel_id")
    agg = r.groupBy(*keys, "rel_id").agg(
        _first(F.col("is_rel"), py_strip(_tail(s, 14))).alias("rel_name"),
        _last(p & s.startswith("fromColumn:"), v).alias("from_ref"),
        _last(p & s.startswith("toColumn:"), v).alias("to_ref"),
        _last(p & s.startswith("crossFilteringBehavior:"), F.lower(v)).alias("cf"),
        _last(p & s.startswith("toCardinality:"), F.lower(v)).alias("to_card"),
        _last(p & s.startswith("fromCardinality:"), F.lower(v)).alias("from_card"))
    fr, to = _split_ref(F.col("from_ref")), _split_ref(F.col("to_ref"))
    return agg.select(
        *keys, "rel_id", "rel_name",
        F.coalesce(fr["table"], F.lit("")).alias("from_table"), F.coalesce(fr["column"], F.lit("")).alias("from_column"),
        F.coalesce(to["table"], F.lit("")).alias("to_table"), F.coalesce(to["column"], F.lit("")).alias("to_column"),
        F.when(F.coalesce(F.col("cf"), F.lit("")).contains("both"), F.lit("Both")).otherwise(F.lit("Single")).alias("cross_filter"),
        F.coalesce(F.col("from_card"), F.lit("many")).alias("from_cardinality"),
        F.coalesce(F.col("to_card"), F.lit("one")).alias("to_cardinality"))


# ------------------------------------------------------------------ shared expressions

META_RECORD = r"(?s)\bmeta\s*\[(.*)\]"
META_ENTRY = r"([A-Za-z]\w*)\s*=\s*(\{[^}]*\}|\"[^\"]*\"|[^,\]\s][^,\]]*)"


def _meta_value(record: Column, key: str) -> Column:
    """Value text of a key of a ``key = value, ...`` record, or null."""
    keys = F.regexp_extract_all(record, F.lit(META_ENTRY), 1)
    values = F.regexp_extract_all(record, F.lit(META_ENTRY), 2)
    at = F.array_position(keys, F.lit(key))
    return F.when(at > 0, py_strip(F.element_at(values, at.cast("int"))))


def _strip_chars(c: Column, ch: str) -> Column:
    return F.regexp_replace(c, f"^{ch}+|{ch}+$", "")


def shared_expressions(lines: DataFrame, keys) -> DataFrame:
    """Parameters (IsParameterQuery=true) with default, type, required, allowed list; else helper functions."""
    df = annotate(lines, keys, _shared_opener())
    w = Window.partitionBy(*keys).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("stripped")
    hdr = (F.col("indent") <= 1) & ~F.col("in_fence") & ~F.col("is_fence") & s.startswith("expression ")
    end_line = (hdr | (F.col("indent") == 0)) & ~F.col("in_fence") & ~F.col("is_fence")
    df = (df.withColumn("is_hdr", hdr)
          .withColumn("_end", F.when(hdr, F.coalesce(F.min(F.when(end_line, F.col("line_no"))).over(_following(keys, 1)),
                                                     F.lit(BIG))))
          .withColumn("ex_id", F.last(F.when(hdr, F.col("line_no")), ignorenulls=True).over(upto))
          .withColumn("ex_end", F.last("_end", ignorenulls=True).over(upto)))
    parts = header_name(s, "expression")
    df = _expression_regions(df, keys, F.coalesce(hdr, F.lit(False)), F.lit(CONT_INDENT_SHARED),
                             F.when(hdr, parts["remainder"]).otherwise(F.lit("")))
    e = df.where(F.col("ex_id").isNotNull() & (F.col("line_no") < F.col("ex_end")))
    meta_line = (F.col("line_no") > F.col("ex_id")) & ~F.col("in_expr") & (F.col("indent") >= 1)
    agg = e.groupBy(*keys, "ex_id").agg(
        _first(F.col("is_hdr"), parts["name"]).alias("name"),
        _lines_of(F.col("expr_text").isNotNull() & (F.col("expr_id") == F.col("ex_id")), F.col("expr_text")).alias("ls"),
        _lines_of(meta_line, s).alias("meta"))
    body = _dedent_join(F.col("ls"))
    meta_text = F.array_join(F.transform(F.array_sort(F.col("meta")), lambda x: x["t"]), " ")
    agg = agg.select(*keys, "ex_id", "name", body.alias("body"), meta_text.alias("meta_text"))
    body = F.col("body")
    combined = F.concat(body, F.lit(" "), F.col("meta_text"))
    is_param = combined.contains("IsParameterQuery=true") | combined.contains("IsParameterQuery = true")
    # the default value stands between the equals sign and the meta record
    before_meta = F.split(F.substring(body, F.instr(body, "=") + F.lit(1), F.length(body)), r"\s+meta\s+", 2)[0]
    default = F.when(F.instr(body, "=") > 0, _strip_chars(_strip_chars(py_strip(before_meta), '"'), "'")).otherwise(F.lit(""))
    record = F.regexp_extract(combined, META_RECORD, 1)
    quoted = _meta_value(record, "Type")
    ptype = F.coalesce(F.when(quoted.startswith('"'), _strip_chars(quoted, '"'))
                       .when(quoted.startswith("type "), F.regexp_extract(quoted, r"^type\s+(\w+)", 1)), F.lit(""))
    required = combined.contains("IsParameterQueryRequired=true") | combined.contains("IsParameterQueryRequired = true")
    raw_list = _meta_value(record, "List")
    allowed = F.when(raw_list.startswith("{"), F.transform(
        F.filter(F.split(F.regexp_replace(raw_list, r"^\{|\}$", ""), ","), lambda v: py_strip(v) != ""),
        lambda v: _strip_chars(_strip_chars(py_strip(v), '"'), "'"))).otherwise(F.array().cast("array<string>"))
    code = F.when(body.startswith("="), py_strip(_tail(body, 2))).otherwise(body)
    return agg.select(*keys, "ex_id", "name",
                      F.when(is_param, F.lit("parameter")).otherwise(F.lit("function")).alias("kind"),
                      F.when(is_param, default).alias("default_value"),
                      F.when(is_param, ptype).alias("param_type"),
                      F.when(is_param, required).alias("is_required"),
                      F.when(is_param, allowed).alias("allowed_values"),
                      F.when(~is_param, code).alias("code"))


# ------------------------------------------------------------------ P25, P26

STEP_HEADER = r"^\s*(?:#\"([^\"]+)\"|([A-Za-z_][A-Za-z0-9_]*))\s*=(.*)$"
BINARY_STEP_MARKER = "[binary payload omitted]"


def split_query_steps(df: DataFrame, keys, code_col: str = "expression") -> DataFrame:
    """P25: ordered (step_no, step, expression) of an M query; text without 'let' yields none.

    A line job: a line ``name = ...`` starts a step, a line that starts with
    ``in`` ends the list until the next step; a step's lines are joined again.
    """
    c = F.col(code_col)
    rows = df.where(c.isNotNull() & F.lower(c).contains("let")).select(*keys, F.posexplode(F.split(c, "\n")).alias("line_no", "line"))
    upto = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header, stop = F.col("line").rlike(STEP_HEADER), F.col("line").rlike(r"^\s*in\b")
    rows = (rows.withColumn("is_header", header)
            .withColumn("step_no", F.sum(F.col("is_header").cast("int")).over(upto))
            .withColumn("open", F.last(F.when(F.col("is_header"), True).when(stop, False), ignorenulls=True).over(upto)))
    name = F.when(F.col("is_header"), F.coalesce(F.nullif(F.regexp_extract("line", STEP_HEADER, 1), F.lit("")),
                                                 F.regexp_extract("line", STEP_HEADER, 2)))
    text = F.when(F.col("is_header"), F.regexp_extract("line", STEP_HEADER, 3)).otherwise(F.col("line"))
    steps = rows.where("open").groupBy(*keys, "step_no").agg(
        F.max(name).alias("step"), F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))).alias("ls"))
    expr = F.regexp_replace(py_strip(F.array_join(F.transform("ls", lambda x: x["t"]), "\n")), ",+$", "")
    steps = steps.select(*keys, "step_no", "step", expr.alias("step_expression")).where("step_expression <> ''")
    return steps.withColumn("display", F.when(is_binary_payload(F.col("step_expression")), F.lit(BINARY_STEP_MARKER))
                            .otherwise(F.col("step_expression")))


def _bodies(html: Column, tag: str) -> Column:
    """Texts between the opening and closing tags of one kind."""
    return F.regexp_extract_all(html, F.lit(f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>"), 1)


def audit_embedded_blocks(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """script/style bodies; a body holding '{{' or '}}' is flagged; ``skipped`` marks a diagram library."""
    parts = [pages.select("page_id", F.lit(tag).alias("tag"), F.posexplode(_bodies(F.col(html_col), tag)).alias("pos", "body"))
             for tag in ("script", "style")]
    out = parts[0].unionByName(parts[1]).select("page_id", "tag", (F.col("pos") + 1).alias("block_no"), "body")
    body = F.col("body")
    skipped = body.contains("mermaidAPI")
    return out.select("page_id", "tag", F.col("block_no").cast("long").alias("block_no"),
                      F.length(body).cast("long").alias("n_chars"), skipped.alias("skipped"),
                      (body.contains("{{") | body.contains("}}")).alias("double_brace"))
