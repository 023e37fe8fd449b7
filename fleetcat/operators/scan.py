"""Segmented scan of definition lines: one large file is parsed by many tasks.

The windows of ``segment`` read a file in one task.  Here a file is cut where
its parse state is empty, so that every piece can be parsed on its own by the
same operators, with the piece's number as a further key:

1. Lines fall into segments of ``SEGMENT_LINES`` by line number.  Inside a
   segment the fence state is known up to the state that enters it: a fence
   line after an expression opener toggles it, any other fence line closes it.
   So a segment is a function of one bit (parity since its last reset, or of
   the entering bit), and these functions compose associatively.  One
   aggregate per segment keeps both: the bit that leaves, and the last block
   header under either entering bit.
2. One row per segment, in order: running parity and resets give the bit that
   enters each segment, and with it the last header of the segments before.
3. Every line learns the header of its block.  Blocks that begin in the same
   ``PIECE_LINES`` lines are one piece.

A header outside fences ends what came before it (block, expression, fence),
so pieces give the rows that the whole file gives.  What meets in one task is a
segment, or a piece of whole blocks; a block's text is one value of its result.
The one-row-per-segment table is the only thing ordered per file: a file of
2^40 lines has 2^24 of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetcat.functions.common import py_strip
from fleetcat.operators import segment as seg

SEGMENT_LINES = 1 << 16
PIECE_LINES = 1 << 16


def _table_header() -> Column:
    s = F.col("stripped")
    starts = [s.startswith(prefix) for _, prefix in seg._TABLE_KINDS]
    any_kind = starts[0]
    for c in starts[1:]:
        any_kind = any_kind | c
    return (F.col("indent") == 1) & (F.col("line_no") > 0) & (any_kind | (s == "calculationGroup"))


def _relationship_header() -> Column:
    return (F.col("indent") == 0) & F.col("stripped").startswith("relationship ")


def _shared_header() -> Column:
    return (F.col("indent") <= 1) & F.col("stripped").startswith("expression ")


# kind of file -> (lines that a fence may follow, header of a block if outside fences)
FILE_KINDS = {"table": (seg._table_opener, _table_header), "relationships": (None, _relationship_header),
              "expressions": (seg._shared_opener, _shared_header)}


def with_pieces(lines: DataFrame, keys, kind: str, segment_lines: int = SEGMENT_LINES, piece_lines: int = PIECE_LINES) -> DataFrame:
    """``lines`` (keys..., line_no, line) with ``piece``: the part of its file that a line is parsed with.

    Line numbers are unique in a file, without gaps.
    """
    opener, header = FILE_KINDS[kind]
    keys = list(keys)
    own = lines.select(*keys, F.col("line_no").cast("long").alias("line_no"), "line")
    # the last line of a segment also stands before the next one, for "the line before"
    at = F.floor(F.col("line_no") / segment_lines)
    copies = F.when((F.col("line_no") + 1) % segment_lines == 0, F.array(at, at + 1)).otherwise(F.array(at))
    df = own.withColumn("_seg", F.explode(copies)).withColumn("_ghost", F.col("_seg") != at)
    df = df.withColumn("indent", seg.indent_level(F.col("line"))).withColumn("stripped", py_strip(F.col("line")))
    inside = Window.partitionBy(*keys, "_seg").orderBy("line_no")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    mark = (F.col("stripped") == seg.FENCE) & ~F.col("_ghost")
    toggles = mark & F.coalesce(F.lag(opener()).over(inside), F.lit(False)) if opener is not None else F.lit(False)
    df = (df.withColumn("_mark", mark if opener is not None else F.lit(False)).withColumn("_toggle", toggles)
          .withColumn("_run", F.sum(F.col("_toggle").cast("int")).over(upto))
          .withColumn("_base", F.last(F.when(F.col("_mark") & ~F.col("_toggle"), F.col("_run")), ignorenulls=True).over(upto)))
    # the bit after a line: parity since the last reset, else parity since the start plus the entering bit
    df = (df.withColumn("_bit", (F.col("_run") - F.coalesce("_base", F.lit(0))) % 2)
          .withColumn("_fixed", F.col("_base").isNotNull())
          .withColumn("_bit_before", F.coalesce(F.last("_bit").over(before), F.lit(0)))
          .withColumn("_fixed_before", F.coalesce(F.last("_fixed").over(before), F.lit(False))))
    is_header = header() & ~F.col("_ghost") & ~F.col("_mark")
    for enters in (0, 1):
        bit = F.when(F.col("_fixed_before"), F.col("_bit_before")).otherwise((F.col("_bit_before") + enters) % 2)
        df = df.withColumn(f"_head{enters}", F.when(is_header & (bit == 0), F.col("line_no")))
    ends = df.groupBy(*keys, "_seg").agg(
        F.max("_head0").alias("h0"), F.max("_head1").alias("h1"),
        F.max_by(F.struct(F.col("_bit").alias("bit"), F.col("_fixed").alias("fixed")), "line_no").alias("out"))
    order = Window.partitionBy(*keys).orderBy("_seg")  # one row per segment
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # segments that do not reset add their parity; one that resets starts the sum anew
    ends = ends.withColumn("sum", F.sum(F.when(~F.col("out.fixed"), F.col("out.bit")).otherwise(0)).over(so_far)) \
        .withColumn("since", F.last(F.when(F.col("out.fixed"), F.struct(F.col("sum").alias("sum"), F.col("out.bit").alias("bit"))), ignorenulls=True).over(so_far)) \
        .withColumn("leaves", (F.col("sum") - F.coalesce("since.sum", F.lit(0)) + F.coalesce("since.bit", F.lit(0))) % 2) \
        .withColumn("_enters", F.coalesce(F.lag("leaves").over(order), F.lit(0)))
    ends = ends.withColumn("h", F.when(F.col("_enters") == 0, F.col("h0")).otherwise(F.col("h1"))) \
        .withColumn("_carried", F.last("h", ignorenulls=True).over(earlier)).select(*keys, "_seg", "_enters", "_carried")
    df = df.where(~F.col("_ghost")).join(ends, [*keys, "_seg"])
    head = F.when(F.col("_enters") == 0, F.col("_head0")).otherwise(F.col("_head1"))
    block = F.coalesce(F.last(head, ignorenulls=True).over(upto), F.col("_carried"), F.lit(0))
    return df.withColumn("piece", F.floor(block / piece_lines)).select(*keys, "piece", "line_no", "line")


def parse_in_pieces(lines: DataFrame, keys, kind: str, parse: Callable[[DataFrame, list], DataFrame],
                    segment_lines: int = SEGMENT_LINES, piece_lines: int = PIECE_LINES) -> DataFrame:
    """The rows of ``parse(lines, keys)`` for files of any length.

    ``parse`` is an operator of ``segment`` over lines, such as
    ``relationships``, or one over ``table_blocks``.
    """
    return parse(with_pieces(lines, keys, kind, segment_lines, piece_lines), [*keys, "piece"]).drop("piece")


def of_blocks(parse: Callable[[DataFrame, list], DataFrame]) -> Callable[[DataFrame, list], DataFrame]:
    """An operator over ``table_blocks`` as one over lines."""
    return lambda lines, keys: parse(seg.table_blocks(lines, keys), keys)


def scan_large_files(spark: SparkSession, path: str) -> DataFrame:
    """S1 for files of any length: (file_path, line_no, line), each split of a file read by its own task.

    A line belongs to the split it begins in, so the place of a split in its
    file and the reading order inside it number all lines; only the number of
    lines per split is ordered per file.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_read"), F.col("value").alias("line"))
    per_split = rows.groupBy("file_path", "_start").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.select("file_path", "_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("file_path", "_start").orderBy("_read")) - 1
    numbered = rows.withColumn("_in_split", inside).join(offsets, ["file_path", "_start"])
    return numbered.select("file_path", (F.col("_offset") + F.col("_in_split")).cast("long").alias("line_no"), "line")
