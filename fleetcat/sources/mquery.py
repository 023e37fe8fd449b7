"""Shared M queries of a workbook's section document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcat.functions.common import py_strip

SHARED = "shared "
NAME_SEP = " = "


def split_shared_queries(docs: DataFrame, keys, text_col: str = "section") -> DataFrame:
    """(keys..., entry_no, table_name, expression) from 'shared Name = expr;' entries.

    Split on 'shared ' and drop the prefix; entries without ' = ' drop; the
    name is split off at the first ' = ', '#"..."' is unwrapped and one
    trailing ';' of the stripped expression is removed.
    """
    parts = F.split(F.col(text_col), SHARED)
    rows = docs.select(*keys, F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("entry_no", "p"))
    rows = rows.where(F.col("p").contains(NAME_SEP))
    name = py_strip(F.substring_index("p", NAME_SEP, 1))
    name = F.when(name.startswith('#"') & name.endswith('"') & (F.length(name) >= 3),
                  F.substring(name, F.lit(3), F.length(name) - 3)).otherwise(name)
    expr = py_strip(F.substring(F.col("p"), F.instr("p", NAME_SEP) + F.lit(len(NAME_SEP)), F.length("p")))
    expr = F.when(expr.endswith(";"), F.substring(expr, F.lit(1), F.length(expr) - 1)).otherwise(expr)
    return rows.select(*keys, (F.col("entry_no") + 1).alias("entry_no"), name.alias("table_name"), expr.alias("expression"))


def render_section_docs(partitions: DataFrame, per_doc: int = 4) -> DataFrame:
    """Section documents of ``per_doc`` shared queries each (fixture renderer); names quoted for even keys."""
    doc = F.floor(F.col("ordinal") / per_doc).cast("long")
    name = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit('#"'), F.col("table_name"), F.lit('"'))).otherwise(F.col("table_name"))
    entry = F.concat(F.lit(SHARED), name, F.lit(NAME_SEP), F.col("expression"), F.lit(";"))
    return (partitions.select("model_id", doc.alias("doc_id"), "ordinal", entry.alias("entry"))
            .groupBy("model_id", "doc_id")
            .agg(F.concat(F.lit("section Section1;\n\n"),
                          F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "entry"))),
                                                   lambda s: s["entry"]), "\n\n")).alias("section")))
