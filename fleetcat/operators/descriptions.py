"""Description lookup for objects referenced by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcat.functions.common import py_strip


def description_lookup(objects: DataFrame, table_col: str = "table_name", name_col: str = "name") -> DataFrame:
    """(model_id, key, description) with keys 'table[name]', '[name]' and 'name', lower-cased.

    Blank descriptions and the text 'nan' are ignored.  When two objects give
    the same key the later one (by ordinal, then key variant) wins, as a
    dictionary rebuilt in row order would keep it.
    """
    d = (objects.select("model_id", "ordinal", F.col(table_col).alias("t"), F.col(name_col).alias("n"),
                        py_strip(F.coalesce(F.col("description"), F.lit(""))).alias("description"))
         .where((F.col("description") != "") & (F.lower("description") != "nan")))
    keys = F.array(
        F.struct(F.lit(1).alias("v"), F.lower(F.concat(F.coalesce("t", F.lit("None")), F.lit("["), F.col("n"), F.lit("]"))).alias("k")),
        F.struct(F.lit(2).alias("v"), F.lower(F.concat(F.lit("["), F.col("n"), F.lit("]"))).alias("k")),
        F.struct(F.lit(3).alias("v"), F.lower(F.col("n")).alias("k")))
    return (d.select("model_id", "ordinal", "description", F.explode(keys).alias("kk"))
            .groupBy("model_id", F.col("kk.k").alias("key"))
            .agg(F.max_by("description", F.col("ordinal") * 4 + F.col("kk.v")).alias("description")))
