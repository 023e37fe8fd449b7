"""Plan helpers shared by operators.

Numberings over groups that may hold much of a table (a model, a brand) never
send a group to one task: rows are range-partitioned by (group, order), so a
hot group spans many partitions in key order, and each partition's running sum
starts at what the earlier partitions hold.  The same algorithm runs at every
size.  Groups that one document bounds (the visuals of a page, the items of a
block) use plain windows where they occur.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcat.session import cut_lineage


def null_safe(pairs) -> Column:
    """Equality of column pairs in which null equals null."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])


def sums_of_earlier(df: DataFrame, group_cols, order_cols, amounts: dict[str, Column], totals: bool = False) -> DataFrame:
    """``df`` with, per name, the sum of its amount over the rows of the group that come before (bigint).

    With ``totals`` also ``<name>_total``, the sum over the whole group.  Groups
    and values may be null.  ``order_cols`` must order the rows of a group
    totally.  The range-partitioned rows are written once to the shared
    checkpoint folder, so every use sees the same partition numbers.
    """
    groups, names = list(group_cols), list(amounts)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    rows = df.repartitionByRange(*[F.col(c) for c in groups], *order).withColumn("_part", F.spark_partition_id())
    rows = cut_lineage(rows.withColumns({f"_amount{i}": amounts[n].cast("long") for i, n in enumerate(names)}), "ordered")
    sums = rows.groupBy("_part", *groups).agg(*[F.sum(f"_amount{i}").alias(f"_sum{i}") for i in range(len(names))])
    group = Window.partitionBy(*groups)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = sums.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
                          *[F.coalesce(F.sum(f"_sum{i}").over(earlier), zero).alias(f"_offset{i}") for i in range(len(names))],
                          *[F.sum(f"_sum{i}").over(group).alias(f"{n}_total") for i, n in enumerate(names) if totals])
    inside = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_own{i}": F.coalesce(F.sum(f"_amount{i}").over(inside), zero) for i in range(len(names))})
    same = (F.col("_part") == F.col("_p")) & null_safe((g, f"_g{i}") for i, g in enumerate(groups))
    out = rows.join(offsets, same).withColumns({n: F.col(f"_own{i}") + F.col(f"_offset{i}") for i, n in enumerate(names)})
    return out.drop("_part", "_p", *[f"{c}{i}" for c in ("_amount", "_own", "_offset") for i in range(len(names))], *[f"_g{i}" for i in range(len(groups))])


def sum_of_earlier(df: DataFrame, group_cols, order_cols, amount: Column, name: str) -> DataFrame:
    """``df`` with ``name``: one running sum of ``sums_of_earlier``."""
    return sums_of_earlier(df, group_cols, order_cols, {name: amount})


def row_number_within(df: DataFrame, group_cols, order_cols, name: str) -> DataFrame:
    """1-based row number (bigint) within groups that may be large."""
    return sum_of_earlier(df, group_cols, order_cols, F.lit(1), name).withColumn(name, F.col(name) + 1)


def ranks_within(df: DataFrame, group_cols, value_col: str, ranks: dict[str, tuple[bool, bool]]) -> DataFrame:
    """Several ranks of one value from one sorted table: name -> (descending, dense), all bigint.

    The groups may be large; null groups and values keep their rows.  A value's
    rank is one more than the rows (dense: the distinct values) of its group
    before it; nulls come first ascending and last descending, so descending
    ranks count what the group's total leaves after a value.
    """
    per_value = df.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_rows"))
    ranked = sums_of_earlier(per_value, group_cols, [F.col(value_col).asc_nulls_first()], {"_n": F.col("_rows"), "_d": F.lit(1)}, totals=True)

    def rank(descending: bool, dense: bool) -> Column:
        name, own = ("_d", F.lit(1)) if dense else ("_n", F.col("_rows"))
        return (F.col(f"{name}_total") - F.col(name) - own if descending else F.col(name)) + 1

    keys = [*group_cols, value_col]
    ranked = ranked.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[rank(*how).alias(n) for n, how in ranks.items()])
    return df.join(ranked, null_safe((k, f"_k{i}") for i, k in enumerate(keys))).drop(*[f"_k{i}" for i in range(len(keys))])


def rank_within(df: DataFrame, group_cols, value_col: str, name: str, descending: bool = False, dense: bool = False) -> DataFrame:
    """``rank()`` / ``dense_rank()`` (bigint) within groups that may be large: one rank of ``ranks_within``."""
    return ranks_within(df, group_cols, value_col, {name: (descending, dense)})
