"""M23 EARLIER with two conditions: peers with a larger x and a smaller y, counted without pairs.

1. Sort: the distinct (group, x, y), with how often each occurs, are numbered
   by group, then x descending, then y descending.  A row's peers with a larger
   x and a smaller y are then exactly the rows of its group that come before it
   and have a smaller y: those with an equal x before it have no smaller y.
2. Inside a block of BLOCK numbers: ordered by group descending and y ascending
   all rows before a row in the numbering and smaller in this order are of its
   own group, so a block is one count of inversions whatever groups it holds.
3. Across blocks: blocks are the leaves of a binary tree.  Per level a row of a
   right child adds the rows of the left child with a smaller y, a running sum
   in y order.  Only rows of groups that reach both children take part.

A row of a group of n distinct (x, y) is sorted log2(n / BLOCK) times more than
a row of a group inside one block; no group meets in one task, and copies count
through their number.  Blocks are the largest data that one task holds.

Defined cases: a null x or y compares with nothing, so its row counts 0 peers
and is no peer; null groups are one group; NaN is larger than any number and
equal to itself, as Spark orders it; repeated rows each get a row and do not
count each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcat.operators.common import null_safe, sum_of_earlier
from fleetcat.session import cut_lineage

BLOCK = 1 << 16


def earlier_smaller(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per position the weight of the earlier positions that have a smaller value."""
    n = len(value)
    at = np.arange(n)
    by_value = np.lexsort((-at, value))  # of equal values the later position first: it must not count the earlier one
    out = np.zeros(n, np.int64)
    for level in range(max(0, n - 1).bit_length()):
        node = by_value >> (level + 1)
        order = np.argsort(node, kind="stable")
        rows, node = by_value[order], node[order]
        right = (rows >> level) & 1 == 1
        total = np.concatenate(([0], np.cumsum(np.where(right, 0, weight[rows]))))
        inside = total[:-1] - total[np.searchsorted(node, node)]
        out[rows[right]] += inside[right]
    return out


def _count_block(block: pa.Table) -> pa.Table:
    pos, rank, weight = (np.asarray(block.column(c).combine_chunks()) for c in ("_pos", "_rank", "_weight"))
    order = np.argsort(pos)
    return pa.table({"_pos": pos[order], "_found": earlier_smaller(rank[order], weight[order])})


def _across_blocks(rows: DataFrame, keys: Sequence[str], n_blocks: int) -> Iterator[DataFrame]:
    """(_pos, _found) of the rows in earlier blocks, if there is more than one block."""
    levels = max(0, n_blocks - 1).bit_length()
    if not levels:
        return
    reach = rows.groupBy(*keys).agg(F.min("_block").alias("_from"), F.max("_block").alias("_to")).where("_from < _to")
    reach = reach.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], "_from", "_to")
    if keys:  # groups over a block boundary: fewer than there are blocks
        spread = rows.join(reach, null_safe((k, f"_r{i}") for i, k in enumerate(keys))).drop(*[f"_r{i}" for i in range(len(keys))])
    else:
        spread = rows.withColumns({"_from": F.lit(0), "_to": F.lit(n_blocks - 1)})
    spread = spread.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    spread = spread.withColumn("_child", F.expr("shiftright(_block, _level)")).withColumn("_right", F.col("_child") % 2)
    first_beyond = F.expr("shiftleft(_child + 1 - _right, _level)")  # where the right child begins
    both = F.when(F.col("_right") == 1, F.col("_from") < first_beyond).otherwise(F.col("_to") >= first_beyond)
    spread = spread.where(both).withColumn("_node", F.expr("shiftright(_child, 1)"))
    smaller_first = [F.col(k).desc_nulls_last() for k in keys] + [F.col("_y").asc(), F.col("_right").desc(), F.col("_pos").asc()]
    amount = F.when(F.col("_right") == 0, F.col("_weight")).otherwise(F.lit(0))
    counted = sum_of_earlier(spread.drop("_from", "_to", "_block", "_child"), ["_level", "_node"], smaller_first, amount, "_found")
    yield counted.where("_right = 1").select("_pos", "_found")


def count_dominating_peers(df: DataFrame, partition_by: Sequence[str], larger: str, smaller: str, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``name`` (bigint): the rows of the same group with a larger ``larger`` and a smaller ``smaller``."""
    keys = [f"_k{i}" for i in range(len(partition_by))]
    points = df.select(*[F.col(c).alias(k) for c, k in zip(partition_by, keys)], F.col(larger).alias("_x"), F.col(smaller).alias("_y"))
    points = points.where("_x is not null and _y is not null").groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_weight"))
    order = [F.col(k).asc_nulls_first() for k in keys] + [F.col("_x").desc(), F.col("_y").desc()]
    rows = sum_of_earlier(points.withColumn("_all", F.lit(0)), ["_all"], order, F.lit(1), "_pos").drop("_all")
    rows = cut_lineage(rows.withColumn("_block", F.expr(f"_pos div {block}")), "peers")
    n_blocks = (rows.agg(F.max("_block")).first()[0] or 0) + 1

    smaller_first = ", ".join([f"{k} desc nulls last" for k in keys] + ["_y asc"])
    ranked = rows.withColumn("_rank", F.expr(f"dense_rank() over (partition by _block order by {smaller_first})").cast("long"))
    found = ranked.select("_block", "_pos", "_rank", "_weight").groupBy("_block").applyInArrow(_count_block, "_pos long, _found long")
    for more in _across_blocks(rows, keys, n_blocks):
        found = found.unionByName(more).groupBy("_pos").agg(F.sum("_found").alias("_found"))

    found = rows.join(found, "_pos").select(*[F.col(k).alias(f"_q{i}") for i, k in enumerate(keys)], F.col("_x").alias("_qx"), F.col("_y").alias("_qy"), "_found")
    same = null_safe([*((c, f"_q{i}") for i, c in enumerate(partition_by)), (larger, "_qx"), (smaller, "_qy")])
    out = df.join(found, same, "left").withColumn(name, F.coalesce("_found", F.lit(0)).cast("long"))
    return out.drop("_found", "_qx", "_qy", *[f"_q{i}" for i in range(len(keys))])
