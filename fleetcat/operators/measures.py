"""Measure operators (Group B, M1-M25, M33, M34) over any star schema.

The reference names these functions and explains them in English; here each
is the DataFrame expression a Spark user would write.  Aggregates are plain
``groupBy().agg()`` (partial + final aggregation); "ignore filters" totals
are scalar subqueries or windows over already-aggregated rows, never a cross
join; filter-context changes are conditional aggregates.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcat.functions.common import col_of
from fleetcat.operators.common import null_safe
from fleetcat.session import cut_lineage


# ------------------------------------------------------------------ aggregates (M1-M6)

def total(c) -> Column:
    """M1 SUM."""
    return F.sum(col_of(c))


def average(c) -> Column:
    """M2 AVERAGE."""
    return F.avg(col_of(c))


def minimum(c) -> Column:
    """M3 MIN."""
    return F.min(col_of(c))


def maximum(c) -> Column:
    """M3 MAX."""
    return F.max(col_of(c))


def distinct_count(c) -> Column:
    """M4 DISTINCTCOUNT: number of unique values; a null counts as one value (our choice)."""
    c = col_of(c)
    return F.count_distinct(c) + F.max(c.isNull().cast("int"))


def count_rows() -> Column:
    """M5 COUNTROWS."""
    return F.count(F.lit(1))


def sumx(row_expr: Column) -> Column:
    """M6 SUMX: sum over the table of a row expression."""
    return F.sum(row_expr)


def averagex(row_expr: Column) -> Column:
    """M6 AVERAGEX."""
    return F.avg(row_expr)


def minx(row_expr: Column) -> Column:
    """M6 MINX."""
    return F.min(row_expr)


def maxx(row_expr: Column) -> Column:
    """M6 MAXX."""
    return F.max(row_expr)


# ------------------------------------------------------------------ scalar functions

def divide(numerator, denominator, alternate=None) -> Column:
    """M7 DIVIDE: a / b; a zero or null divisor gives ``alternate`` (null by default)."""
    out = F.try_divide(col_of(numerator), col_of(denominator))
    return out if alternate is None else F.coalesce(out, F.lit(alternate) if not isinstance(alternate, Column) else alternate)


def round_to(c, digits: int = 0) -> Column:
    """M8 ROUND: half away from zero at ``digits`` decimals."""
    return F.round(col_of(c), digits)


def if_(cond: Column, then, otherwise=None) -> Column:
    """M9 IF: blank (null) when the condition fails and no third argument is given."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(cond, lit(then))
    return out if otherwise is None else out.otherwise(lit(otherwise))


def switch(value, cases: Sequence[tuple], default=None) -> Column:
    """M10 SWITCH (value form): the result of the first case equal to ``value``."""
    v = col_of(value)
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = None
    for k, r in cases:
        out = F.when(v == lit(k), lit(r)) if out is None else out.when(v == lit(k), lit(r))
    return out if default is None else out.otherwise(lit(default))


def switch_true(cases: Sequence[tuple[Column, object]], default=None) -> Column:
    """M10 SWITCH(TRUE(), ...): the result of the first true condition."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = None
    for cond, r in cases:
        out = F.when(cond, lit(r)) if out is None else out.when(cond, lit(r))
    return out if default is None else out.otherwise(lit(default))


def concat_text(*parts) -> Column:
    """M33 '&': text concatenation (a blank operand concatenates as empty text)."""
    return F.concat(*[F.coalesce(col_of(p).cast("string"), F.lit("")) for p in parts])


def and_(*conds: Column) -> Column:
    """M33 AND(), '&&'."""
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def or_(*conds: Column) -> Column:
    """M33 OR(), '||'."""
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def not_(cond: Column) -> Column:
    """M33 NOT."""
    return ~cond


# ------------------------------------------------------------------ filter context

def filter_rows(df: DataFrame, cond: Column) -> DataFrame:
    """M11 FILTER: the rows of a table where the condition holds."""
    return df.where(cond)


def keep_filters(*conds: Column) -> Column:
    """M15 KEEPFILTERS: the new condition is added to (not replacing) existing ones."""
    return and_(*conds)


def calculate(agg, row_expr: Column, *conds: Column) -> Column:
    """M12 CALCULATE: an aggregate evaluated under extra conditions (a conditional aggregate)."""
    cond = and_(*conds) if conds else F.lit(True)
    return agg(F.when(cond, row_expr))


def with_grand_total(grouped: DataFrame, source: DataFrame, value: Column, name: str) -> DataFrame:
    """M13 ALL / REMOVEFILTERS: add the total over the whole source, ignoring grouping.

    The total is a scalar subquery: one aggregate job whose single value is
    shipped to every task; no cross join and no single-partition window.
    """
    return grouped.withColumn(name, source.select(value).scalar())


def with_total_except(grouped: DataFrame, kept: Sequence[str], value: str, name: str) -> DataFrame:
    """M14 ALLEXCEPT: add the total over all groups that share the kept columns.

    A window over the already-aggregated rows; its partitions hold one row per
    group, not the detail rows.
    """
    return grouped.withColumn(name, F.sum(value).over(Window.partitionBy(*kept)))


def totals_in_contexts(df: DataFrame, keys: Sequence[str], measures: dict[str, Column], contexts: dict[str, Sequence[str]],
                       distinct: dict[str, str | Column] | None = None) -> DataFrame:
    """Measures per ``keys``, each beside its total in several filter contexts.

    ``contexts`` names, per context, the keys whose filters stay: all but one
    is ALLEXCEPT, none is ALL.  One aggregate over grouping sets (an Expand
    before the partial aggregate) computes the detail and every total, so a
    measure may be any aggregate: totals are not sums of the detail.  The
    aggregated rows are written once; each context's rows are joined back to
    the detail on its own keys (null keys are values).

    ``distinct`` counts the distinct values of a column (nulls are none) like
    ``count_distinct`` among the measures, which sends a row per value and
    context through the shuffle; here a value is one row of bits, see
    ``_distinct_in_contexts``, at the price of one more scan per column.

    Result: keys, measures, and ``<measure>_<context>`` per context.
    """
    keys, distinct = list(keys), distinct or {}
    kept = {name: [k for k in keys if k in set(cols)] for name, cols in contexts.items()}
    sets = list(dict.fromkeys(tuple(c) for c in [tuple(keys), *map(tuple, kept.values())]))
    rows = df.groupingSets([list(s) for s in sets], *keys).agg(F.grouping_id(*keys).alias("_set"), *[c.alias(m) for m, c in measures.items()])
    rows = cut_lineage(rows.withColumn("_id", F.monotonically_increasing_id()), "contexts")
    mask = {s: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s) for s in sets}  # a set bit: the key is rolled up
    if distinct:
        rows = _distinct_in_contexts(df, rows, keys, mask, distinct)
    out = rows.where(F.col("_set") == 0).drop("_set", "_id")
    for name, cols in kept.items():
        out = _beside(out, rows.where(F.col("_set") == mask[tuple(cols)]), cols, {m: f"{m}_{name}" for m in [*measures, *distinct]})
    return out


def _beside(detail: DataFrame, total: DataFrame, cols: Sequence[str], names: dict[str, str]) -> DataFrame:
    """``detail`` with columns (old name -> new) of the row of ``total`` that has its values of ``cols``."""
    if not cols:
        return detail.withColumns({new: total.select(c).scalar() for c, new in names.items()})
    total = total.select(*[F.col(k).alias(f"_of_{k}") for k in cols], *[F.col(c).alias(new) for c, new in names.items()])
    return detail.join(total, null_safe((k, f"_of_{k}") for k in cols)).drop(*[f"_of_{k}" for k in cols])


def _distinct_in_contexts(df: DataFrame, rows: DataFrame, keys: Sequence[str], mask: dict[tuple, int], distinct: dict[str, str | Column]) -> DataFrame:
    """``rows`` (one per context and keys, numbered by ``_id``) with the exact distinct counts of columns of ``df``.

    The rows of all contexts are bits, 64 to a block.  A row of ``df`` sets the
    bits of its detail row and of that row's totals; a value's bits are or-ed
    per block, so the shuffle carries one row per value and block, combined
    before it, however many contexts there are.  Counts are the sums of the bits.
    """
    sets = list(mask)
    ids = rows.where(F.col("_set") == 0).select(*keys, F.col("_id").alias("_id0"))
    for i, cols in enumerate(sets[1:], 1):
        ids = _beside(ids, rows.where(F.col("_set") == mask[cols]), cols, {"_id": f"_id{i}"})
    bits = ids.select(*keys, F.explode(F.array(*[f"_id{i}" for i in range(len(sets))])).alias("_id"))
    bits = bits.groupBy(*keys, F.shiftright("_id", 6).alias("_block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_id & 63 as int))")).alias("_bits"))
    places = bits.groupBy(*keys).agg(F.collect_list(F.struct("_block", "_bits")).alias("_places"))  # one item per context at most
    places = cut_lineage(places.withColumnsRenamed({k: f"_of_{k}" for k in keys}), "places")
    for name, c in distinct.items():
        facts = df.select(*keys, col_of(c).alias("_value")).where(F.col("_value").isNotNull())
        placed = facts.join(places, null_safe((k, f"_of_{k}") for k in keys))
        values = placed.select("_value", F.inline("_places")).groupBy("_value", "_block").agg(F.bit_or("_bits").alias("_bits"))
        sums = values.groupBy("_block").agg(F.array(*[F.sum(F.bit_get("_bits", F.lit(i))) for i in range(64)]).alias("_sums"))
        counts = sums.select("_block", F.posexplode("_sums").alias("_bit", "_n"))
        counts = counts.where(F.col("_n") > 0).select((F.col("_block") * 64 + F.col("_bit")).alias("_id"), F.col("_n").alias(name))
        rows = rows.join(counts, "_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return cut_lineage(rows, "contexts")


def values(df: DataFrame, *cols: str) -> DataFrame:
    """M16 VALUES: each unique value (combination)."""
    return df.select(*cols).distinct()


def selected_value(c, alternate=None) -> Column:
    """M17 SELECTEDVALUE: the value when exactly one distinct value is present, else null (or alternate)."""
    c = col_of(c)
    out = F.when((F.count_distinct(c) == 1) & (F.max(c.isNull().cast("int")) == 0), F.max(c))
    return out if alternate is None else out.otherwise(F.lit(alternate))


# ------------------------------------------------------------------ table functions

def summarize(df: DataFrame, by: Iterable[str], **aggs: Column) -> DataFrame:
    """M18 SUMMARIZE: the table grouped by columns, adding name = aggregate."""
    return df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])


def add_columns(df: DataFrame, **cols: Column) -> DataFrame:
    """M19 ADDCOLUMNS."""
    return df.withColumns(cols)


def select_columns(df: DataFrame, **cols) -> DataFrame:
    """M20 SELECTCOLUMNS: new name = column or expression."""
    return df.select(*[col_of(c).alias(n) for n, c in cols.items()])


# ------------------------------------------------------------------ ranking and concatenation

def rankx(partition_by: Sequence[str], order_col, descending: bool = True, dense: bool = False) -> Column:
    """M21 RANKX: rank by a value within a group; default descending with gaps (our choice)."""
    o = col_of(order_col)
    w = Window.partitionBy(*partition_by).orderBy(o.desc() if descending else o.asc())
    return (F.dense_rank() if dense else F.rank()).over(w)


def rankx_df(df: DataFrame, partition_by: Sequence[str], value_col: str, name: str,
             descending: bool = True, dense: bool = False) -> DataFrame:
    """M21 RANKX for large groups: the same ranks as ``rankx``, computed without sending a group to one task."""
    from fleetcat.operators.common import rank_within
    return rank_within(df, list(partition_by), value_col, name, descending=descending, dense=dense)


def rankx_many(df: DataFrame, partition_by: Sequence[str], value_col: str, ranks: dict[str, tuple[bool, bool]]) -> DataFrame:
    """M21 RANKX several times over one value: name -> (descending, dense), from one sorted table."""
    from fleetcat.operators.common import ranks_within
    return ranks_within(df, list(partition_by), value_col, ranks)


def count_higher_peers(partition_by: Sequence[str], order_col) -> Column:
    """M23 EARLIER: for each row, how many peers in the group have a strictly higher value.

    ``rank()`` descending is one plus the number of strictly higher rows, so a
    single ordered window replaces the row-by-row self-join.
    """
    return rankx(partition_by, order_col, descending=True) - 1


def concatenatex(c: str, separator: str = ", ", order_by: str | None = None, descending: bool = False) -> Column:
    """M22 CONCATENATEX: the group's values joined by a separator, in a given order (column names).

    One task sorts a group and its string must fit a row: for groups that something bounds, else ``concatenatex_rows``.
    """
    sep = separator.replace("'", "''")
    o = order_by or c
    return F.expr(f"listagg(`{c}`, '{sep}') within group (order by `{o}` {'desc' if descending else 'asc'})")


def concatenatex_rows(df: DataFrame, group_by: Sequence[str], c: str, order_by: str | None = None, descending: bool = False) -> DataFrame:
    """M22 CONCATENATEX for large groups: the values as rows (group, position, value), without sending a group to one task.

    Joined by position they are the string of ``concatenatex``; nulls are left out like there, equal order values
    follow the value.
    """
    from fleetcat.operators.common import row_number_within
    value, order = F.col(c), F.col(order_by or c)
    rows = df.where(value.isNotNull()).select(*group_by, value.alias("value"), order.alias("_order"))
    order = F.col("_order").desc() if descending else F.col("_order").asc()
    return row_number_within(rows, list(group_by), [order, "value"], "position").select(*group_by, "position", "value")


# ------------------------------------------------------------------ DISTINCTCOUNT that rolls up (M4)

def distinct_buckets(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """M4 in stored form: (keys, bucket, bits, has_blank), the integers of ``c`` as bitmaps of 2^15 values each.

    Rows per key and bucket are mergeable, so a table of them (per day and
    model, say) answers the exact distinct count of any coarser group without
    the detail.  A blank counts as one value and is a flag; negative values have
    buckets of their own.
    """
    v = F.col(c).cast("long")
    # -1, -2, ... mirror 0, 1, ...: the bitmap functions number from 1 and take no negative value
    place = F.when(v < 0, -v).otherwise(v + 1)
    rows = df.select(*keys, (v < 0).alias("negative"), F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    return rows.groupBy(*keys, "negative", "bucket").agg(
        F.bitmap_construct_agg("bit").alias("bits"), F.max(F.col("bit").isNull()).alias("has_blank"))


def distinct_count_of_buckets(buckets: DataFrame, group_by: Sequence[str], name: str) -> DataFrame:
    """M4 from stored buckets: (group_by, ``name``), equal to the distinct count over the detail rows."""
    merged = buckets.groupBy(*group_by, "negative", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.max("has_blank").alias("blank"))
    amount = F.when(F.col("blank"), F.lit(1)).otherwise(F.bitmap_count("bits"))
    return merged.groupBy(*group_by).agg(F.sum(amount).cast("long").alias(name))


# ------------------------------------------------------------------ relationships

def treat_as(df: DataFrame, key: str, values_df: DataFrame, values_col: str) -> DataFrame:
    """M24 TREATAS: keep rows whose key is one of the values of another table's column (a semi join)."""
    return df.join(values_df.select(F.col(values_col).alias(key)).distinct(), key, "left_semi")


def use_relationship(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """M25 USERELATIONSHIP: join along the named pair of columns instead of the default one."""
    return fact.join(dim, fact[fact_key] == dim[dim_key])
