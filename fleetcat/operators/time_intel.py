"""Time-intelligence measure operators.

Periods are computed with built-in date functions; shifted periods are
equi-joins of pre-aggregated period tables on a shifted key (one row per
period, so the join is small whatever the fact size); running totals are
windows partitioned by year over the period rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcat.operators.common import null_safe

from fleetcat.functions.common import col_of

_UNITS = {"year": "year", "quarter": "quarter", "month": "month"}


def as_date(c) -> Column:
    return col_of(c).cast("date")


def period_start(d, unit: str) -> Column:
    """First day of the year / quarter / month of a date."""
    return F.trunc(as_date(d), _UNITS[unit])


def dates_to_date(d, as_of, unit: str) -> Column:
    """M26 DATESYTD / DATESQTD / DATESMTD: the date lies in [start of the as_of period, as_of]."""
    a = F.lit(as_of).cast("date") if not isinstance(as_of, Column) else as_of
    return as_date(d).between(period_start(a, unit), a)


def total_to_date(agg_value: Column, d, as_of, unit: str) -> Column:
    """Aggregate restricted to the to-date period (a conditional aggregate)."""
    return F.sum(F.when(dates_to_date(d, as_of, unit), agg_value))


def running_total_by_year(period_rows: DataFrame, date_col: str, value_col: str, name: str) -> DataFrame:
    """M27 TOTALYTD: running total within each year over period rows, ordered by date."""
    w = (Window.partitionBy(F.year(date_col)).orderBy(date_col)
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return period_rows.withColumn(name, F.sum(value_col).over(w))


def shift(d, n: int, unit: str) -> Column:
    """M29 DATEADD: a date shifted by n days, months, quarters or years."""
    d = as_date(d)
    if unit == "day":
        return F.date_add(d, n)
    months = {"month": 1, "quarter": 3, "year": 12}[unit] * n
    return F.add_months(d, months)


def with_shifted(period_rows: DataFrame, date_col: str, value_col: str, n: int, unit: str, name: str) -> DataFrame:
    """Attach the value of the period ``n`` units earlier (null when absent).

    Each row looks up its own shifted date, one key per row; at day grain the
    last days of a long month share the last day of a shorter one.
    """
    prior = period_rows.select(as_date(date_col).alias("_day"), F.col(value_col).alias(name))
    return period_rows.join(prior, shift(date_col, -n, unit) == F.col("_day"), "left").drop("_day")


def same_period_last_year(period_rows: DataFrame, date_col: str, value_col: str, name: str) -> DataFrame:
    """M28 SAMEPERIODLASTYEAR."""
    return with_shifted(period_rows, date_col, value_col, 1, "year", name)


def parallel_period(period_rows: DataFrame, date_col: str, value_col: str, n: int, unit: str, name: str) -> DataFrame:
    """M30 PARALLELPERIOD: the total of the whole period n units before the row's period."""
    whole = (period_rows.groupBy(period_start(date_col, unit).alias("_p")).agg(F.sum(value_col).alias(name)))
    whole = whole.select(shift("_p", n, unit).alias("_p"), name)
    return (period_rows.withColumn("_p", period_start(date_col, unit))
            .join(whole, "_p", "left").drop("_p"))


def end_of_month(d, n: int = 0) -> Column:
    """M31 EOMONTH: last day of the month n months before/after."""
    return F.last_day(F.add_months(as_date(d), n))


def today(as_of: dt.date | str) -> Column:
    """M32 TODAY: a fixed as-of date (deterministic across runs)."""
    return F.lit(str(as_of)).cast("date")


def blank() -> Column:
    """M32 BLANK."""
    return F.lit(None)


# ------------------------------------------------------------------ periods without rows (M27-M30 on gaps)

def on_calendar(per_period: DataFrame, entity: Sequence[str], period: str, unit: str = "month") -> DataFrame:
    """Sparse period rows on a full calendar: every ``unit`` from an entity's first to its last, blank where it has no row.

    ``per_period``: one row per entity and period (a date, the first of its
    unit).  The spine is generated per entity by ``sequence``; its length is
    bounded by the calendar, not by the facts.  Joined by a merge: the size of
    a packed file says little about the rows in it, and a broadcast of periods
    would pass them all through the driver.
    """
    if unit not in ("day", "week", "month", "quarter", "year"):
        raise ValueError(f"unknown unit {unit}")
    step = F.expr({"quarter": "interval 3 months"}.get(unit, f"interval 1 {unit}"))
    spans = per_period.where(F.col(period).isNotNull()).groupBy(*entity).agg(F.min(period).alias("_first"), F.max(period).alias("_last"))
    spine = spans.select(*entity, F.explode(F.sequence(as_date("_first"), as_date("_last"), step)).alias("_at"))
    own = per_period.select(*[F.col(e).alias(f"_e{i}") for i, e in enumerate(entity)], F.col(period).alias("_p"),
                            *[c for c in per_period.columns if c not in (*entity, period)])
    same = null_safe([*((e, f"_e{i}") for i, e in enumerate(entity)), ("_at", "_p")])
    return spine.join(own.hint("merge"), same, "left").drop("_p", *[f"_e{i}" for i in range(len(entity))]).withColumnRenamed("_at", period)


def shifted_on_calendar(calendar: DataFrame, entity: Sequence[str], period: str, value: str, months: int, name: str, source: DataFrame | None = None) -> DataFrame:
    """M28-M30 on a calendar: the value of the period ``months`` earlier (later if negative); blank where there is none.

    ``source``: the calendar to look values up in, if ``calendar`` already has shifted values.
    """
    before = (calendar if source is None else source).select(*[F.col(e).alias(f"_e{i}") for i, e in enumerate(entity)],
                             F.add_months(period, months).alias("_p"), F.col(value).alias(name))
    same = null_safe([*((e, f"_e{i}") for i, e in enumerate(entity)), (period, "_p")])
    return calendar.join(before.hint("merge"), same, "left").drop("_p", *[f"_e{i}" for i in range(len(entity))])


def to_date_on_calendar(calendar: DataFrame, entity: Sequence[str], period: str, value: str, name: str) -> DataFrame:
    """M27 TOTALYTD on a calendar: running total inside the year, carried over blank periods (12 months, or 366 days, a window)."""
    w = Window.partitionBy(*entity, F.year(period)).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return calendar.withColumn(name, F.sum(value).over(w))
