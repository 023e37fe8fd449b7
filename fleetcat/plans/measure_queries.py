"""Registered measure-operator queries (Group B, M1-M34) on the star schema, with DuckDB oracles.

Float aggregates are rounded in both engines so the comparison sees the
same digits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcat.operators import measures as M
from fleetcat.operators import time_intel as TI
from fleetcat.plans.registry import register
from fleetcat.session import read_table

AS_OF = "1999-06-15"


def _t(spark, sf_dir, name):
    return read_table(spark, sf_dir, name)


# ------------------------------------------------------------------ M1-M8

@register("M1_sum", oracle="select p_brand, round(sum(p_retailprice), 2) as total_price from part group by p_brand")
def m1(spark, sf_dir):
    return _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(M.total("p_retailprice"), 2).alias("total_price"))


@register("M2_average", oracle="select p_brand, round(avg(p_retailprice), 4) as avg_price from part group by p_brand")
def m2(spark, sf_dir):
    return _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(M.average("p_retailprice"), 4).alias("avg_price"))


@register("M3_min_max", oracle="""
select p_brand, min(p_retailprice) as min_price, max(p_retailprice) as max_price, min(p_size) as min_size, max(p_size) as max_size
from part group by p_brand""")
def m3(spark, sf_dir):
    return _t(spark, sf_dir, "part").groupBy("p_brand").agg(
        M.minimum("p_retailprice").alias("min_price"), M.maximum("p_retailprice").alias("max_price"),
        M.minimum("p_size").alias("min_size"), M.maximum("p_size").alias("max_size"))


@register("M4_distinct_count", oracle="""
select p_brand, count(distinct p_name) + max(case when p_name is null then 1 else 0 end) as n_names,
  count(distinct p_type) + max(case when p_type is null then 1 else 0 end) as n_types
from part group by p_brand""")
def m4(spark, sf_dir):
    return _t(spark, sf_dir, "part").groupBy("p_brand").agg(
        M.distinct_count("p_name").alias("n_names"), M.distinct_count("p_type").alias("n_types"))


@register("M5_count_rows", oracle="select p_brand, count(*) as n_rows from part group by p_brand")
def m5(spark, sf_dir):
    return _t(spark, sf_dir, "part").groupBy("p_brand").agg(M.count_rows().alias("n_rows"))


_REV = "l_extendedprice * (1 - l_discount)"


@register("M6_iterators", oracle=f"""
select l_returnflag, round(sum({_REV}), 2) as sumx_revenue, round(avg({_REV}), 4) as averagex_revenue,
  round(min({_REV}), 4) as minx_revenue, round(max({_REV}), 4) as maxx_revenue
from lineitem group by l_returnflag""")
def m6(spark, sf_dir):
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(M.sumx(rev), 2).alias("sumx_revenue"), F.round(M.averagex(rev), 4).alias("averagex_revenue"),
        F.round(M.minx(rev), 4).alias("minx_revenue"), F.round(M.maxx(rev), 4).alias("maxx_revenue"))


@register("M7_divide", oracle="""
select l_returnflag, l_linenumber,
  round(sum(l_extendedprice) / nullif(sum(case when l_linestatus = 'O' then l_quantity else 0 end), 0), 4) as price_per_open_qty,
  round(coalesce(sum(l_extendedprice) / nullif(sum(case when l_linestatus = 'O' then l_quantity else 0 end), 0), -1), 4) as with_alternate
from lineitem group by l_returnflag, l_linenumber""")
def m7(spark, sf_dir):
    num = F.sum("l_extendedprice")
    den = F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(F.lit(0.0)))
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(
        F.round(M.divide(num, den), 4).alias("price_per_open_qty"),
        F.round(M.divide(num, den, alternate=-1.0), 4).alias("with_alternate"))


@register("M8_round", oracle="""
select l_returnflag, round(avg(l_extendedprice), 2) as r2, round(avg(l_extendedprice), 0) as r0,
  round(sum(l_quantity), -2) as r_minus2
from lineitem group by l_returnflag""")
def m8(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        M.round_to(F.avg("l_extendedprice"), 2).alias("r2"), M.round_to(F.avg("l_extendedprice"), 0).alias("r0"),
        M.round_to(F.sum("l_quantity"), -2).alias("r_minus2"))


# ------------------------------------------------------------------ M9, M10, M33, M34 on events

@register("M9_if", oracle="""
select event_id, case when value > 100 then 'high' end as high_flag,
  case when value > 100 then 'high' else 'normal' end as level from events""")
def m9(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(
        "event_id", M.if_(F.col("value") > 100, "high").alias("high_flag"),
        M.if_(F.col("value") > 100, "high", "normal").alias("level"))


@register("M10_switch", oracle="""
select event_id,
  case event_type when 'click' then 'interaction' when 'view' then 'exposure' when 'error' then 'failure' else 'other' end as kind,
  case when value >= 100 then 'large' when value >= 10 then 'medium' when value >= 0 then 'small' end as size_band
from events""")
def m10(spark, sf_dir):
    v = F.col("value")
    return _t(spark, sf_dir, "events").select(
        "event_id",
        M.switch("event_type", [("click", "interaction"), ("view", "exposure"), ("error", "failure")], "other").alias("kind"),
        M.switch_true([(v >= 100, "large"), (v >= 10, "medium"), (v >= 0, "small")]).alias("size_band"))


@register("M33_operators", oracle="""
select event_id, round(value * 2 + 1 - value / 4, 4) as arith, -value as negated,
  event_type || '-' || cast(user_id as varchar) as label,
  (value > 50 and event_type = 'click') as both_cond, (value <= 1 or event_type <> 'view') as either_cond,
  not (value >= 10) as not_cond, value = 0 as eq_zero
from events""")
def m33(spark, sf_dir):
    v, t = F.col("value"), F.col("event_type")
    return _t(spark, sf_dir, "events").select(
        "event_id", F.round(v * 2 + 1 - v / 4, 4).alias("arith"), (-v).alias("negated"),
        M.concat_text(t, F.lit("-"), F.col("user_id")).alias("label"),
        M.and_(v > 50, t == "click").alias("both_cond"), M.or_(v <= 1, t != "view").alias("either_cond"),
        M.not_(v >= 10).alias("not_cond"), (v == 0).alias("eq_zero"))


@register("M34_var_return", oracle="""
select event_id, base, bonus, base + bonus as result from (
  select event_id, value * 2 as base, case when value * 2 > 50 then 10 else 0 end as bonus from events)""")
def m34(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return (e.withColumn("base", F.col("value") * 2)
            .withColumn("bonus", M.if_(F.col("base") > 50, 10, 0))
            .withColumn("result", F.col("base") + F.col("bonus"))
            .select("event_id", "base", "bonus", "result"))


# ------------------------------------------------------------------ M11, M12, M15 on orders

@register("M11_M12_M15_calculate", oracle="""
select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as n_filtered,
  round(sum(case when o_orderstatus = 'F' then o_totalprice end), 2) as total_f,
  round(sum(o_totalprice), 2) as total_all,
  round(sum(case when o_orderstatus = 'F' and o_totalprice > 100000 then o_totalprice end), 2) as total_f_large
from orders group by o_orderpriority""")
def m11_m12_m15(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    f = F.col("o_orderstatus") == "F"
    filtered = M.filter_rows(o, f).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_filtered"))
    totals = o.groupBy("o_orderpriority").agg(
        F.round(M.calculate(F.sum, F.col("o_totalprice"), f), 2).alias("total_f"),
        F.round(M.total("o_totalprice"), 2).alias("total_all"),
        F.round(M.calculate(F.sum, F.col("o_totalprice"), M.keep_filters(f, F.col("o_totalprice") > 100000)), 2)
        .alias("total_f_large"))
    return totals.join(filtered, "o_orderpriority", "left").select(
        "o_orderpriority", F.coalesce("n_filtered", F.lit(0)).alias("n_filtered"), "total_f", "total_all", "total_f_large")


# ------------------------------------------------------------------ M13, M14 shares

@register("M13_all_share", oracle="""
select p_brand, round(sum(p_retailprice), 2) as brand_total,
  round(sum(p_retailprice) / (select sum(p_retailprice) from part), 6) as share_of_all
from part group by p_brand""")
def m13(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    g = p.groupBy("p_brand").agg(F.sum("p_retailprice").alias("s"))
    g = M.with_grand_total(g, p, F.sum("p_retailprice"), "grand")
    return g.select("p_brand", F.round("s", 2).alias("brand_total"), F.round(F.col("s") / F.col("grand"), 6).alias("share_of_all"))


@register("M14_allexcept_share", oracle="""
select p_type, p_brand, round(s, 2) as brand_total, round(s / sum(s) over (partition by p_type), 6) as share_of_type
from (select p_type, p_brand, sum(p_retailprice) as s from part group by p_type, p_brand)""")
def m14(spark, sf_dir):
    g = _t(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.sum("p_retailprice").alias("s"))
    g = M.with_total_except(g, ["p_type"], "s", "type_total")
    return g.select("p_type", "p_brand", F.round("s", 2).alias("brand_total"),
                    F.round(F.col("s") / F.col("type_total"), 6).alias("share_of_type"))


@register("M12_M13_M14_contexts", oracle="""
with l as (select l_returnflag, l_linestatus, l_linenumber, l_quantity, l_orderkey from lineitem),
d as (select l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) as q, count(distinct l_orderkey) as n from l group by all),
f as (select l_returnflag, sum(l_quantity) as q, count(distinct l_orderkey) as n from l group by all),
g as (select l_linestatus, l_linenumber, sum(l_quantity) as q, count(distinct l_orderkey) as n from l group by all),
a as (select sum(l_quantity) as q, count(distinct l_orderkey) as n from l)
select d.l_returnflag, d.l_linestatus, d.l_linenumber, round(d.q, 2) as quantity, d.n as orders, round(d.q / f.q, 6) as share_of_flag,
  round(d.q / g.q, 6) as share_without_flag, round(d.q / a.q, 6) as share_of_all, f.n as orders_of_flag, a.n as orders_of_all
from d join f using (l_returnflag) join g using (l_linestatus, l_linenumber), a""")
def m12_m13_m14(spark, sf_dir):
    rows = M.totals_in_contexts(
        _t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"],
        {"quantity": F.sum("l_quantity")},
        {"flag": ["l_returnflag"], "rest": ["l_linestatus", "l_linenumber"], "all": []}, distinct={"orders": "l_orderkey"})
    share = lambda c: F.round(F.col("quantity") / F.col(c), 6)
    return rows.select("l_returnflag", "l_linestatus", "l_linenumber", F.round("quantity", 2).alias("quantity"), "orders",
                       share("quantity_flag").alias("share_of_flag"), share("quantity_rest").alias("share_without_flag"),
                       share("quantity_all").alias("share_of_all"), F.col("orders_flag").alias("orders_of_flag"), F.col("orders_all").alias("orders_of_all"))


# ------------------------------------------------------------------ M16, M17

@register("M16_values", oracle="select distinct o_orderpriority from orders")
def m16(spark, sf_dir):
    return M.values(_t(spark, sf_dir, "orders"), "o_orderpriority")


@register("M17_selectedvalue", oracle="""
select o_custkey, case when count(distinct o_orderpriority) = 1 and max(case when o_orderpriority is null then 1 else 0 end) = 0
  then max(o_orderpriority) end as selected_priority, count(*) as n_orders
from orders group by o_custkey""")
def m17(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        M.selected_value("o_orderpriority").alias("selected_priority"), F.count(F.lit(1)).alias("n_orders"))


# ------------------------------------------------------------------ M18-M20

@register("M18_M20_summarize", oracle="""
select c_mktsegment as segment, n_customers, round(balance, 2) as balance, round(balance / n_customers, 4) as avg_balance
from (select c_mktsegment, count(*) as n_customers, sum(c_acctbal) as balance from customer group by c_mktsegment)""")
def m18_m20(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    s = M.summarize(c, ["c_mktsegment"], n_customers=F.count(F.lit(1)), balance=F.sum("c_acctbal"))
    s = M.add_columns(s, avg_balance=F.round(F.col("balance") / F.col("n_customers"), 4))
    return M.select_columns(s, segment="c_mktsegment", n_customers="n_customers",
                            balance=F.round("balance", 2), avg_balance="avg_balance")


# ------------------------------------------------------------------ M21-M23 on part

@register("M21_M23_rankx_earlier", oracle="""
select p_partkey, p_brand,
  cast(rank() over (partition by p_brand order by p_retailprice desc) as integer) as rank_desc,
  cast(dense_rank() over (partition by p_brand order by p_retailprice desc) as integer) as dense_desc,
  cast(rank() over (partition by p_brand order by p_retailprice asc) as integer) as rank_asc,
  cast(rank() over (partition by p_brand order by p_retailprice desc) - 1 as integer) as n_higher
from part""")
def m21_m23(spark, sf_dir):
    """Ranks within a brand computed skew-safe (a brand may hold much of the table); EARLIER = rank_desc - 1."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    p = M.rankx_many(p, ["p_brand"], "p_retailprice", {"rank_desc": (True, False), "dense_desc": (True, True), "rank_asc": (False, False)})
    return p.select("p_partkey", "p_brand", "rank_desc", "dense_desc", "rank_asc",
                    (F.col("rank_desc") - 1).alias("n_higher"))


@register("M23_earlier_two_conditions", oracle="""
select a.o_orderkey, count(b.o_orderkey) as n_peers
from orders a left join orders b on a.o_orderpriority is not distinct from b.o_orderpriority
  and b.o_totalprice > a.o_totalprice and b.o_orderdate < a.o_orderdate
group by a.o_orderkey""")
def m23_two(spark, sf_dir):
    """Earlier orders of the same priority with a larger total, counted without pairs."""
    from fleetcat.operators.peers import count_dominating_peers
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    return count_dominating_peers(o, ["o_orderpriority"], "o_totalprice", "o_orderdate", "n_peers").select("o_orderkey", "n_peers")


@register("M22_concatenatex", oracle="""
select p_brand, string_agg(p_name, ', ' order by p_name) as names, count(*) as n_names
from (select distinct p_brand, p_name from part) group by p_brand""")
def m22(spark, sf_dir):
    d = M.values(_t(spark, sf_dir, "part"), "p_brand", "p_name")
    return d.groupBy("p_brand").agg(M.concatenatex("p_name", ", ").alias("names"), F.count(F.lit(1)).alias("n_names"))


@register("M22_concatenatex_rows", oracle="""
select p_brand, row_number() over (partition by p_brand order by p_name) as position, p_name as value
from (select distinct p_brand, p_name from part where p_name is not null)""")
def m22_rows(spark, sf_dir):
    """The values in order as rows: no brand meets in one task or one string."""
    return M.concatenatex_rows(M.values(_t(spark, sf_dir, "part"), "p_brand", "p_name"), ["p_brand"], "p_name")


# ------------------------------------------------------------------ M4 rolled up, M27-M30 on gaps

@register("M4_distinctcount_rollup", oracle="""
select cast(date_trunc('month', o_orderdate) as date) as month, count(distinct o_custkey) as customers from orders group by 1""")
def m4_rollup(spark, sf_dir):
    """Customers per month from bitmaps stored per day."""
    from fleetcat.session import cut_lineage
    stored = cut_lineage(M.distinct_buckets(_t(spark, sf_dir, "orders"), ["o_orderdate"], "o_custkey"), "distinct-buckets")
    monthly = stored.withColumn("month", F.trunc("o_orderdate", "month"))
    return M.distinct_count_of_buckets(monthly, ["month"], "customers")


@register("M27_M30_on_calendar", oracle="""
with m as (select o_custkey, cast(date_trunc('month', o_orderdate) as date) as month, sum(o_totalprice) as total from orders group by all),
s as (select o_custkey, cast(unnest(generate_series(min(month), max(month), interval 1 month)) as date) as month from m group by o_custkey),
c as (select s.o_custkey, s.month, m.total from s left join m on m.o_custkey = s.o_custkey and m.month = s.month)
select c.o_custkey, c.month, round(c.total, 2) as total, round(p.total, 2) as prior_month, round(y.total, 2) as prior_year,
  round(sum(c.total) over (partition by c.o_custkey, year(c.month) order by c.month), 2) as year_to_date
from c left join c p on p.o_custkey = c.o_custkey and p.month = cast(c.month - interval 1 month as date)
left join c y on y.o_custkey = c.o_custkey and y.month = cast(c.month - interval 12 month as date)""")
def m27_m30_calendar(spark, sf_dir):
    """Monthly totals per customer with the months without orders; prior month, prior year and year to date."""
    from fleetcat.operators import time_intel as T
    from fleetcat.session import cut_lineage
    o = _t(spark, sf_dir, "orders")
    monthly = o.groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    calendar = cut_lineage(T.on_calendar(monthly.where(F.col("o_custkey").isNotNull()), ["o_custkey"], "month"), "calendar")
    rows = T.shifted_on_calendar(calendar, ["o_custkey"], "month", "total", 1, "prior_month")
    rows = T.shifted_on_calendar(rows, ["o_custkey"], "month", "total", 12, "prior_year", source=calendar)
    rows = T.to_date_on_calendar(rows, ["o_custkey"], "month", "total", "year_to_date")
    return rows.select("o_custkey", "month", *[F.round(c, 2).alias(c) for c in ("total", "prior_month", "prior_year", "year_to_date")])


# ------------------------------------------------------------------ M24, M25

@register("M24_treatas", oracle="""
select o_orderpriority, count(*) as n_orders, round(sum(o_totalprice), 2) as total
from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')
group by o_orderpriority""")
def m24(spark, sf_dir):
    chosen = _t(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    o = M.treat_as(_t(spark, sf_dir, "orders"), "o_custkey", chosen, "c_custkey")
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("M25_userelationship", oracle=f"""
select 'customer' as path, c_nationkey as nation_key, round(sum(o_totalprice), 2) as value
from orders join customer on o_custkey = c_custkey group by c_nationkey
union all
select 'supplier', s_nationkey, round(sum({_REV}), 2) from lineitem join supplier on l_suppkey = s_suppkey group by s_nationkey""")
def m25(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    l, s = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "supplier")
    by_cust = (M.use_relationship(o, c, "o_custkey", "c_custkey").groupBy("c_nationkey")
               .agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
               .select(F.lit("customer").alias("path"), F.col("c_nationkey").alias("nation_key"), "value"))
    by_supp = (M.use_relationship(l, s, "l_suppkey", "s_suppkey").groupBy("s_nationkey")
               .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("value"))
               .select(F.lit("supplier").alias("path"), F.col("s_nationkey").alias("nation_key"), "value"))
    return by_cust.unionByName(by_supp)


# ------------------------------------------------------------------ M26-M32 time intelligence on orders

def _monthly(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return (o.groupBy(TI.period_start("o_orderdate", "month").alias("month"))
            .agg(F.sum("o_totalprice").alias("total")))


_MONTHLY_SQL = """
WITH monthly AS (select cast(date_trunc('month', o_orderdate) as date) as month, sum(o_totalprice) as total
                 from orders group by 1)
"""


@register("M26_dates_to_date", oracle=f"""
select round(sum(case when cast(o_orderdate as date) between date_trunc('year', date '{AS_OF}') and date '{AS_OF}' then o_totalprice end), 2) as ytd,
  round(sum(case when cast(o_orderdate as date) between date_trunc('quarter', date '{AS_OF}') and date '{AS_OF}' then o_totalprice end), 2) as qtd,
  round(sum(case when cast(o_orderdate as date) between date_trunc('month', date '{AS_OF}') and date '{AS_OF}' then o_totalprice end), 2) as mtd
from orders""")
def m26(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    v = F.col("o_totalprice")
    return o.agg(*[F.round(TI.total_to_date(v, "o_orderdate", AS_OF, u), 2).alias(n)
                   for n, u in (("ytd", "year"), ("qtd", "quarter"), ("mtd", "month"))])


@register("M27_totalytd", oracle=_MONTHLY_SQL + """
select month, round(total, 2) as total,
  round(sum(total) over (partition by year(month) order by month range between unbounded preceding and current row), 2) as ytd
from monthly""")
def m27(spark, sf_dir):
    m = TI.running_total_by_year(_monthly(spark, sf_dir), "month", "total", "ytd")
    return m.select("month", F.round("total", 2).alias("total"), F.round("ytd", 2).alias("ytd"))


@register("M28_sameperiodlastyear", oracle=_MONTHLY_SQL + """
select a.month, round(a.total, 2) as total, round(b.total, 2) as last_year
from monthly a left join monthly b on b.month + interval 12 month = a.month""")
def m28(spark, sf_dir):
    m = TI.same_period_last_year(_monthly(spark, sf_dir), "month", "total", "last_year")
    return m.select("month", F.round("total", 2).alias("total"), F.round("last_year", 2).alias("last_year"))


@register("M28_sameperiodlastyear_day", oracle="""
WITH daily AS (select cast(o_orderdate as date) as day, sum(o_totalprice) as total from orders group by 1)
select a.day, round(a.total, 2) as total, round(y.total, 2) as last_year, round(m.total, 2) as prev_month
from daily a left join daily y on y.day = cast(a.day - interval 12 month as date)
left join daily m on m.day = cast(a.day - interval 1 month as date)""")
def m28_day(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").groupBy(TI.as_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    d = TI.same_period_last_year(d, "day", "total", "last_year")
    d = TI.with_shifted(d, "day", "total", 1, "month", "prev_month")
    return d.select("day", *[F.round(c, 2).alias(c) for c in ("total", "last_year", "prev_month")])


@register("M29_dateadd", oracle=_MONTHLY_SQL + """
select a.month, round(a.total, 2) as total, round(m1.total, 2) as prev_month, round(q1.total, 2) as prev_quarter,
  round(y1.total, 2) as prev_year
from monthly a
left join monthly m1 on m1.month + interval 1 month = a.month
left join monthly q1 on q1.month + interval 3 month = a.month
left join monthly y1 on y1.month + interval 12 month = a.month""")
def m29(spark, sf_dir):
    m = _monthly(spark, sf_dir)
    for n, unit, name in ((1, "month", "prev_month"), (1, "quarter", "prev_quarter"), (1, "year", "prev_year")):
        m = TI.with_shifted(m, "month", "total", n, unit, name)
    return m.select("month", *[F.round(c, 2).alias(c) for c in ("total", "prev_month", "prev_quarter", "prev_year")])


@register("M29_dateadd_day", oracle="""
WITH daily AS (select cast(o_orderdate as date) as day, sum(o_totalprice) as total from orders group by 1)
select a.day, round(a.total, 2) as total, round(b.total, 2) as prev_day
from daily a left join daily b on b.day + 1 = a.day""")
def m29_day(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").groupBy(TI.as_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    d = TI.with_shifted(d, "day", "total", 1, "day", "prev_day")
    return d.select("day", F.round("total", 2).alias("total"), F.round("prev_day", 2).alias("prev_day"))


@register("M30_parallelperiod", oracle=_MONTHLY_SQL + """
, quarterly AS (select cast(date_trunc('quarter', month) as date) as q, sum(total) as qt from monthly group by 1)
select m.month, round(m.total, 2) as total, round(p.qt, 2) as prev_quarter_total
from monthly m left join quarterly p on p.q + interval 3 month = cast(date_trunc('quarter', m.month) as date)""")
def m30(spark, sf_dir):
    m = TI.parallel_period(_monthly(spark, sf_dir), "month", "total", 1, "quarter", "prev_quarter_total")
    return m.select("month", F.round("total", 2).alias("total"), F.round("prev_quarter_total", 2).alias("prev_quarter_total"))


@register("M31_eomonth", oracle="""
select distinct cast(o_orderdate as date) as day, last_day(cast(o_orderdate as date)) as eom,
  last_day(cast(o_orderdate as date) - interval 1 month) as eom_prev, last_day(cast(o_orderdate as date) + interval 3 month) as eom_plus3
from orders""")
def m31(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").select(TI.as_date("o_orderdate").alias("day")).distinct()
    return d.select("day", TI.end_of_month("day").alias("eom"), TI.end_of_month("day", -1).alias("eom_prev"),
                    TI.end_of_month("day", 3).alias("eom_plus3"))


@register("M32_today_blank", oracle=f"""
select o_orderkey, date '{AS_OF}' - cast(o_orderdate as date) as days_before_as_of, cast(null as varchar) as blank_value
from orders""")
def m32(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    today = TI.today(AS_OF)
    return o.select("o_orderkey", F.datediff(today, TI.as_date("o_orderdate")).cast("long").alias("days_before_as_of"),
                    TI.blank().cast("string").alias("blank_value"))
