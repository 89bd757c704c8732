"""Queries of calendars, reports and checks, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W, functions as F

from .config import EngineConfig
from .functions.columns import ratio
from .operators import measures as M
from .queries import warehouse
from .registry import fixed, query, rounded_sql as _r

# Channels in the order of reports, with their names and whether their cost is known.
CHANNELS = (("google", "Google", 1, True), ("meta", "Meta", 2, True), ("unattributed", "Unattributed", 3, False), ("tiktok", "TikTok", 4, False))
AS_OF = EngineConfig().as_of
SHOWN = ("exception", "unbilled", "unallocated_cost")


def dim_channel(spark):
    return spark.createDataFrame(list(CHANNELS), "channel string, channel_name string, sort_order long, has_cost_data boolean").coalesce(1)


def calendar(days, today: dt.date):
    """Attributes of days(date_day) for reports. Weeks start on Mondays and count from the first of January; month_offset is against `today`."""
    d = F.col("date_day")
    year, month, quarter = F.year(d), F.month(d), F.quarter(d)
    first = F.trunc(d, "year")
    week = F.floor((F.datediff(d, first) + F.weekday(first)) / 7).cast("int") + 1
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    columns = {
        "year": year, "quarter": F.concat(F.lit("Q"), quarter), "month": month, "month_name": F.date_format(d, "MMMM"), "year_month": F.concat_ws("-", year, pad(month)), "year_quarter": F.concat(year, F.lit("-Q"), quarter),
        "year_quarter_nr": year * 10 + quarter, "year_month_nr": year * 100 + month, "week": week, "year_week": F.concat(F.lit("W"), pad(week)), "year_week_nr": year * 100 + week,
        "month_start": F.trunc(d, "month"), "month_offset": (year - today.year) * 12 + (month - today.month),
    }
    return days.select(d, *[c.cast("long").alias(n) if n in WHOLE else c.alias(n) for n, c in columns.items()])


WHOLE = ("year", "month", "year_quarter_nr", "year_month_nr", "week", "year_week_nr", "month_offset")


@query(f"""
    with c as (select date_day, date_part('year', date_day)::bigint as y, date_part('quarter', date_day)::bigint as q, date_part('month', date_day)::bigint as m, date_trunc('year', date_day)::date as f from dim_date),
    k as (select *, (date_day - f + isodow(f) - 1) // 7 + 1 as w from c)
    select date_day, y as year, 'Q' || q as quarter, m as month, monthname(date_day) as month_name, strftime(date_day, '%Y-%m') as year_month, y || '-Q' || q as year_quarter, y * 10 + q as year_quarter_nr, y * 100 + m as year_month_nr,
           w::bigint as week, 'W' || lpad(w::varchar, 2, '0') as year_week, (y * 100 + w)::bigint as year_week_nr, date_trunc('month', date_day)::date as month_start, ((y - {AS_OF.year}) * 12 + m - {AS_OF.month})::bigint as month_offset from k""")
def a12_calendar(spark, sf_dir):
    return calendar(warehouse(spark, sf_dir).dim_date.select("date_day"), AS_OF)


@query("""
    select c.channel, channel_name, sort_order, has_cost_data, coalesce(sum(orders), 0)::bigint as orders from (values ('google', 'Google', 1::bigint, true), ('meta', 'Meta', 2, true), ('unattributed', 'Unattributed', 3, false), ('tiktok', 'TikTok', 4, false)) as c(channel, channel_name, sort_order, has_cost_data)
    left join mart_daily_trading using (channel) group by all order by sort_order""")
def a07_channels(spark, sf_dir):
    """Channels with their orders, in the order of reports."""
    orders = warehouse(spark, sf_dir).mart_daily_trading.groupBy("channel").agg(F.sum("orders").cast("long").alias("orders"))
    return dim_channel(spark).join(F.broadcast(orders), "channel", "left").withColumn("orders", F.coalesce("orders", F.lit(0).cast("long"))).orderBy("sort_order")


@query(f"""
    with e as (select *, row_number() over (partition by flow_name order by week_start) as k from mart_email_flow_weekly),
    n as (select *, row_number() over (partition by flow_name order by week_start) as i, count(*) over (partition by flow_name) // 2 as half from e where k > 1 and open_rate is not null and conversion_rate is not null),
    h as (select flow_name, avg(open_rate::double) filter (i <= half) as o1, avg(open_rate::double) filter (i > half) as o2, avg(conversion_rate::double) filter (i <= half) as c1, avg(conversion_rate::double) filter (i > half) as c2 from n group by 1)
    select flow_name, {_r('o1')} as opens_first, {_r('o2')} as opens_second, {_r('c1')} as conversion_first, {_r('c2')} as conversion_second, c2 > 0.9::double * c1 as still_landing from h""")
def m04_email_halves(spark, sf_dir):
    """First half of a flow's weeks against the second, after its first week (the bound tables hold five to six weeks)."""
    by = W.partitionBy("flow_name").orderBy("week_start")
    weeks = warehouse(spark, sf_dir).mart_email_flow_weekly.withColumn("k", F.row_number().over(by)).where("k > 1 and open_rate is not null and conversion_rate is not null")
    weeks = weeks.withColumns({"i": F.row_number().over(by), "half": F.floor(F.count("*").over(W.partitionBy("flow_name")) / 2)})
    first = F.col("i") <= F.col("half")
    mean = lambda when, c: F.avg(F.when(when, F.col(c).cast("double")))
    h = weeks.groupBy("flow_name").agg(mean(first, "open_rate").alias("o1"), mean(~first, "open_rate").alias("o2"), mean(first, "conversion_rate").alias("c1"), mean(~first, "conversion_rate").alias("c2"))
    return h.select("flow_name", fixed("o1").alias("opens_first"), fixed("o2").alias("opens_second"), fixed("c1").alias("conversion_first"), fixed("c2").alias("conversion_second"), (F.col("c2") > 0.9 * F.col("c1")).alias("still_landing"))


@query(f"""select date_day, variant_id, {_r('velocity_7d')} as velocity_7d, {_r('velocity_7d / nullif(sum(velocity_7d) over (partition by date_day), 0)')} as catalogue_share from mart_variant_daily qualify date_day > (select max(date_day) from dim_date) - 35""")
def m05_velocity_and_share(spark, sf_dir):
    """Speed of sale of each variant and its share of the catalogue's, over the last five weeks."""
    w = warehouse(spark, sf_dir)
    d = w.product_last("variant_id", 35)
    whole = w.catalogue("variant_id").withColumnRenamed("total", "whole")
    return d.join(F.broadcast(whole), "date_day").select("date_day", "variant_id", fixed("velocity_7d").alias("velocity_7d"), fixed(ratio("velocity_7d", "whole")).alias("catalogue_share"))


@query(f"""
    with a as (select platform, cast(date_trunc('month', ad_date) as date) as month_start, sum(spend)::double as s, sum(clicks)::double as c, sum(impressions)::double as i from fct_ad_spend_daily group by 1, 2),
    r as (select platform, month_start, s / nullif(c, 0) as cpc, 1000 * s / nullif(i, 0) as cpm, c / nullif(i, 0) as ctr from a)
    select platform, month_start, {', '.join(f"{_r(f'100 * {x} / nullif(first_value({x}) over (partition by platform order by month_start), 0)', 4)} as {x}" for x in ('cpc', 'cpm', 'ctr'))} from r""")
def m06_click_costs_indexed(spark, sf_dir):
    """Cost of a click, of a thousand views, and click rate, each against the platform's first month."""
    a = warehouse(spark, sf_dir).fct_ad_spend_daily.groupBy("platform", F.trunc("ad_date", "MM").alias("month_start")).agg(
        ratio(F.sum("spend"), F.sum("clicks")).alias("cpc"), ratio(1000 * F.sum("spend").cast("double"), F.sum("impressions")).alias("cpm"), ratio(F.sum("clicks"), F.sum("impressions")).alias("ctr"))
    by = W.partitionBy("platform").orderBy("month_start")
    return a.select("platform", "month_start", *[fixed(100 * ratio(c, F.first(c).over(by)), 4).alias(c) for c in ("cpc", "cpm", "ctr")])


@query("""
    with p as (select * from mart_marketing_pacing_daily where approved_budget is not null),
    v as (select month_start, channel, max(date_day) as seen_to, arg_max(delivered_cumulative, date_day)::double as delivered, arg_max(forecast_month_end, date_day)::double as forecast from p where delivered_cumulative is not null and date_day <= (select max(date_day) from dim_date) - 12 group by 1, 2)
    select month_start, channel, max(date_day) as month_end, max(approved_budget)::double as approved_budget, any_value(seen_to) as seen_to, any_value(delivered) as delivered, any_value(forecast) as forecast from p left join v using (month_start, channel) group by 1, 2""")
def m09_pacing_from_a_day(spark, sf_dir, back: int = 12):
    """Each month and channel with a budget as it looked so many days before the last: delivered up to then and the forecast made from there."""
    w = warehouse(spark, sf_dir)
    p = w.mart_marketing_pacing_daily.where("approved_budget is not null").crossJoin(w.last_day)
    seen = F.col("delivered_cumulative").isNotNull() & (F.col("date_day") <= F.date_sub("last_day", back))
    at = lambda c: F.max_by(F.when(seen, F.col(c)), F.when(seen, F.col("date_day"))).cast("double")
    return p.groupBy("month_start", "channel").agg(
        F.max("date_day").alias("month_end"), F.max("approved_budget").cast("double").alias("approved_budget"), F.max(F.when(seen, F.col("date_day"))).alias("seen_to"), at("delivered_cumulative").alias("delivered"), at("forecast_month_end").alias("forecast"))


@query(f"select month_start, channel, delivered_spend::double as delivered_spend, media_invoiced::double as media_invoiced, difference::double as difference, fee_invoiced::double as fee_invoiced, estimated_unbilled_accrual::double as estimated_unbilled_accrual, recon_status, data_status from mart_marketing_invoice_recon where recon_status in {SHOWN} order by month_start desc, channel")
def m10_recon_by_status(spark, sf_dir):
    r = warehouse(spark, sf_dir).mart_marketing_invoice_recon.where(F.col("recon_status").isin(*SHOWN)).orderBy(F.desc("month_start"), "channel")
    return r.select("month_start", "channel", *[F.col(c).cast("double").alias(c) for c in ("delivered_spend", "media_invoiced", "difference", "fee_invoiced", "estimated_unbilled_accrual")], "recon_status", "data_status")


@query(f"select variant_id, {_r('avg(velocity_28d)')} as velocity_28d, {_r('min(days_of_cover)')} as days_of_cover, sum(units)::bigint as units_sold from mart_variant_daily group by 1")
def l25_product_measures(spark, sf_dir):
    m = M.measured(warehouse(spark, sf_dir).mart_variant_daily, M.product(), "variant_id")
    return m.select("variant_id", fixed("velocity_28d").alias("velocity_28d"), fixed("days_of_cover").alias("days_of_cover"), F.col("units_sold").cast("long").alias("units_sold"))


@query("select source_name, count(*) filter (is_gap) as gap_days from mart_data_quality group by 1")
def l27_gap_days(spark, sf_dir):
    return M.measured(warehouse(spark, sf_dir).mart_data_quality, M.quality(), "source_name").select("source_name", "gap_days")


# Rows that break a rule, by rule. A rule is a frame of a warehouse and its condition; SQL says the same of the models.
def _steps_back(w):
    before = F.lag("planned_cumulative").over(W.partitionBy("channel", "month_start").orderBy("date_day"))
    return w.mart_marketing_pacing_daily.withColumn("b", before).where("planned_cumulative < b")


def _new_customers(w):
    """Days whose new customers in the trading mart aren't those whose first order it is. A customer whose first orders are of one
    time in two channels is new in both, and breaks it: the bound orders have whole days, so sf0.01 has two such days."""
    a = w.mart_daily_trading.groupBy("date_day").agg(F.sum("new_customers").alias("a"))
    b = w.dim_customer.where("first_order_date is not null").groupBy(F.col("first_order_date").alias("date_day")).agg(F.count("*").alias("b"))
    return a.join(b, "date_day", "full").where("coalesce(a, 0) <> coalesce(b, 0)")


def _recon_spend(w):
    a = w.mart_marketing_invoice_recon.agg(F.sum("delivered_spend").alias("a"))
    return a.crossJoin(w.fct_ad_spend_daily.agg(F.sum("spend").alias("b"))).where("not (a <=> b)")  # one row each


CHECKS = {
    "pacing never steps back": (_steps_back, "select 1 from (select planned_cumulative, lag(planned_cumulative) over (partition by channel, month_start order by date_day) as b from mart_marketing_pacing_daily) where planned_cumulative < b"),
    "spend lands a day later": (lambda w: w.fct_ad_spend_daily.where("available_on <> date_add(ad_date, 1)"), "select 1 from fct_ad_spend_daily where available_on <> ad_date + 1"),
    "unknown spend is null": (lambda w: w.mart_daily_trading.where("ad_spend = 0 and spend_available_on is null"), "select 1 from mart_daily_trading where ad_spend = 0 and spend_available_on is null"),
    "new customers agree": (_new_customers, "select 1 from (select date_day, sum(new_customers) as a from mart_daily_trading group by 1) full join (select first_order_date as date_day, count(*) as b from dim_customer where first_order_date is not null group by 1) using (date_day) where coalesce(a, 0) <> coalesce(b, 0)"),
    "no line is counted twice": (lambda w: w.fct_invoice_allocated.groupBy("invoice_line_id", "channel").count().where("count > 1"), "select 1 from fct_invoice_allocated group by invoice_line_id, channel having count(*) > 1"),
    "recon ties to ad spend": (_recon_spend, "select 1 from (select sum(delivered_spend) as a from mart_marketing_invoice_recon), (select sum(spend) as b from fct_ad_spend_daily) where a is distinct from b"),
    "censored values are null": (lambda w: w.mart_ltv.where("not has_full_exposure and ltv_margin is not null"), "select 1 from mart_ltv where not has_full_exposure and ltv_margin is not null"),
    "exposed values are known": (lambda w: w.mart_ltv.where("has_full_exposure and ltv_margin is null"), "select 1 from mart_ltv where has_full_exposure and ltv_margin is null"),
    "exposure ends match flags": (lambda w: w.mart_ltv.crossJoin(F.broadcast(w.last_day)).where("has_full_exposure <> (exposure_end <= last_day)"), "select 1 from mart_ltv where has_full_exposure <> (exposure_end <= (select max(date_day) from dim_date))"),
    "meta reports no conversions": (lambda w: w.fct_ad_spend_daily.where("platform = 'meta' and conversions is not null"), "select 1 from fct_ad_spend_daily where platform = 'meta' and conversions is not null"),
    "cost of a click is spend over clicks": (lambda w: w.fct_ad_spend_daily.where("abs(cast(cpc as double) * clicks - spend) > 0.0051 * clicks + 0.005"), "select 1 from fct_ad_spend_daily where abs(cpc::double * clicks - spend) > 0.0051 * clicks + 0.005"),
    "budget variance is expense less budget": (lambda w: w.mart_marketing_budget_vs_actual.where("not (budget_variance <=> recognised_media_expense - approved_budget)"), "select 1 from mart_marketing_budget_vs_actual where budget_variance is distinct from recognised_media_expense - approved_budget"),
    "budget and recon agree": (lambda w: w.mart_marketing_budget_vs_actual.alias("a").join(w.mart_marketing_invoice_recon.alias("b"), ["month_start", "channel"]).where("not (a.delivered_spend <=> b.delivered_spend)"), "select 1 from mart_marketing_budget_vs_actual a join mart_marketing_invoice_recon b using (month_start, channel) where a.delivered_spend is distinct from b.delivered_spend"),
    "service period is in one month": (lambda w: w.stg_vendor_invoice_lines.where("trunc(service_period_start, 'MM') <> trunc(service_period_end, 'MM')"), "select 1 from stg_vendor_invoice_lines where date_trunc('month', service_period_start) <> date_trunc('month', service_period_end)"),
    "revenue ties to its lines": (lambda w: w.fct_order_line.agg(F.sum("net_revenue_incl_vat").alias("a"), F.sum(F.col("gross_revenue_incl_vat") - F.col("line_discount")).alias("b")).where("a <> b"), "select 1 from (select sum(net_revenue_incl_vat) as a, sum(gross_revenue_incl_vat - line_discount) as b from fct_order_line) where a <> b"),
}


@query(" union all ".join(f"select '{name}' as rule, count(*) as broken from ({sql})" for name, (_, sql) in CHECKS.items()))
def check_rules(spark, sf_dir):
    """Rows that break each rule of the models."""
    w = warehouse(spark, sf_dir)
    w.persist("fct_order", "mart_daily_trading", "fct_ad_spend_daily", "mart_ltv")
    out = None
    for name, (rows, _) in CHECKS.items():
        one = rows(w).agg(F.count("*").alias("broken")).select(F.lit(name).alias("rule"), "broken")
        out = one if out is None else out.unionByName(one)
    return out


# What has to be present in the tables for the detectors to have something to tell.
@query("""
    select scenario, present from (values ('outage', exists (select 1 from mart_data_quality where issue_type = 'missing_day')), ('partial day', exists (select 1 from mart_data_quality where issue_type = 'partial_day')),
        ('channel without cost', exists (select 1 from mart_daily_trading where channel = 'tiktok' and ad_spend is null and orders > 0)), ('unbilled spend', exists (select 1 from mart_marketing_invoice_recon where recon_status = 'unbilled')),
        ('censored cohort', exists (select 1 from mart_ltv where not has_full_exposure))) as s(scenario, present)""")
def c12_scenarios_present(spark, sf_dir):
    """Semi-joins of a list of scenarios against what the marts hold."""
    w = warehouse(spark, sf_dir)
    held = {
        "outage": w.mart_data_quality.where("issue_type = 'missing_day'"), "partial day": w.mart_data_quality.where("issue_type = 'partial_day'"),
        "channel without cost": w.mart_daily_trading.where("channel = 'tiktok' and ad_spend is null and orders > 0"), "unbilled spend": w.mart_marketing_invoice_recon.where("recon_status = 'unbilled'"),
        "censored cohort": w.mart_ltv.where("not has_full_exposure"),
    }
    names = spark.createDataFrame([(n,) for n in held], "scenario string").coalesce(1)
    found = None
    for name, rows in held.items():
        one = rows.limit(1).select(F.lit(name).alias("scenario"))
        found = one if found is None else found.unionByName(one)
    return names.join(found, "scenario", "left_semi").select("scenario", F.lit(True).alias("present")).unionByName(names.join(found, "scenario", "left_anti").select("scenario", F.lit(False).alias("present")))
