"""Queries on the ends of the library: what is checked, exported, counted and measured; registered with those of `registry`."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, functions as F

from .config import EngineConfig
from .operators import measures as M, reports
from .plans.oracle import AS_OF, CAMPAIGN, CTES, DAY
from .queries import MODELS, fields, shaped, warehouse
from .registry import fixed, query, rounded_sql as _r
from .session import shared_dir
from .sources import ads, files
from .sources.binding import DriverTables
from .sources.expectations import RULES, expectations, rule_sql

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" union all ".join(f"select '{t}' as name, count(*) as rows from {t}" for t in TABLES))
def a05_footer_counts(spark, sf_dir):
    """Rows of every given table, from the footers of its files."""
    return files.footer_counts(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES})


#: The exported marts and dimensions: inventory key of the columns that are written.
EXPORTED = {
    "mart_daily_trading": "h21_mart_daily_trading", "mart_product_daily": "h22_mart_variant_daily", "mart_cohort_retention": "h23_mart_cohort_retention", "mart_ltv": "h24_mart_ltv", "mart_email_flow_weekly": "h25_mart_email_flow_weekly",
    "mart_data_quality": "h20_mart_data_quality", "mart_marketing_budget_vs_actual": "h26_mart_budget_vs_actual", "mart_marketing_pacing_daily": "h27_mart_pacing_daily", "mart_marketing_invoice_recon": "h28_mart_invoice_recon",
    "dim_date": "h10_dim_date", "dim_product": "h12_dim_product", "dim_campaign": "h13_dim_campaign", "fct_ad_spend_daily": "h16_fct_ad_spend_daily",
}


def _export_sql(name: str, key: str) -> str:
    model, spec = MODELS[key]
    return f"select '{name}' as model, rows, digest from ({files.digest_sql(model, {c: kind == 'double' for c, kind in fields(spec)})})"


@query(" union all ".join(_export_sql(n, k) for n, k in EXPORTED.items()))
def a15_export_digests(spark, sf_dir):
    """The thirteen exported models, written in order and read back: rows and digest of each."""
    w = warehouse(spark, sf_dir)
    w.persist("variant_runs", "fct_ad_spend_daily", "mart_data_quality", "fct_marketing_cost_monthly")
    dense = "mart_product_daily"
    marts = {n: shaped(w.variant_days_in_order() if n == dense else getattr(w, MODELS[k][0]), MODELS[k][1]) for n, k in EXPORTED.items()}
    return files.export_all(marts, f"{shared_dir(spark)}/export-{uuid.uuid4().hex}", (dense,))


@query(" union all ".join(rule_sql(r, {"dim_product": "stg_products"}) for r in RULES))
def o05_expectations(spark, sf_dir):
    """All declared expectations over all models, in one query; violations are zero on sound data."""
    return expectations(warehouse(spark, sf_dir))


_VIEWED = ("net_revenue", "aov", "margin_pct", "blended_cac", "cpm", "complete_spend_days")


def _view_sql(view: str, period: str) -> str:
    w = f"(partition by channel, {period} order by date_day)"
    over = lambda a, b, scale="": _r(f"(sum({a}) over {w})::double{scale} / nullif((sum({b}) over {w})::double, 0)", 4)
    return f"""select date_day, channel, '{view}' as view, {_r(f'sum(net_revenue) over {w}', 4)} as net_revenue, {over('net_revenue', 'orders')} as aov, {over('contribution_margin', 'net_revenue')} as margin_pct, {over('s', 'n')} as blended_cac,
        {over('ad_spend', 'impressions', ' * 1000')} as cpm, cast(sum(k) over {w} as bigint) as complete_spend_days from d"""


@query(f"""
    with d as (select *, case when ad_spend_is_complete then ad_spend end as s, case when ad_spend_is_complete then new_customers end as n, cast(ad_spend_is_complete as integer) as k from mart_daily_trading)
    {' union all '.join(_view_sql(v, p) for v, p in (('current', 'date_day'), ('mtd', "date_trunc('month', date_day)"), ('qtd', "date_trunc('quarter', date_day)"), ('ytd', "date_trunc('year', date_day)")))}""")
def e14_to_date_views(spark, sf_dir):
    """Plain sums, ratios, conditional ratios and distinct days by channel: on the day, and to date in its month, quarter and year."""
    states = {n: s for n, s in M.trading_states().items() if n in _VIEWED}
    t = M.to_date_views(warehouse(spark, sf_dir).mart_daily_trading, states, "channel")
    return t.select("date_day", "channel", "view", *[fixed(c, 4).alias(c) for c in _VIEWED if c != "complete_spend_days"], F.col("complete_spend_days").cast("long").alias("complete_spend_days"))


_MICROS = "cast(sum(case when event_type = 'click' then cast(value * 1000000 as bigint) + 300 else 0 end) as bigint)"
ADS = {
    "meta_export": f"""
        select day as ad_date, cast((user_id // 2) % 3 as bigint) as campaign_id, count(*) filter (event_type = 'view') as impressions, count(*) filter (event_type = 'click') as clicks, coalesce(sum(value) filter (event_type = 'click'), 0) as spend,
               count(distinct user_id) filter (event_type = 'view') as reach
        from (select {DAY} as day, user_id, event_type, cast(value as decimal(12,2)) as value from events) where user_id % 2 = 0 group by all""",
    "google_export": f"""
        select day as ad_date, cast((user_id // 2) % 3 + 3 as bigint) as campaign_id, user_id % 3 = 0 as mobile, count(*) filter (event_type = 'view') as impressions, count(*) filter (event_type = 'click') as clicks, {_MICROS} as micros,
               count(*) filter (event_type = 'purchase')::double as conversions, coalesce(sum(value) filter (event_type = 'purchase'), 0) as bought
        from (select {DAY} as day, user_id, event_type, cast(value as decimal(12,2)) as value from events) where user_id % 2 = 1 group by all""",
    "ads_union": f"""
        select *, {CAMPAIGN} as campaign_name from (
            select 'meta' as platform, campaign_id, ad_date, impressions, clicks, spend::double as spend, reach, {_r('impressions::double / nullif(reach, 0)')} as frequency, cast(null as double) as platform_conversions, cast(null as double) as platform_conversion_value from meta_export
            union all select 'google', campaign_id, ad_date, sum(impressions), sum(clicks), sum(cast(micros / 1000000.0::double as decimal(12,2)))::double, null, null, sum(conversions), sum(bought)::double from google_export group by campaign_id, ad_date)
        where ad_date + 1 <= {AS_OF}""",
}
_ADS_COLUMNS = "platform, campaign_id, campaign_name, ad_date, impressions:l, clicks:l, spend:d, reach:l, frequency, platform_conversions, platform_conversion_value:d"


def _ads(spark, sf_dir):
    tables = DriverTables(spark, sf_dir)
    return ads.ads_union(ads.meta_raw(tables), ads.google_raw(tables), EngineConfig().as_of)


@query(f"select {', '.join(f'cast({n} as {t}) as {n}' if t else n for n, t in fields(_ADS_COLUMNS))} from ads_union", ADS)
def h05_ads_two_shapes(spark, sf_dir):
    """The union of both platforms' exports: money from micros, reach and frequency, typed nulls."""
    u = _ads(spark, sf_dir).withColumn("frequency", fixed("frequency"))
    return u.select(*[F.col(n).cast(t).alias(n) if t else F.col(n) for n, t in fields(_ADS_COLUMNS)])


@query(f"select platform, cast(date_trunc('week', ad_date) as date) as week, {_r('avg(frequency)', 4)} as frequency, cast(sum(reach) as bigint) as reach from ads_union group by all", ADS)
def l13_frequency(spark, sf_dir):
    """Impressions a person reached, averaged over campaign days; unknown where a platform doesn't report it."""
    return _ads(spark, sf_dir).groupBy("platform", F.date_trunc("week", "ad_date").cast("date").alias("week")).agg(fixed(F.avg("frequency"), 4).alias("frequency"), F.sum("reach").cast("long").alias("reach"))


assert set(CTES) >= {MODELS[k][0] for k in EXPORTED.values()}


_TOTALLED = ("approved_budget", "delivered_spend", "media_invoiced", "fee_invoiced")


@query(f"""
    with t as (select month_start, {', '.join(f'sum({c}) as {c}' for c in _TOTALLED)}, sum(budget_variance) as budget_variance, sum(approved_budget) filter (budget_variance is not null) as known from mart_marketing_budget_vs_actual group by 1),
    f as (select month_start, sum(delivered_spend) as d, sum(media_invoiced) as m, sum(fee_invoiced) as e from fct_marketing_cost_monthly group by 1)
    select month_start, {', '.join(f'{c}::double as {c}' for c in _TOTALLED)}, budget_variance::double as budget_variance, {_r('budget_variance::double / nullif(known::double, 0)')} as variance_pct,
           delivered_spend is not distinct from d and media_invoiced is not distinct from m and fee_invoiced is not distinct from e as agrees from t left join f using (month_start)""")
def m12_pack_totals(spark, sf_dir):
    """Totals of the pack's months with the variance as a ratio of sums over channels where it is known, and whether they are those of the costs."""
    w = warehouse(spark, sf_dir)
    totals = reports.totals(reports.pack(w))
    costs = w.fct_marketing_cost_monthly.groupBy("month_start").agg(*[F.sum(c).alias(f"c_{c}") for c in _TOTALLED[1:]])
    agrees = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in _TOTALLED[1:]])
    return totals.join(costs, "month_start", "left").select("month_start", *[F.col(c).cast("double").alias(c) for c in (*_TOTALLED, "budget_variance")], fixed("variance_pct").alias("variance_pct"), agrees.alias("agrees"))


_NAME = lambda c: f"replace(upper({c}[1]) || {c}[2:], 'Tiktok', 'TikTok')"
_WHOLE = lambda x: f"'GBP ' || format('{{:,}}', round(abs({x})::double)::bigint)"
_SHARE = lambda x: f"(round(abs({x})::double * 1000)::bigint // 10) || '.' || (round(abs({x})::double * 1000)::bigint % 10) || '%'"


@query(f"""
    with m as (select b.*, r.recon_status, r.difference::double / nullif(b.delivered_spend::double, 0) as part from mart_marketing_budget_vs_actual b join (select month_start, channel, recon_status, difference from mart_marketing_invoice_recon) r using (month_start, channel)),
    top as (select month_start, channel as tc, budget_variance as tv, budget_variance_pct as tp from m where budget_variance is not null qualify row_number() over (partition by month_start order by abs(budget_variance) desc, channel desc) = 1),
    blind as (select month_start, channel as bc, approved_budget as bb from m where recon_status = 'no_cost_source' qualify row_number() over (partition by month_start order by channel) = 1),
    off as (select month_start, channel as oc, part as op, data_status = 'source_gap' as gap from m where recon_status = 'exception' qualify row_number() over (partition by month_start order by channel) = 1),
    g as (select month_start, count(*) filter (recon_status = 'unbilled') as u, coalesce(sum(estimated_unbilled_accrual), 0) as a, count(*) filter (recon_status = 'unallocated_cost') as l, coalesce(sum(recognised_expense) filter (recon_status = 'unallocated_cost'), 0) as lc from m group by 1)
    select month_start, case when tc is null then 'No channel has both a budget and known spend.' else {_NAME('tc')} || ' has the largest variance: ' || {_WHOLE('tv')} || coalesce(' (' || {_SHARE('tp')} || ')', '') || case when tv > 0 then ' over budget.' else ' under budget.' end end as variance,
      case when bc is not null then {_NAME('bc')} || coalesce(' has a budget of ' || {_WHOLE('bb')}, ' has no budget') || ' and no cost source; its spend is unknown, not zero.' end as unknown,
      case when oc is not null then 'Risk: ' || {_NAME('oc')} || coalesce(' was invoiced ' || {_SHARE('op')} || ' away from delivered spend, over the tolerance of 2.0%.', ' was invoiced without delivered spend.') || case when gap then ' Days of spend are missing, which may be why.' else '' end
           when u > 0 then 'Risk: ' || {_WHOLE('a')} || ' of delivered media is not invoiced and is accrued by estimate.' else 'Risk: none; every invoice is within the tolerance.' end as risk,
      case when gap then 'Action: get the missing days of spend and reconcile again before asking about the invoice.' when oc is not null then 'Action: ask about the invoice of ' || {_NAME('oc')} || ' before it is paid.'
           when u > 0 then 'Action: accrue ' || {_WHOLE('a')} || ' and replace it by the invoices.' else 'Action: none.' end || case when l > 0 then ' Allocate ' || {_WHOLE('lc')} || ' that has no channel.' else '' end as action
    from g left join top using (month_start) left join blind using (month_start) left join off using (month_start)""")
def m13_sentences(spark, sf_dir):
    """Variance, unknown spend, risk and action of every month, in words."""
    w = warehouse(spark, sf_dir)
    return reports.sentences(reports.pack(w), w.cfg.recon_tolerance_pct)
