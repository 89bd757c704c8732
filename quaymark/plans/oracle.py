"""DuckDB SQL for the models, written on its own from their definitions: one common table expression a model.

`model_sql(name, columns)` gives a query for one model with the expressions it needs. Amounts are compared as doubles.
"""

from __future__ import annotations

import re

from ..config import EngineConfig
from ..sources import binding as B

CFG = EngineConfig()


def _values(rows, names: str) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return "select * from (values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") as v({names})"


def _case(column: str, pairs, otherwise: str) -> str:
    return "case " + column + " " + " ".join(f"when {a} then {b}" for a, b in pairs) + f" else {otherwise} end"


def _div(a: str, b: str) -> str:
    return f"(cast({a} as double) / nullif(cast({b} as double), 0))"


def _dec(x: str, p: int = 12, s: int = 2) -> str:
    return f"cast({x} as decimal({p},{s}))"


DAY = f"(date '{B.AD_ORIGIN}' + cast(date_diff('day', date '{B.EVENT_ORIGIN}', cast(ts as date)) as integer))"
SITE = _case("left(o_orderpriority, 1)", [(f"'{k}'", f"'{v}'") for k, v in B.REFERRERS.items()], "null")
CAMPAIGN = _case("campaign_id", [(i, f"'{c}'") for i, c in enumerate(B.CAMPAIGNS)], "null")
AS_OF = f"date '{CFG.as_of}'"

CTES: dict[str, str] = {
    "stg_orders": f"""
        select o_orderkey as order_id, case when o_orderdate >= timestamp '2001-01-01' and o_orderkey % 3 = 0 then -1 - o_custkey else o_custkey end as customer_id, o_orderdate as created_at, cast(o_orderdate as date) as order_date, o_orderstatus = 'P' as is_cancelled,
               case when site like '%facebook%' then 'meta' when site like '%google%' or site like '%youtube%' then 'google' when site like '%tiktok%' then 'tiktok' else 'unattributed' end as channel,
               {_dec('o_totalprice')} as total_price
        from (select *, {SITE} as site from orders) where cast(o_orderdate as date) <= {AS_OF}""",
    "stg_order_lines": f"""
        select l_orderkey as order_id, l_partkey as variant_id, cast(l_quantity as bigint) as quantity, {_dec('l_extendedprice')} as gross, {_dec('l_extendedprice * l_discount')} as discount
        from lineitem where l_orderkey in (select order_id from stg_orders)""",
    "stg_customers": """
        select unnest([c_custkey, -1 - c_custkey]) as customer_id, case when c_acctbal >= 0 then lower(replace(c_name, '#', '.')) || '@example.com' end as customer_email, c_acctbal >= 0 as has_valid_email,
               case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'subscribed' else 'not_subscribed' end as email_consent_state
        from customer""",
    "stg_products": f"""
        select p_partkey as variant_id, p_name as product_title, p_brand as sku, p_type as product_type, {_dec('p_retailprice')} as price, {_dec('p_retailprice * 0.3::double')} as unit_cost,
               cast(p_size * 10 as bigint) as inventory_quantity, {_dec(f'cast({_dec("p_retailprice")} as double) / {1 + CFG.vat_rate}::double')} as price_ex_vat,
               {_dec(_div(f'cast({_dec("p_retailprice")} as double) / {1 + CFG.vat_rate}::double - cast({_dec("p_retailprice * 0.3::double")} as double)', f'cast({_dec("p_retailprice")} as double) / {1 + CFG.vat_rate}::double'), 6, 4)} as margin_pct
        from part""",
    "happenings": f"select {DAY} as day, user_id, event_type, {_dec('value')} as value from events",
    "stg_ads_daily": f"""
        select *, {CAMPAIGN} as campaign_name from (
            select case when user_id % 2 = 0 then 'meta' else 'google' end as platform, cast(case when user_id % 2 = 0 then user_id % 6 else user_id % 5 end as bigint) as campaign_id, day as ad_date,
                   count(*) filter (event_type = 'view') as impressions, count(*) filter (event_type = 'click') as clicks,
                   {_dec("coalesce(sum(value) filter (event_type = 'click'), 0)")} as spend, case when any_value(user_id % 2) = 1 then count(*) filter (event_type = 'purchase') end as conversions,
                   day + 1 as available_on
            from happenings group by 1, 2, 3)
        where available_on <= {AS_OF} and not (platform = 'meta' and (ad_date in ({', '.join(f"date '{d}'" for d in B.META_GAP)}) or (ad_date = date '{B.META_PARTIAL}' and campaign_id = 0)))""",
    "stg_email_flows": f"""
        select cast(user_id % 6 as bigint) as flow_id, cast(user_id % 12 as bigint) as message_id, cast(date_trunc('week', day) as date) as week_start, count(*) * 10 as recipients,
               4 * count(*) filter (event_type = 'view') as unique_opens, count(*) filter (event_type = 'click') as unique_clicks, count(*) filter (event_type = 'error') as unique_unsubscribes,
               count(*) filter (event_type = 'purchase') as unique_orders, {_dec("coalesce(sum(value) filter (event_type = 'purchase'), 0)")} as order_value
        from happenings group by 1, 2, 3 having cast(date_trunc('week', any_value(day)) as date) + 7 <= {AS_OF}""",
    "stg_marketing_budget": f"""
        select cast(m as date) as month_start, channel, budget_version, {_dec('amount')} as approved_amount, pacing_profile, cast(approved_on as date) as approved_on
        from ({_values(B.BUDGETS, 'm, channel, budget_version, amount, pacing_profile, approved_on')}) where cast(approved_on as date) <= {AS_OF}""",
    "stg_vendor_invoice_lines": f"""
        select invoice_line_id, invoice_id, vendor, billed_channel, cast(a as date) as service_period_start, cast(b as date) as service_period_end, cast(c as date) as invoice_date, cast(d as date) as received_date,
               {_dec('amount')} as amount, case when billed_channel = 'agency' then 'fee' else 'media' end as cost_type, cast(date_trunc('month', cast(a as date)) as date) as service_month
        from ({_values(B.INVOICES, 'invoice_line_id, invoice_id, vendor, billed_channel, a, b, c, d, amount')}) where cast(d as date) <= {AS_OF}""",
    "shares": f"select invoice_line_id, channel, {_dec('pct', 6, 4)} as allocation_pct from ({_values(B.ALLOCATIONS, 'invoice_line_id, channel, pct')})",
    "dim_date": f"""
        select d as date_day, year(d) as year, month(d) as month, strftime(d, '%Y-%m') as year_month, isodow(d) as iso_dow, weekofyear(d) as iso_week, cast(date_trunc('week', d) as date) as week_start,
               cast(date_trunc('month', d) as date) as month_start, isodow(d) >= 6 as is_weekend, month(d) in (11, 12) as is_peak_season
        from (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as d from (select min(order_date) as lo, least({AS_OF}, max(order_date)) as hi from stg_orders))""",
    "dim_customer": """
        with f as (select customer_id, min(order_date) as d, arg_min(channel, row(created_at, order_id)) as c from stg_orders where not is_cancelled group by 1)
        select s.*, has_valid_email and email_consent_state = 'subscribed' as is_marketable, f.d as first_order_date, cast(date_trunc('month', f.d) as date) as first_order_month, coalesce(f.c, 'unattributed') as acquisition_channel
        from stg_customers s left join f using (customer_id)""",
    "fct_order": """
        select o.*, not is_cancelled and coalesce(created_at = min(case when not is_cancelled then created_at end) over (partition by customer_id), false) as is_first_order from stg_orders o""",
    "fct_order_line": f"""
        select *, {_dec('net_revenue - cogs')} as contribution_margin from (
            select l.order_id, o.customer_id, l.variant_id, o.order_date, o.channel, o.is_cancelled, l.quantity, l.gross as gross_revenue_incl_vat, l.discount as line_discount,
                   {_dec('l.gross - l.discount')} as net_revenue_incl_vat, {_dec(f'cast(l.gross - l.discount as double) / {1 + CFG.vat_rate}::double')} as net_revenue, {_dec('p.unit_cost * l.quantity')} as cogs
            from stg_order_lines l join fct_order o using (order_id) join stg_products p using (variant_id))""",
    "dim_campaign": """
        select distinct platform || ':' || campaign_id as campaign_key, platform, campaign_id, campaign_name,
               case when campaign_name ilike 'prospecting%' then 'prospecting' when campaign_name ilike 'retargeting%' then 'retargeting' when campaign_name ilike 'dpa%' then 'catalogue'
                    when campaign_name ilike 'brand%' then 'brand' when campaign_name ilike 'non-brand%' then 'non_brand' when campaign_name ilike 'shopping%' then 'shopping' when campaign_name ilike 'pmax%' then 'pmax' else 'other' end as funnel_stage
        from stg_ads_daily""",
    "fct_ad_spend_daily": f"""
        select platform || ':' || campaign_id as campaign_key, platform, campaign_id, funnel_stage, ad_date, impressions, clicks, spend, conversions, available_on,
               {_dec(_div('spend', 'clicks'), 12, 4)} as cpc, {_dec(_div('cast(spend as double) * 1000', 'impressions'), 12, 4)} as cpm, {_dec(_div('clicks', 'impressions'), 8, 6)} as ctr
        from stg_ads_daily join (select platform, campaign_id, funnel_stage from dim_campaign) using (platform, campaign_id)""",
    "fct_email_flow_weekly": f"""
        select *, 'Flow ' || flow_id as flow_name, {_dec(_div('unique_opens', 'recipients'), 8, 6)} as open_rate, {_dec(_div('unique_clicks', 'recipients'), 8, 6)} as click_rate,
               {_dec(_div('unique_orders', 'recipients'), 8, 6)} as conversion_rate, {_dec(_div('unique_unsubscribes', 'recipients'), 8, 6)} as unsubscribe_rate, {_dec(_div('order_value', 'recipients'), 12, 4)} as revenue_per_recipient
        from stg_email_flows""",
    "fct_invoice_allocated": f"""
        select l.invoice_line_id, l.cost_type, l.service_month, l.service_period_start, l.service_period_end, l.received_date, coalesce(s.channel, 'unallocated') as channel, s.allocation_pct, l.amount as line_amount,
               {_dec('''case when s.channel is null then l.amount when s.channel = max(s.channel) over w then round(l.amount * sum(s.allocation_pct) over w, 2) - (sum(round(l.amount * s.allocation_pct, 2)) over w - round(l.amount * s.allocation_pct, 2))
                    else round(l.amount * s.allocation_pct, 2) end''')} as allocated_amount, case when s.channel is null then 'unallocated' else 'allocated' end as allocation_status
        from stg_vendor_invoice_lines l left join shares s using (invoice_line_id) window w as (partition by l.invoice_line_id)""",
    "fct_marketing_cost_monthly": f"""
        with d as (select cast(date_trunc('month', ad_date) as date) as month_start, platform as channel, sum(spend) as spent, count(distinct ad_date) as days from fct_ad_spend_daily group by 1, 2),
        i as (select service_month as month_start, channel, sum(allocated_amount) filter (cost_type = 'media') as media, sum(allocated_amount) filter (cost_type = 'fee') as fee, count(*) as n, count(*) filter (cost_type = 'media') as n_media,
                     count(*) filter (cost_type = 'media' and service_period_start = service_month and service_period_end = last_day(service_month)) as n_final from fct_invoice_allocated group by 1, 2),
        g as (select distinct month_start, c.channel, c.has from dim_date cross join (values ('meta', true), ('google', true), ('tiktok', false)) as c(channel, has) union all select month_start, channel, false from i where channel = 'unallocated'),
        b as (select g.month_start, g.channel, g.has as has_cost_source, case when g.has then {_dec('d.spent')} end as delivered_spend, coalesce(d.days, 0) as delivered_days, {_dec('coalesce(i.media, 0)')} as m, {_dec('coalesce(i.fee, 0)')} as f,
                     coalesce(i.n, 0) as invoice_rows, coalesce(i.n_media, 0) as n_media, g.has and coalesce(i.n_final, 0) > 0 as is_media_final, day(last_day(g.month_start)) as days_in_month
              from g left join d using (month_start, channel) left join i using (month_start, channel)),
        r as (select *, case when is_media_final then m when delivered_spend is not null then greatest(delivered_spend, m) end as rec from b)
        select month_start, channel, has_cost_source, delivered_spend, m as media_invoiced, f as fee_invoiced, {_dec('m + f')} as invoiced_amount, is_media_final,
               {_dec('case when delivered_spend is null then null when is_media_final then 0 else greatest(delivered_spend - m, 0) end')} as estimated_unbilled_accrual,
               {_dec('coalesce(rec + f, case when invoice_rows > 0 then m + f end)')} as recognised_expense, {_dec('coalesce(rec, case when n_media > 0 then m end)')} as recognised_media_expense, delivered_days, days_in_month, invoice_rows,
               case when channel = 'unallocated' then channel when not has_cost_source then 'no_cost_source' when last_day(month_start) >= {AS_OF} then 'partial_month' when delivered_days < days_in_month then 'source_gap' else 'complete' end as data_status
        from r""",
    "mart_data_quality": """
        with n as (select platform, ad_date as date_day, count(*) as c from fct_ad_spend_daily group by 1, 2),
        u as (select platform, c as expected_count from (select platform, c, row_number() over (partition by platform order by count(*) desc, c desc) as k from n group by platform, c) where k = 1),
        a as (select platform || '_ads_daily' as source_name, date_day, c, expected_count from (select date_day, u.* from dim_date cross join u) left join n using (platform, date_day)
              union all select 'orders', date_day, c, null from dim_date left join (select order_date as date_day, count(*) as c from fct_order group by 1) using (date_day))
        select source_name, date_day, c is not null as observed, c is null as is_gap, coalesce(c, 0) as row_count, expected_count, case when c is null then 'missing_day' when c < expected_count then 'partial_day' else 'ok' end as issue_type from a""",
    "mart_daily_trading": f"""
        with o as (select order_date as date_day, channel, count(*) as n, count(distinct case when is_first_order then customer_id end) as nc, count(distinct case when not is_first_order then customer_id end) as rc from fct_order where not is_cancelled group by 1, 2),
        l as (select order_date as date_day, channel, sum(net_revenue) as rev, sum(contribution_margin) as margin, sum(quantity) as qty, sum(line_discount) as disc from fct_order_line where not is_cancelled group by 1, 2),
        s as (select ad_date as date_day, platform as channel, sum(spend) as ad_spend, sum(clicks) as clicks, sum(impressions) as impressions, max(available_on) as spend_available_on from fct_ad_spend_daily group by 1, 2),
        w as (select date_day, bool_and(issue_type = 'ok') as whole from mart_data_quality where source_name <> 'orders' group by 1),
        t as (select date_day, (select sum(ad_spend) from s where s.date_day = d.date_day) as spend, (select sum(nc) from o where o.date_day = d.date_day) as nc from dim_date d)
        select date_day, channel, coalesce(n, 0) as orders, coalesce(o.nc, 0) as new_customers, coalesce(rc, 0) as returning_customers, coalesce(rev, 0) as net_revenue, coalesce(margin, 0) as contribution_margin, {_dec(_div('rev', 'n'))} as aov,
               coalesce(qty, 0) as units, coalesce(disc, 0) as discounts, {_dec(_div('qty', 'n'), 12, 4)} as units_per_order, {_dec(_div('rev', 'qty'), 12, 4)} as revenue_per_unit, {_dec(_div('disc', 'rev + disc'), 12, 6)} as discount_rate,
               ad_spend, clicks, impressions, spend_available_on, {_dec(_div('ad_spend', 'o.nc'))} as channel_cac, {_dec(_div('rev', 'ad_spend'), 12, 4)} as channel_roas, {_dec(_div('margin', 'ad_spend'), 12, 4)} as channel_margin_roas,
               coalesce(whole, false) as ad_spend_is_complete, case when whole then {_dec(_div('t.spend', 't.nc'))} end as blended_cac, is_peak_season, iso_dow, week_start
        from (select d.*, c.channel from dim_date d cross join (values {', '.join(f"('{c}')" for c in CFG.channels)}) as c(channel))
        left join o using (date_day, channel) left join l using (date_day, channel) left join s using (date_day, channel) left join w using (date_day) left join t using (date_day)""",
    "mart_product_daily": """
        with p as (select sku, sum(inventory_quantity) as inventory_quantity from stg_products group by 1),
        s as (select order_date as date_day, sku, sum(quantity) as units, sum(net_revenue) as net_revenue, sum(contribution_margin) as contribution_margin from fct_order_line join stg_products using (variant_id) where not is_cancelled group by 1, 2),
        g as (select d.date_day, p.sku, p.inventory_quantity, coalesce(s.units, 0) as units, coalesce(s.net_revenue, 0) as net_revenue, coalesce(s.contribution_margin, 0) as contribution_margin from dim_date d cross join p left join s on s.date_day = d.date_day and s.sku = p.sku),
        v as (select *, cast(sum(units) over (partition by sku order by date_day rows 6 preceding) as double) / count(*) over (partition by sku order by date_day rows 6 preceding) as velocity_7d,
                     cast(sum(units) over (partition by sku order by date_day rows 27 preceding) as double) / count(*) over (partition by sku order by date_day rows 27 preceding) as velocity_28d from g)
        select *, velocity_7d / nullif(velocity_28d, 0) as velocity_ratio, inventory_quantity / nullif(velocity_28d, 0) as days_of_cover from v""",
    "mart_variant_daily": """
        with s as (select order_date as date_day, variant_id, sum(quantity) as units, sum(net_revenue) as net_revenue, sum(contribution_margin) as contribution_margin from fct_order_line where not is_cancelled group by 1, 2),
        g as (select d.date_day, p.variant_id, p.product_title, p.sku, p.product_type, p.inventory_quantity, coalesce(s.units, 0) as units, coalesce(s.net_revenue, 0) as net_revenue, coalesce(s.contribution_margin, 0) as contribution_margin
              from dim_date d cross join stg_products p left join s on s.date_day = d.date_day and s.variant_id = p.variant_id),
        v as (select *, avg(cast(units as double)) over (partition by variant_id order by date_day rows between 6 preceding and current row) as velocity_7d,
                     avg(cast(units as double)) over (partition by variant_id order by date_day rows between 27 preceding and current row) as velocity_28d from g)
        select *, velocity_7d / nullif(velocity_28d, 0) as velocity_ratio, inventory_quantity / nullif(velocity_28d, 0) as days_of_cover from v""",
    "mart_cohort_retention": f"""
        with c as (select customer_id, first_order_date as f, first_order_month as m from dim_customer where first_order_date is not null), z as (select max(date_day) as z from dim_date),
        o as (select c.*, order_date as d from c join fct_order using (customer_id) where not is_cancelled),
        a as (select m, date_diff('month', m, d) as k, count(distinct customer_id) as n from o group by 1, 2), r as (select m, count(distinct customer_id) as n from o where d > f and d <= f + 90 group by 1),
        s as (select m, count(*) as n, max(f) + 90 as e from c group by 1),
        g as (select s.m, s.n, s.e, k, z, cast(s.m + to_months(cast(k + 1 as integer)) - interval 1 day as date) as w from s cross join z cross join (select unnest(generate_series(1, (select date_diff('month', min(m), max(z)) from s cross join z))) as k))
        select g.m as cohort_month, g.k as months_since, g.n as cohort_size, coalesce(a.n, 0) as repeat_customers, g.w as window_end, g.w <= z as has_full_exposure, case when g.w <= z then {_div('coalesce(a.n, 0)', 'g.n')} end as retention_rate, {_div('coalesce(a.n, 0)', 'g.n')} as raw_retention_rate,
               coalesce(r.n, 0) as repeat_within_90d, g.e as exposure_90d_end, g.e <= z as has_full_90d_exposure, case when g.e <= z then {_div('coalesce(r.n, 0)', 'g.n')} end as repeat_rate_90d
        from g left join a on a.m = g.m and a.k = g.k left join r on r.m = g.m""",
    "mart_ltv": f"""
        with c as (select customer_id, first_order_date as f, first_order_month as m, acquisition_channel as ch from dim_customer where first_order_date is not null), h as (select unnest({list(CFG.horizons)}) as h),
        s as (select m, ch, h, count(*) as n, max(f) + cast(h as integer) as e from c cross join h group by 1, 2, 3),
        w as (select m, ch, h, sum(net_revenue) as rev, sum(contribution_margin) as margin from c cross join h join fct_order_line l on l.customer_id = c.customer_id and not l.is_cancelled and l.order_date >= f and l.order_date < f + cast(h as integer) group by 1, 2, 3)
        select m as cohort_month, ch as acquisition_channel, h as horizon_days, n as cohort_size, e as exposure_end, e <= (select max(date_day) from dim_date) as has_full_exposure, coalesce(rev, 0) as cum_net_revenue, coalesce(margin, 0) as cum_contribution_margin,
               case when e <= (select max(date_day) from dim_date) then {_div('coalesce(rev, 0)', 'n')} end as ltv_revenue, case when e <= (select max(date_day) from dim_date) then {_div('coalesce(margin, 0)', 'n')} end as ltv_margin
        from s left join w using (m, ch, h)""",
    "mart_email_flow_weekly": f"""
        with r as (select flow_name, week_start, sum(recipients) as recipients, sum(unique_opens) as unique_opens, sum(unique_clicks) as unique_clicks, sum(unique_unsubscribes) as unique_unsubscribes, sum(unique_orders) as unique_orders, sum(order_value) as order_value from fct_email_flow_weekly group by 1, 2),
        q as (select *, {_div('unique_opens', 'recipients')} as open_rate, {_div('unique_clicks', 'recipients')} as click_rate, {_div('unique_orders', 'recipients')} as conversion_rate, {_div('unique_unsubscribes', 'recipients')} as unsubscribe_rate, {_div('order_value', 'recipients')} as revenue_per_recipient from r)
        select *, avg(open_rate) over w as open_rate_8w, avg(click_rate) over w as click_rate_8w, avg(conversion_rate) over w as conversion_rate_8w from q window w as (partition by flow_name order by week_start rows 7 preceding)""",
    "budget": """
        select month_start, channel, approved_amount as approved_budget, budget_version as budget_version_used, pacing_profile from stg_marketing_budget
        qualify row_number() over (partition by month_start, channel order by approved_on desc, (budget_version = 'revised')::int desc) = 1""",
    "mart_marketing_budget_vs_actual": f"""
        select c.*, approved_budget, budget_version_used, pacing_profile, {_dec('approved_budget - recognised_media_expense')} as remaining_budget, {_dec('recognised_media_expense - approved_budget')} as budget_variance, {_dec(_div('recognised_media_expense - approved_budget', 'approved_budget'), 12, 6)} as budget_variance_pct
        from fct_marketing_cost_monthly c left join budget using (month_start, channel)""",
    "mart_marketing_pacing_daily": f"""
        with d as (select month_start, cast(unnest(generate_series(month_start, last_day(month_start), interval 1 day)) as date) as date_day from (select distinct month_start from dim_date)),
        s as (select ad_date as date_day, platform as channel, sum(spend) as spend from fct_ad_spend_daily group by 1, 2),
        b as (select d.*, c.channel, cast(day(date_day) as double) as dd, cast(day(last_day(date_day)) as double) as nn, approved_budget, budget_version_used, pacing_profile, spend,
                     case when c.channel = 'tiktok' then 'no_cost_source' when spend is not null then 'delivered' when date_day + 1 > {AS_OF} then 'not_yet_visible' else 'missing' end as spend_status
              from d cross join (values ('meta'), ('google'), ('tiktok')) as c(channel) left join budget using (month_start, channel) left join s using (date_day, channel)),
        p as (select *, {_dec("cast(approved_budget as double) * case when dd >= nn and pacing_profile in ('linear', 'front_loaded') then 1.0::double when pacing_profile = 'linear' then dd / nn when pacing_profile = 'front_loaded' then dd * 0.5::double / nn + ((nn * dd * 2.0::double - dd * dd) / (nn * nn)) * 0.5::double end")} as plan from b),
        r as (select *, coalesce(lag(plan) over w, 0) as before, sum(spend) over (w rows unbounded preceding) as running, cast(sum(spend) over v as double) / nullif(count(spend) over v, 0) as recent from p
              window w as (partition by channel, month_start order by date_day), v as (partition by channel order by date_day rows 6 preceding)),
        k as (select *, spend_status in ('delivered', 'missing') as known, cast(running as double) + recent * (nn - dd) as ahead from r)
        select date_day, month_start, channel, cast(dd as bigint) as day_of_month, cast(nn as bigint) as days_in_month, approved_budget, budget_version_used, pacing_profile, {_dec('plan - before')} as planned_spend, plan as planned_cumulative, {_dec('spend')} as delivered_spend,
               case when known then {_dec('running')} end as delivered_cumulative, spend_status, case when known then {_dec(_div('running', 'plan'), 12, 6)} end as pacing_ratio, case when known then {_dec("recent")} end as run_rate_7d,
               case when known then {_dec('ahead')} end as forecast_month_end, case when known then {_dec('ahead - cast(approved_budget as double)')} end as forecast_overspend from k""",
    "mart_marketing_invoice_recon": f"""
        with x as (select *, media_invoiced - delivered_spend as off, delivered_spend is not null and media_invoiced > 0 as met from fct_marketing_cost_monthly)
        select month_start, channel, delivered_spend, media_invoiced, fee_invoiced, invoiced_amount, estimated_unbilled_accrual, is_media_final, case when met then {_dec('off')} end as difference, case when met then {_dec(_div('off', 'delivered_spend'), 12, 6)} end as difference_pct,
               case when channel = 'unallocated' then invoiced_amount else 0 end as unallocated_invoiced_amount, case when channel = 'unallocated' then 'unallocated_cost' when not has_cost_source then 'no_cost_source' when media_invoiced = 0 then 'unbilled'
               when abs(cast(off as double)) <= abs(cast(delivered_spend as double)) * {CFG.recon_tolerance_pct}::double / 100.0::double then 'within_tolerance' else 'exception' end as recon_status, data_status from x""",
}

_CELLS = ", ".join(f"({i}, '{p}', {c}, {cents}, '{B.CAMPAIGNS[c]}')" for i, (p, c, cents) in enumerate(B.LONG_CELLS))
_GAPS = " or ".join([*(f"(platform = '{p}' and ad_date = date '{d}')" for p, d in B.LONG_GAPS), "(platform = '{}' and campaign_id = {} and ad_date = date '{}')".format(*B.LONG_PARTIAL)])
#: Staging of sources.binding.LongTables, in place of the expressions of the same names.
LONG = {
    "stg_ads_daily": f"""
        select platform, campaign_id, ad_date, clicks * 40 * wider // 100 as impressions, clicks, {_dec('cast(clicks * (cents * pct // 100) as double) / 100.0::double')} as spend, case when platform = 'google' then n end as conversions, ad_date + 1 as available_on, campaign_name
        from (select *, 60 + 25 * n as clicks, case when platform = 'meta' and ad_date >= date '{B.META_STEP[0]}' then {B.META_STEP[1]} when platform = 'google' and ad_date >= date '{B.GOOGLE_STEP[0]}' then {B.GOOGLE_STEP[2]} else 100 end as pct,
                     case when platform = 'google' and ad_date >= date '{B.GOOGLE_STEP[0]}' then {B.GOOGLE_STEP[1]} else 100 end as wider
              from (select d.ad_date, c.platform, cast(c.campaign_id as bigint) as campaign_id, c.cents, c.campaign_name, coalesce(o.n, 0) as n
                    from (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as ad_date from (select min(o_orderdate) as a, max(o_orderdate) as b from orders)) d
                    cross join (values {_CELLS}) as c(cell, platform, campaign_id, cents, campaign_name)
                    left join (select cast(o_orderdate as date) as ad_date, o_orderkey % 4 as cell, count(*) as n from orders group by 1, 2) o on o.ad_date = d.ad_date and o.cell = c.cell))
        where not ({_GAPS}) and ad_date + 1 <= {AS_OF}""",
    "stg_email_flows": f"""
        select flow_id, message_id, week_start, recipients, (4 * v + 400) * ({2 * B.LONG_WEEKS} - w) // {2 * B.LONG_WEEKS} as unique_opens, unique_clicks, unique_unsubscribes,
               case when flow_id >= 3 then (p + 60) * ({2 * B.LONG_WEEKS} - w) // {2 * B.LONG_WEEKS} else p + 60 end as unique_orders, order_value
        from (select cast(date_trunc('week', (select max(o_orderdate) from orders)) as date) + 7 * (w - {B.LONG_WEEKS}) as week_start, * from (
            select cast(event_id % {B.LONG_WEEKS} as integer) as w, user_id % 6 as flow_id, user_id % 12 as message_id, (count(*) + 100) * 10 as recipients, count(*) filter (event_type = 'view') as v, count(*) filter (event_type = 'click') + 10 as unique_clicks,
                   count(*) filter (event_type = 'error') as unique_unsubscribes, count(*) filter (event_type = 'purchase') as p, {_dec("coalesce(sum(value) filter (event_type = 'purchase'), 0)")} as order_value
            from (select event_id, user_id, event_type, {_dec('value')} as value from events) group by 1, 2, 3))
        where week_start + 7 <= {AS_OF}""",
}


def needed(sql: str, ctes: dict[str, str] | None = None) -> list[str]:
    """Names of the expressions that a query stands on, in the order in which they are given."""
    ctes = CTES if ctes is None else ctes
    found: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z_0-9]+\b", text):
            if name in ctes and name not in found:
                found.add(name)
                visit(ctes[name])

    visit(sql)
    return [n for n in ctes if n in found]


def with_models(sql: str, extra: dict[str, str] | None = None) -> str:
    """A whole query: the expressions that `sql` needs, then `sql`."""
    ctes = CTES | (extra or {})
    names = needed(sql, ctes)
    sql, sep = sql.strip(), "\n"
    if sql.startswith("with "):
        sql, sep = sql[len("with "):], ",\n" if names else "with "
    return ("with " + ",\n".join(f"{n} as ({ctes[n]})" for n in names) if names else "") + sep + sql
