"""Checks between models: amounts that must agree from hop to hop, the accrual rule made again, rates within bounds, missing days; each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .functions.columns import ratio
from .operators.reconcile import reconcile
from .queries import warehouse
from .registry import fixed, query, rounded_sql as _r

MONTH = ["month_start", "channel"]
COSTS = ["delivered_spend", "media_invoiced", "fee_invoiced", "invoiced_amount", "estimated_unbilled_accrual"]
MONEY = ["net_revenue", "contribution_margin"]


def _sums(df: DataFrame, **columns: str) -> DataFrame:
    return df.agg(*[F.sum(c).alias(n) for n, c in columns.items()])


def hops(w) -> list[DataFrame]:
    """Every amount against the one a hop before it."""
    sold = w.fct_order_line.where("not is_cancelled")
    bought = w.stg_order_lines.join(w.stg_orders.where("not is_cancelled").select("order_id"), "order_id")
    first = w.dim_customer.where("first_order_date is not null")
    early = sold.join(first.select("customer_id", "first_order_date"), "customer_id").where("order_date >= first_order_date and order_date < date_add(first_order_date, 90)")
    at90 = w.mart_ltv.where("horizon_days = 90")
    ads = w.fct_ad_spend_daily.groupBy(F.trunc("ad_date", "MM").alias("month_start"), F.col("platform").alias("channel")).agg(F.sum("spend").alias("delivered_spend"))
    trading = w.mart_daily_trading.groupBy(F.trunc("date_day", "MM").alias("month_start"), "channel").agg(F.sum("new_customers").alias("new_customers"))
    cohorts = w.mart_ltv.where("horizon_days = 30").groupBy(F.col("cohort_month").alias("month_start"), F.col("acquisition_channel").alias("channel")).agg(F.sum("cohort_size").alias("new_customers"))
    spent = w.mart_marketing_invoice_recon.where("delivered_spend is not null")
    return [
        reconcile("ads: staging to fact", _sums(w.stg_ads_daily, spend="spend"), _sums(w.fct_ad_spend_daily, spend="spend"), [], ["spend"]),
        reconcile("ads: fact to trading", _sums(w.fct_ad_spend_daily, spend="spend"), _sums(w.mart_daily_trading, spend="ad_spend"), [], ["spend"]),
        reconcile("ads: fact to reconciliation", ads, spent, MONTH, ["delivered_spend"]),
        reconcile("lines: staging to fact", bought.agg(F.sum(F.col("gross") - F.col("discount")).alias("paid")), _sums(sold, paid="net_revenue_incl_vat"), [], ["paid"]),
        reconcile("lines: fact to trading", _sums(sold, **{c: c for c in MONEY}), _sums(w.mart_daily_trading, **{c: c for c in MONEY}), [], MONEY),
        reconcile("lines: fact to variants", _sums(sold, **{c: c for c in MONEY}), _sums(w.mart_variant_daily, **{c: c for c in MONEY}), [], MONEY),
        reconcile("lines: first 90 days to cohorts", _sums(early, **{c: c for c in MONEY}), _sums(at90, net_revenue="cum_net_revenue", contribution_margin="cum_contribution_margin"), [], MONEY),
        reconcile("customers: dimension to cohorts", first.agg(F.count("*").alias("new_customers")), _sums(cohorts, new_customers="new_customers"), [], ["new_customers"]),
        reconcile("customers: trading to cohorts", trading.where("new_customers > 0"), cohorts.where("new_customers > 0"), MONTH, ["new_customers"]),
        reconcile("costs: budget to reconciliation", w.mart_marketing_budget_vs_actual, w.mart_marketing_invoice_recon, MONTH, COSTS, 0.0),
    ]


def _hop_sql(name: str, a: str, b: str, keys: list[str], columns: list[str], tolerance: float = 0.01) -> str:
    meet = f"full join b using ({', '.join(keys)})" if keys else "cross join b"
    lost = "a.here is null or b.here is null or " if keys else ""
    return " union all ".join(
        f"select '{name}' as reconciliation, '{c}' as amount, count(*) as compared, count(*) filter ({lost}(a.{c} is null) <> (b.{c} is null) or coalesce(abs(a.{c}::double - b.{c}::double) > {tolerance!r}::double, false)) as broken, "
        f"max(abs(a.{c}::double - b.{c}::double)) as largest from (select *, 1 as here from ({a})) a {meet.replace('join b', f'join (select *, 1 as here from ({b})) b')}" for c in columns)


_MONEY = "sum(net_revenue) as net_revenue, sum(contribution_margin) as contribution_margin"
_SOLD = f"select {_MONEY} from fct_order_line where not is_cancelled"
_ADS = "select sum(spend) as spend from fct_ad_spend_daily"
_COHORTS = "select cohort_month as month_start, acquisition_channel as channel, sum(cohort_size) as new_customers from mart_ltv where horizon_days = 30 group by all having sum(cohort_size) > 0"
HOPS_SQL = " union all ".join([
    _hop_sql("ads: staging to fact", "select sum(spend) as spend from stg_ads_daily", _ADS, [], ["spend"]),
    _hop_sql("ads: fact to trading", _ADS, "select sum(ad_spend) as spend from mart_daily_trading", [], ["spend"]),
    _hop_sql("ads: fact to reconciliation", "select date_trunc('month', ad_date)::date as month_start, platform as channel, sum(spend) as delivered_spend from fct_ad_spend_daily group by all", "select * from mart_marketing_invoice_recon where delivered_spend is not null", MONTH, ["delivered_spend"]),
    _hop_sql("lines: staging to fact", "select sum(gross - discount) as paid from stg_order_lines semi join (select order_id from stg_orders where not is_cancelled) using (order_id)", "select sum(net_revenue_incl_vat) as paid from fct_order_line where not is_cancelled", [], ["paid"]),
    _hop_sql("lines: fact to trading", _SOLD, f"select {_MONEY} from mart_daily_trading", [], MONEY),
    _hop_sql("lines: fact to variants", _SOLD, f"select {_MONEY} from mart_variant_daily", [], MONEY),
    _hop_sql("lines: first 90 days to cohorts", f"select {_MONEY} from fct_order_line l join dim_customer c using (customer_id) where not is_cancelled and order_date - first_order_date between 0 and 89", "select sum(cum_net_revenue) as net_revenue, sum(cum_contribution_margin) as contribution_margin from mart_ltv where horizon_days = 90", [], MONEY),
    _hop_sql("customers: dimension to cohorts", "select count(first_order_date) as new_customers from dim_customer", f"select sum(new_customers) as new_customers from ({_COHORTS})", [], ["new_customers"]),
    _hop_sql("customers: trading to cohorts", "select date_trunc('month', date_day)::date as month_start, channel, sum(new_customers) as new_customers from mart_daily_trading group by all having sum(new_customers) > 0", _COHORTS, MONTH, ["new_customers"]),
    _hop_sql("costs: budget to reconciliation", "select * from mart_marketing_budget_vs_actual", "select * from mart_marketing_invoice_recon", MONTH, COSTS, 0.0),
])


@query(f"select reconciliation, amount, compared, broken, {_r('largest')} as largest from ({HOPS_SQL})")
def check_reconciliations(spark, sf_dir):
    """Amounts along every hop. A customer whose first orders fall on one day in two channels is new in both in the trading mart, in one in the
    cohorts, so new customers may be apart there by as many."""
    w = warehouse(spark, sf_dir)
    w.persist("fct_order", "fct_order_line", "mart_daily_trading", "fct_ad_spend_daily", "mart_ltv")
    return reduce(DataFrame.unionByName, hops(w)).select("reconciliation", "amount", "compared", "broken", fixed("largest").alias("largest"))


def accrual(w) -> DataFrame:
    """What the accrual rule makes of ads and invoices per month and channel, from the lines themselves: their billed channel and period say what is media and final.

    A platform's media line over the whole month is final and is the expense; else the larger of delivered and invoiced, and what isn't invoiced yet is
    accrued; without delivery known, what media was invoiced, if any. Fees come on top; with fees alone the invoices are the expense."""
    paid = F.col("channel").isin("meta", "google")
    ads = w.fct_ad_spend_daily.groupBy(F.trunc("ad_date", "MM").alias("month_start"), F.col("platform").alias("channel")).agg(F.sum("spend").alias("delivered"))
    line = w.stg_vendor_invoice_lines.select("invoice_line_id", (F.col("billed_channel") == "agency").alias("agency"))
    parts = w.fct_invoice_allocated.join(line, "invoice_line_id")
    entire = (F.col("service_period_start") == F.col("service_month")) & (F.col("service_period_end") == F.last_day("service_month"))
    invoices = parts.groupBy(F.col("service_month").alias("month_start"), "channel").agg(
        F.sum(F.when(~F.col("agency"), F.col("allocated_amount"))).alias("media"), F.sum(F.when(F.col("agency"), F.col("allocated_amount"))).alias("fees"),
        F.count("*").alias("n"), F.count_if(~F.col("agency")).alias("n_media"), F.count_if(~F.col("agency") & entire).alias("n_final"))
    rows = w.fct_marketing_cost_monthly.select(*MONTH).join(ads, MONTH, "left").join(invoices, MONTH, "left")
    media, known = F.coalesce("media", F.lit(0)), paid & F.col("delivered").isNotNull()
    final = paid & (F.coalesce("n_final", F.lit(0)) > 0)
    rows = rows.withColumn("is_media_final", final.cast("int")).withColumn("recognised_media_expense", F.when(final, F.col("media")).when(known, F.greatest("delivered", media)).when(F.col("n_media") > 0, F.col("media")))
    fees = F.coalesce("fees", F.lit(0))
    return rows.select(
        *MONTH, "is_media_final", "recognised_media_expense",
        F.when(known, F.when(final, 0).otherwise(F.greatest(F.col("delivered") - media, F.lit(0)))).alias("estimated_unbilled_accrual"),
        F.when(F.col("recognised_media_expense").isNotNull(), F.col("recognised_media_expense") + fees).when(F.col("n") > 0, media + fees).alias("recognised_expense"))


RULED = ["is_media_final", "recognised_media_expense", "estimated_unbilled_accrual", "recognised_expense"]


@query(f"""
    with d as (select date_trunc('month', ad_date)::date as month_start, platform as channel, sum(spend) as delivered from fct_ad_spend_daily group by all),
    v as (select service_month as month_start, channel, sum(allocated_amount) filter (billed_channel <> 'agency') as media, sum(allocated_amount) filter (billed_channel = 'agency') as fees, count(*) as n, count(*) filter (billed_channel <> 'agency') as nm,
          bool_or(billed_channel <> 'agency' and a.service_period_start = service_month and a.service_period_end = last_day(service_month)) as whole
          from fct_invoice_allocated a join (select invoice_line_id, billed_channel from stg_vendor_invoice_lines) using (invoice_line_id) group by all),
    e as (select month_start, channel, channel in ('meta', 'google') as paid, paid and coalesce(whole, false) as final, delivered, media, coalesce(media, 0) as m0, coalesce(fees, 0) as f0, n, nm from fct_marketing_cost_monthly left join d using (month_start, channel) left join v using (month_start, channel)),
    x as (select *, case when final then media when paid and delivered is not null then greatest(delivered, m0) when nm > 0 then media end as em from e),
    r as (select month_start, channel, final::int as is_media_final, em as recognised_media_expense, case when paid and delivered is not null then case when final then 0 else greatest(delivered - m0, 0) end end as estimated_unbilled_accrual,
          case when em is not null then em + f0 when n > 0 then m0 + f0 end as recognised_expense from x)
    select reconciliation, amount, compared, broken, {_r('largest')} as largest from ({_hop_sql('accrual rule', 'select * from r', 'select * replace (is_media_final::int as is_media_final) from fct_marketing_cost_monthly', MONTH, RULED, 0.0)})""")
def check_accrual_rule(spark, sf_dir):
    """The monthly costs against the accrual rule made again from ads and invoice lines."""
    w = warehouse(spark, sf_dir)
    own = w.fct_marketing_cost_monthly.withColumn("is_media_final", F.col("is_media_final").cast("int"))
    return reconcile("accrual rule", accrual(w), own, MONTH, RULED, 0.0).withColumn("largest", fixed("largest"))


# Tax on revenue, and how far a rate may be from what is expected.
VAT, VAT_OFF, MARGIN_OFF, SHARE_OFF = 1.2, 0.001, 0.005, 0.02


@query(f"""
    with l as (select * from fct_order_line where not is_cancelled), m as (select avg(rate) as mean from (select sum(contribution_margin)::double / sum(net_revenue) as rate from l group by date_trunc('quarter', order_date) having sum(net_revenue) <> 0)),
    o as (select channel, date_part('year', order_date) as y, count(*)::double as n from fct_order where not is_cancelled group by all), s as (select channel, y, n, n / sum(n) over (partition by y) as share from o),
    g as (select 'tax' as guard, 'all' as entity, sum(net_revenue_incl_vat)::double / sum(net_revenue) as actual, {VAT!r}::double as expected, {VAT_OFF!r}::double as allowed from l
        union all select 'margin rate', 'all', sum(contribution_margin)::double / sum(net_revenue), any_value(mean), {MARGIN_OFF!r}::double from l, m
        union all select 'channel share', channel || ' ' || y, share, sum(n) over (partition by channel) / sum(n) over (), {SHARE_OFF!r}::double from s)
    select guard, entity, {_r('actual')} as actual, {_r('expected')} as expected, abs(actual - expected) <= allowed as within from g""")
def check_rates(spark, sf_dir):
    """Rates that everything scales with, against what is expected: revenue with tax over revenue without; the margin rate of all lines against the mean of its
    quarters, so that one quarter with wrong costs shows; each channel's share of a year's orders against its share of all, so that swapped channels show."""
    w = warehouse(spark, sf_dir)
    l = w.fct_order_line.where("not is_cancelled")
    sums = [F.sum(c).cast("double").alias(c) for c in ("net_revenue_incl_vat", "net_revenue", "contribution_margin")]
    quarters = l.groupBy(F.trunc("order_date", "quarter").alias("q")).agg(*sums)  # some dozens of rows; the totals are theirs
    rates = quarters.agg(*[F.sum(c).alias(c) for c in ("net_revenue_incl_vat", "net_revenue", "contribution_margin")], F.avg(ratio("contribution_margin", "net_revenue")).alias("mean"))
    guard = lambda name, entity, actual, expected, allowed: F.struct(F.lit(name).alias("guard"), entity.alias("entity"), actual.alias("actual"), expected.cast("double").alias("expected"), F.lit(allowed).alias("allowed"))
    money = rates.select(F.explode(F.array(
        guard("tax", F.lit("all"), ratio("net_revenue_incl_vat", "net_revenue"), F.lit(VAT), VAT_OFF), guard("margin rate", F.lit("all"), ratio("contribution_margin", "net_revenue"), F.col("mean"), MARGIN_OFF))).alias("g")).select("g.*")
    orders = w.fct_order.where("not is_cancelled").groupBy("channel", F.year("order_date").alias("y")).agg(F.count("*").alias("n"))
    years, channels = orders.groupBy("y").agg(F.sum("n").alias("of_year")), orders.groupBy("channel").agg(F.sum("n").alias("of_channel"))
    s = orders.join(years, "y").join(channels, "channel").crossJoin(orders.agg(F.sum("n").alias("of_all")))  # one row
    shares = s.select(guard("channel share", F.concat_ws(" ", "channel", "y"), ratio("n", "of_year"), ratio("of_channel", "of_all"), SHARE_OFF).alias("g")).select("g.*")
    return money.unionByName(shares).select("guard", "entity", fixed("actual").alias("actual"), fixed("expected").alias("expected"), (F.abs(F.col("actual") - F.col("expected")) <= F.col("allowed")).alias("within"))


@query("select source_name, date_day from mart_data_quality where is_gap")
def check_source_days(spark, sf_dir):
    """Days that a source lacks."""
    return warehouse(spark, sf_dir).mart_data_quality.where("is_gap").select("source_name", "date_day")


# Rows that break a rule: what is unknown stays null, what is known is there.
KNOWN = {
    "unknown costs are null": (lambda w: w.fct_marketing_cost_monthly.where("channel in ('tiktok', 'unallocated') and (delivered_spend is not null or estimated_unbilled_accrual is not null or (invoice_rows = 0 and recognised_expense is not null))"),
        "select 1 from fct_marketing_cost_monthly where channel in ('tiktok', 'unallocated') and (delivered_spend is not null or estimated_unbilled_accrual is not null or (invoice_rows = 0 and recognised_expense is not null))"),
    "every month has a row without cost": (lambda w: w.dim_date.select("month_start").distinct().join(w.fct_marketing_cost_monthly.where("channel = 'tiktok'"), "month_start", "left_anti"),
        "select month_start from dim_date where month_start not in (select month_start from fct_marketing_cost_monthly where channel = 'tiktok') group by 1"),
    "every invoice line is allocated": (lambda w: w.stg_vendor_invoice_lines.join(w.fct_invoice_allocated, "invoice_line_id", "left_anti"),
        "select 1 from stg_vendor_invoice_lines l where not exists (select 1 from fct_invoice_allocated f where f.invoice_line_id = l.invoice_line_id)"),
    "service periods run forwards": (lambda w: w.stg_vendor_invoice_lines.where("service_period_end < service_period_start"), "select 1 from stg_vendor_invoice_lines where service_period_end < service_period_start"),
    "google reports conversions": (lambda w: w.stg_ads_daily.where("platform = 'google' and conversions is null"), "select 1 from stg_ads_daily where platform = 'google' and conversions is null"),
    "budget left is budget less expense": (lambda w: w.mart_marketing_budget_vs_actual.where("not (remaining_budget <=> approved_budget - recognised_media_expense)"),
        "select 1 from mart_marketing_budget_vs_actual where remaining_budget is distinct from approved_budget - recognised_media_expense"),
    "no share of no budget": (lambda w: w.mart_marketing_budget_vs_actual.where("(budget_variance_pct is null) <> (budget_variance is null or coalesce(approved_budget, 0) = 0)"),
        "select 1 from mart_marketing_budget_vs_actual where (budget_variance_pct is null) <> (budget_variance is null or coalesce(approved_budget, 0) = 0)"),
    "revenue of cohorts is censored like margin": (lambda w: w.mart_ltv.where("has_full_exposure <> (ltv_revenue is not null)"), "select 1 from mart_ltv where has_full_exposure <> (ltv_revenue is not null)"),
    "spend of trading lands a day later": (lambda w: w.mart_daily_trading.where("ad_spend is not null and spend_available_on <> date_add(date_day, 1)"), "select 1 from mart_daily_trading where ad_spend is not null and spend_available_on <> date_day + 1"),
    "cost of a click is cost of views over click rate": (lambda w: w.fct_ad_spend_daily.where("clicks > 0 and impressions > 0 and abs(cast(spend as double) / clicks - (1000 * cast(spend as double) / impressions) / (1000 * (cast(clicks as double) / impressions))) > 0.01"),
        "select 1 from fct_ad_spend_daily where clicks > 0 and impressions > 0 and abs(spend::double / clicks - (1000 * spend::double / impressions) / (1000 * (clicks::double / impressions))) > 0.01"),
}


@query(" union all ".join(f"select '{name}' as rule, count(*) as broken from ({sql})" for name, (_, sql) in KNOWN.items()))
def check_known(spark, sf_dir):
    """Rows that break each of these rules. What both marts are made of is computed once, before them: lines meet orders and products in one pass."""
    w = warehouse(spark, sf_dir)
    w.persist("dim_date", "stg_ads_daily", "fct_ad_spend_daily", "sold_lines", "mart_ltv", "mart_daily_trading")
    return reduce(DataFrame.unionByName, [rows(w).agg(F.count("*").alias("broken")).select(F.lit(name).alias("rule"), "broken") for name, (rows, _) in KNOWN.items()])
