"""The library's own queries by inventory key, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import EngineConfig
from .plans.oracle import with_models
from .plans.warehouse import Warehouse
from .sources.binding import DriverTables

TYPES = {"d": "double", "l": "bigint", "s": "string"}


def warehouse(spark: SparkSession, sf_dir: str, cfg: EngineConfig = EngineConfig()) -> Warehouse:
    return Warehouse(DriverTables(spark, sf_dir), cfg)


def fields(spec: str) -> list[tuple[str, str | None]]:
    """Columns of a result; `:d` and `:l` say that a number is compared as a double or a bigint."""
    return [(n, TYPES.get(t)) for n, _, t in (c.strip().partition(":") for c in spec.split(","))]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[F.col(n).cast(t).alias(n) if t else F.col(n) for n, t in fields(spec)])


def shaped_sql(source: str, spec: str) -> str:
    columns = ", ".join(f"cast({n} as {t.replace('string', 'varchar')}) as {n}" if t else n for n, t in fields(spec))
    return f"select {columns} from {source}"


#: key: model and the columns of it that are compared.
MODELS = {
    "h01_stg_orders": ("stg_orders", "order_id, customer_id, created_at, order_date, is_cancelled, channel, total_price:d"),
    "h02_stg_order_lines": ("stg_order_lines", "order_id, variant_id, quantity, gross:d, discount:d"),
    "h03_stg_customers": ("stg_customers", "customer_id, customer_email, has_valid_email, email_consent_state"),
    "h04_stg_products": ("stg_products", "variant_id, product_title, sku, product_type, price:d, unit_cost:d, inventory_quantity, price_ex_vat:d, margin_pct:d"),
    "h05_stg_ads_daily": ("stg_ads_daily", "platform, campaign_id, ad_date, impressions, clicks, spend:d, conversions, available_on, campaign_name"),
    "h06_stg_email_flows": ("stg_email_flows", "flow_id, message_id, week_start, recipients, unique_opens, unique_clicks, unique_unsubscribes, unique_orders, order_value:d"),
    "h07_stg_marketing_budget": ("stg_marketing_budget", "month_start, channel, budget_version, approved_amount:d, pacing_profile, approved_on"),
    "h08_stg_vendor_invoice_lines": ("stg_vendor_invoice_lines", "invoice_line_id, invoice_id, vendor, billed_channel, service_period_start, service_period_end, invoice_date, received_date, amount:d, cost_type, service_month"),
    "h10_dim_date": ("dim_date", "date_day, year:l, month:l, year_month, iso_dow:l, iso_week:l, week_start, month_start, is_weekend, is_peak_season"),
    "h11_dim_customer": ("dim_customer", "customer_id, customer_email, has_valid_email, is_marketable, email_consent_state, first_order_date, first_order_month, acquisition_channel"),
    "h12_dim_product": ("stg_products", "variant_id, product_title, sku, product_type, price:d, unit_cost:d, inventory_quantity, margin_pct:d"),
    "h13_dim_campaign": ("dim_campaign", "campaign_key, platform, campaign_id, campaign_name, funnel_stage"),
    "h14_fct_order": ("fct_order", "order_id, customer_id, order_date, created_at, channel, is_cancelled, total_price:d, is_first_order"),
    "h15_fct_order_line": ("fct_order_line", "order_id, customer_id, variant_id, order_date, channel, is_cancelled, quantity, gross_revenue_incl_vat:d, line_discount:d, net_revenue_incl_vat:d, net_revenue:d, cogs:d, contribution_margin:d"),
    "h16_fct_ad_spend_daily": ("fct_ad_spend_daily", "campaign_key, platform, campaign_id, funnel_stage, ad_date, impressions, clicks, spend:d, conversions, available_on, cpc:d, cpm:d, ctr:d"),
    "h17_fct_email_flow_weekly": ("fct_email_flow_weekly", "flow_id, message_id, flow_name, week_start, recipients, unique_opens, unique_clicks, open_rate:d, click_rate:d, conversion_rate:d, unsubscribe_rate:d, revenue_per_recipient:d"),
    "h18_fct_invoice_allocated": ("fct_invoice_allocated", "invoice_line_id, cost_type, service_month, received_date, channel, allocation_pct:d, line_amount:d, allocated_amount:d, allocation_status"),
    "h19_fct_marketing_cost_monthly": ("fct_marketing_cost_monthly", "month_start, channel, has_cost_source, delivered_spend:d, media_invoiced:d, fee_invoiced:d, invoiced_amount:d, is_media_final, estimated_unbilled_accrual:d, recognised_expense:d, recognised_media_expense:d, delivered_days:l, days_in_month:l, invoice_rows:l, data_status"),
    "h20_mart_data_quality": ("mart_data_quality", "source_name, date_day, observed, is_gap, row_count:l, expected_count:l, issue_type"),
    "h21_mart_daily_trading": ("mart_daily_trading", "date_day, channel, orders:l, new_customers:l, returning_customers:l, net_revenue:d, contribution_margin:d, aov:d, units:l, discounts:d, units_per_order:d, revenue_per_unit:d, discount_rate:d, ad_spend:d, clicks:l, impressions:l, spend_available_on, channel_cac:d, channel_roas:d, channel_margin_roas:d, ad_spend_is_complete, blended_cac:d, is_peak_season, iso_dow:l, week_start"),
    "h22_mart_product_daily": ("mart_product_daily", "date_day, sku, inventory_quantity:l, units:l, net_revenue:d, contribution_margin:d, velocity_7d:d, velocity_28d:d, velocity_ratio:d, days_of_cover:d"),
    "h22_mart_variant_daily": ("mart_variant_daily", "date_day, variant_id, product_title, sku, product_type, inventory_quantity:l, units:l, net_revenue:d, contribution_margin:d, velocity_7d:d, velocity_28d:d, velocity_ratio:d, days_of_cover:d"),
    "h23_mart_cohort_retention": ("mart_cohort_retention", "cohort_month, months_since:l, cohort_size:l, repeat_customers:l, window_end, has_full_exposure, retention_rate:d, raw_retention_rate:d, repeat_within_90d:l, exposure_90d_end, has_full_90d_exposure, repeat_rate_90d:d"),
    "h24_mart_ltv": ("mart_ltv", "cohort_month, acquisition_channel, horizon_days:l, cohort_size:l, exposure_end, has_full_exposure, cum_net_revenue:d, cum_contribution_margin:d, ltv_revenue:d, ltv_margin:d"),
    "h25_mart_email_flow_weekly": ("mart_email_flow_weekly", "flow_name, week_start, recipients:l, unique_opens:l, unique_clicks:l, unique_unsubscribes:l, unique_orders:l, order_value:d, open_rate:d, click_rate:d, conversion_rate:d, unsubscribe_rate:d, revenue_per_recipient:d, open_rate_8w:d, click_rate_8w:d, conversion_rate_8w:d"),
    "h26_mart_budget_vs_actual": ("mart_marketing_budget_vs_actual", "month_start, channel, approved_budget:d, budget_version_used, pacing_profile, delivered_spend:d, recognised_media_expense:d, recognised_expense:d, remaining_budget:d, budget_variance:d, budget_variance_pct:d, data_status"),
    "h27_mart_pacing_daily": ("mart_marketing_pacing_daily", "date_day, month_start, channel, day_of_month:l, days_in_month:l, approved_budget:d, budget_version_used, pacing_profile, planned_spend:d, planned_cumulative:d, delivered_spend:d, delivered_cumulative:d, spend_status, pacing_ratio:d, run_rate_7d:d, forecast_month_end:d, forecast_overspend:d"),
    "h28_mart_invoice_recon": ("mart_marketing_invoice_recon", "month_start, channel, delivered_spend:d, media_invoiced:d, fee_invoiced:d, invoiced_amount:d, estimated_unbilled_accrual:d, is_media_final, difference:d, difference_pct:d, unallocated_invoiced_amount:d, recon_status, data_status"),
}


def _model_query(model: str, spec: str):
    return lambda spark, sf_dir: shaped(getattr(warehouse(spark, sf_dir), model), spec)


QUERIES = {key: _model_query(model, spec) for key, (model, spec) in MODELS.items()}
#: The dense mart of variants, with money cast on its runs: the same rows.
QUERIES["h22_mart_variant_daily"] = lambda spark, sf_dir: shaped(warehouse(spark, sf_dir).variant_days, MODELS["h22_mart_variant_daily"][1])
ORACLES = {key: with_models(shaped_sql(model, spec)) for key, (model, spec) in MODELS.items()}
