"""Expectations over models, compiled to one scan a model, a grouping a key and an anti join a reference."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans.warehouse import Warehouse


@dataclass(frozen=True)
class Rule:
    """kind: unique (no key twice, null is a value), not_null, accepted (values; null passes), range (lowest, highest; None is open, null passes),
    reference (every value that isn't null stands in values = (model, column))."""

    model: str
    kind: str
    columns: tuple[str, ...]
    values: tuple = ()

    @property
    def name(self) -> str:
        return f"{self.kind}: {', '.join(self.columns)}"


def _unique(model: str, *columns: str) -> Rule:
    return Rule(model, "unique", columns)


def _known(model: str, *columns: str) -> list[Rule]:
    return [Rule(model, "not_null", (c,)) for c in columns]


def _key(model: str, column: str) -> list[Rule]:
    return [_unique(model, column), *_known(model, column)]


# What columns may hold.
CHANNELS, PAID = ("meta", "google", "tiktok", "unattributed"), ("meta", "google", "tiktok")
COSTED = (*PAID, "unallocated")
STATUS = ("complete", "partial_month", "source_gap", "no_cost_source", "unallocated")
PROFILES, VERSIONS = ("linear", "front_loaded"), ("original", "revised")

RULES: tuple[Rule, ...] = (
    *_key("stg_orders", "order_id"), *_known("stg_orders", "customer_id", "order_date", "is_cancelled"), Rule("stg_orders", "accepted", ("channel",), CHANNELS),
    *_known("stg_order_lines", "order_id"), Rule("stg_order_lines", "reference", ("order_id",), ("stg_orders", "order_id")),
    Rule("stg_order_lines", "reference", ("variant_id",), ("stg_products", "variant_id")), Rule("stg_order_lines", "range", ("quantity",), (1, None)),
    *_key("stg_customers", "customer_id"), *_known("stg_customers", "has_valid_email"), Rule("stg_customers", "accepted", ("email_consent_state",), ("subscribed", "not_subscribed")),
    *_key("stg_products", "variant_id"), *_known("stg_products", "unit_cost"), Rule("stg_products", "range", ("margin_pct",), (0, 1)),
    _unique("stg_ads_daily", "platform", "campaign_id", "ad_date"), *_known("stg_ads_daily", "spend", "ad_date"), Rule("stg_ads_daily", "accepted", ("platform",), ("meta", "google")), Rule("stg_ads_daily", "range", ("spend",), (0, None)),
    _unique("stg_email_flows", "flow_id", "message_id", "week_start"), *_known("stg_email_flows", "recipients", "week_start"),
    _unique("stg_marketing_budget", "month_start", "channel", "budget_version"), Rule("stg_marketing_budget", "accepted", ("channel",), PAID), Rule("stg_marketing_budget", "accepted", ("budget_version",), VERSIONS),
    Rule("stg_marketing_budget", "accepted", ("pacing_profile",), PROFILES), Rule("stg_marketing_budget", "range", ("approved_amount",), (0, None)),
    *_key("stg_vendor_invoice_lines", "invoice_line_id"), *_known("stg_vendor_invoice_lines", "amount"), Rule("stg_vendor_invoice_lines", "accepted", ("cost_type",), ("media", "fee")),
    *_key("dim_date", "date_day"), *_known("dim_date", "is_peak_season"),
    *_key("dim_campaign", "campaign_key"), Rule("dim_campaign", "accepted", ("funnel_stage",), ("prospecting", "retargeting", "catalogue", "brand", "non_brand", "shopping", "pmax", "other")),
    *_key("dim_customer", "customer_id"), *_known("dim_customer", "is_marketable"), Rule("dim_customer", "accepted", ("acquisition_channel",), CHANNELS),
    *_key("dim_product", "variant_id"), *_known("dim_product", "margin_pct"),
    *_key("fct_order", "order_id"), Rule("fct_order", "reference", ("customer_id",), ("dim_customer", "customer_id")), Rule("fct_order", "reference", ("order_date",), ("dim_date", "date_day")),
    *_known("fct_order_line", "contribution_margin"), Rule("fct_order_line", "reference", ("variant_id",), ("dim_product", "variant_id")),
    _unique("fct_ad_spend_daily", "campaign_key", "ad_date"), Rule("fct_ad_spend_daily", "reference", ("campaign_key",), ("dim_campaign", "campaign_key")), Rule("fct_ad_spend_daily", "reference", ("ad_date",), ("dim_date", "date_day")),
    _unique("fct_email_flow_weekly", "flow_id", "message_id", "week_start"), Rule("fct_email_flow_weekly", "range", ("open_rate",), (0, 1)),
    _unique("fct_invoice_allocated", "invoice_line_id", "channel"), *_known("fct_invoice_allocated", "allocated_amount"), Rule("fct_invoice_allocated", "accepted", ("channel",), COSTED), Rule("fct_invoice_allocated", "accepted", ("allocation_status",), ("allocated", "unallocated")),
    _unique("fct_marketing_cost_monthly", "month_start", "channel"), *_known("fct_marketing_cost_monthly", "month_start", "invoiced_amount", "is_media_final"),
    Rule("fct_marketing_cost_monthly", "accepted", ("channel",), COSTED), Rule("fct_marketing_cost_monthly", "accepted", ("data_status",), STATUS),
    _unique("mart_data_quality", "source_name", "date_day"), *_known("mart_data_quality", "date_day"), Rule("mart_data_quality", "accepted", ("source_name",), ("orders", "meta_ads_daily", "google_ads_daily")),
    _unique("mart_daily_trading", "date_day", "channel"), *_known("mart_daily_trading", "date_day", "contribution_margin"), Rule("mart_daily_trading", "accepted", ("channel",), CHANNELS), Rule("mart_daily_trading", "reference", ("date_day",), ("dim_date", "date_day")),
    _unique("mart_variant_daily", "date_day", "variant_id"), *_known("mart_variant_daily", "units"), Rule("mart_variant_daily", "reference", ("variant_id",), ("dim_product", "variant_id")),
    _unique("mart_cohort_retention", "cohort_month", "months_since"), *_known("mart_cohort_retention", "cohort_size", "has_full_exposure"),
    _unique("mart_ltv", "cohort_month", "acquisition_channel", "horizon_days"), *_known("mart_ltv", "cohort_size"), Rule("mart_ltv", "accepted", ("horizon_days",), (30, 60, 90)),
    _unique("mart_email_flow_weekly", "flow_name", "week_start"), Rule("mart_email_flow_weekly", "range", ("conversion_rate",), (0, 1)),
    _unique("mart_marketing_budget_vs_actual", "month_start", "channel"), *_known("mart_marketing_budget_vs_actual", "month_start", "channel", "data_status"),
    Rule("mart_marketing_budget_vs_actual", "accepted", ("channel",), COSTED), Rule("mart_marketing_budget_vs_actual", "accepted", ("budget_version_used",), VERSIONS), Rule("mart_marketing_budget_vs_actual", "accepted", ("data_status",), STATUS),
    _unique("mart_marketing_pacing_daily", "date_day", "channel"), *_known("mart_marketing_pacing_daily", "date_day", "channel", "spend_status"), Rule("mart_marketing_pacing_daily", "accepted", ("channel",), PAID),
    Rule("mart_marketing_pacing_daily", "accepted", ("spend_status",), ("delivered", "not_yet_visible", "missing", "no_cost_source")), Rule("mart_marketing_pacing_daily", "accepted", ("pacing_profile",), PROFILES),
    _unique("mart_marketing_invoice_recon", "month_start", "channel"), *_known("mart_marketing_invoice_recon", "month_start", "channel", "recon_status", "data_status"), Rule("mart_marketing_invoice_recon", "accepted", ("channel",), COSTED),
    Rule("mart_marketing_invoice_recon", "accepted", ("recon_status",), ("within_tolerance", "exception", "unbilled", "no_cost_source", "unallocated_cost")), Rule("mart_marketing_invoice_recon", "accepted", ("data_status",), STATUS),
)


#: Marts of days: the runs that they are made of, and their product's key.
RUNS = {"mart_variant_daily": ("variant_runs", "variant_id"), "mart_product_daily": ("product_runs", "sku")}


def _row_rule(r: Rule):
    c = F.col(r.columns[0])
    if r.kind == "not_null":
        return c.isNull()
    if r.kind == "accepted":
        return c.isNotNull() & ~c.isin(*r.values)
    low, high = r.values
    bad = F.lit(False)
    return (bad if low is None else bad | (c < low)) if high is None else (c > high if low is None else (c < low) | (c > high))


def compiled(models, rules: tuple[Rule, ...] = RULES) -> list[DataFrame]:
    """(model, rule, violations) in parts: for each model one aggregate over a scan for all rules on rows, for each key a grouping, for each
    reference an anti join of its distinct values. `models` has a frame by each model's name as an attribute.

    Of a mart of days that is made of runs (RUNS), what days have of their run is looked up in the runs, as many as sales: whether a product's days repeat, and which
    products there are. What a day has of its own is read day by day."""
    parts = []
    for model in dict.fromkeys(r.model for r in rules):
        runs = RUNS.get(model) if hasattr(models, RUNS.get(model, ("",))[0]) else None
        df, own = getattr(models, model), [r for r in rules if r.model == model]
        rows = [r for r in own if r.kind in ("not_null", "accepted", "range")]
        if rows:
            counts = df.agg(*[F.count_if(F.coalesce(_row_rule(r), F.lit(False))).alias(f"r{i}") for i, r in enumerate(rows)])
            each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, r in enumerate(rows)])
            parts.append(counts.select(F.lit(model).alias("model"), F.explode(each).alias("r")).select("model", "r.rule", "r.violations"))
        for r in own:
            if runs and r.kind == "unique" and set(r.columns) == {"date_day", runs[1]}:
                days = Warehouse.overlaps(getattr(models, runs[0]), runs[1])
                parts.append(days.agg(F.coalesce(F.sum("days"), F.lit(0)).cast("long").alias("violations")).select(F.lit(model).alias("model"), F.lit(r.name).alias("rule"), "violations"))
                continue
            if r.kind == "unique":
                bad = df.groupBy(*r.columns).agg(F.count("*").alias("n")).where("n > 1")
            elif r.kind == "reference":
                there = getattr(models, r.values[0]).select(F.col(r.values[1]).alias(r.columns[0]))
                of = getattr(models, runs[0]) if runs and r.columns == (runs[1],) else df
                bad = of.select(*r.columns).where(F.col(r.columns[0]).isNotNull()).distinct().join(there, list(r.columns), "left_anti")
            else:
                continue
            parts.append(bad.agg(F.count("*").alias("violations")).select(F.lit(model).alias("model"), F.lit(r.name).alias("rule"), "violations"))
    return parts


def expectations(w: Warehouse, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """model, rule, violations (rows, or keys and values for unique and reference) for every rule; zeros on sound data. Runs of products are made once."""
    w.persist("variant_runs")
    return reduce(DataFrame.unionByName, compiled(w, rules))


def rule_sql(r: Rule, names: dict[str, str] | None = None) -> str:
    """The same for one rule in DuckDB."""
    names = names or {}
    of, c = names.get(r.model, r.model), r.columns[0]
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    if r.kind == "unique":
        found = f"select count(*) from (select 1 from {of} group by {', '.join(r.columns)} having count(*) > 1)"
    elif r.kind == "reference":
        found = f"select count(distinct {c}) from {of} where {c} is not null and {c} not in (select {r.values[1]} from {names.get(r.values[0], r.values[0])})"
    elif r.kind == "not_null":
        found = f"select count(*) from {of} where {c} is null"
    elif r.kind == "accepted":
        found = f"select count(*) from {of} where {c} not in ({', '.join(map(lit, r.values))})"
    else:
        found = f"select count(*) from {of} where " + " or ".join(f"{c} {o} {v}" for o, v in zip("<>", r.values) if v is not None)
    return f"select '{r.model}' as model, '{r.name}' as rule, ({found}) as violations"
