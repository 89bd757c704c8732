"""Signal detectors over the marts, all in one schema, and their adjudication.

A detector is a function of a warehouse (one cursor) that returns rows of SIGNAL_COLUMNS. Adjudication works on the union of all:
outages turn overlapping signals into data-quality ones, false discoveries are controlled over all tested signals of a
cursor, and confidence discounts severity by how far the figure depends on attribution. Nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import ratio
from ..plans.warehouse import Warehouse
from ..session import settled
from .stats import benjamini_hochberg, dow_adjusted, log_shares, mann_kendall, severity_from_z, theil_sen

# What a tier of attribution is worth.
TIERS = {"A": 1.0, "B": 0.95, "C": 0.55}
SIGNAL_COLUMNS = (
    "signal_id", "detector", "entity_type", "entity_id", "as_of_date", "fired_date", "severity", "direction", "classification", "attribution_tier",
    "data_quality_score", "p_value", "evidence", "window_from", "window_to",
)
SIGNAL_SCHEMA = (
    "signal_id string, detector string, entity_type string, entity_id string, as_of_date date, fired_date date, severity double, direction string, classification string, "
    "attribution_tier string, data_quality_score double, p_value double, evidence string, window_from date, window_to date"
)


@dataclass(frozen=True)
class Thresholds:
    """Judgements, not measurements; every one can be overridden."""

    evidence_days: int = 28
    trend_days: int = 90
    max_p: float = 0.05
    breach_ratio: float = 1.0
    breach_days: int = 5
    breach_customers: int = 20
    horizon: int = 60
    cac_pct_per_day: float = 0.15
    cpc_pct: float = 10.0
    dominance: float = 1.5
    velocity_z: float = 3.0
    velocity_units: int = 20
    warmup_days: int = 28
    history: int = 14
    cover_critical: float = 14.0
    cover_warning: float = 28.0
    aov_pct: float = 5.0
    open_decline_pct: float = 10.0
    comovement: float = 0.5
    email_weeks: int = 8
    cohort_size: int = 100
    cohort_decline_pct: float = 25.0
    cohorts: int = 4
    cvr_clicks: int = 5000
    cvr_pct: float = 15.0
    suppression_days: int = 7
    min_points: int = 8
    email_warmup: int = 7
    disabled: tuple[str, ...] = ()


#: Decimals of a weekday-adjusted value: what is left of one value in two weekdays' terms ties, where division leaves noise.
NOISE = 9


def enabled(detector: str, t: Thresholds) -> bool:
    return detector not in t.disabled


def signal(
    df: DataFrame, w: Warehouse, detector: str, entity_type: str, entity: Column, severity: Column, direction: Column | str, tier: Column | str, evidence: list[str],
    p: Column | None = None, fired: Column | None = None, classification: Column | str = "COMMERCIAL", window: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Rows of the common schema from a detector's own columns; `fired` is the last visible day unless given."""
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    df = df if fired is not None else df.crossJoin(F.broadcast(w.last_day))
    fired = F.col("last_day") if fired is None else fired
    key = F.concat_ws("|", F.lit(detector), F.lit(entity_type), entity.cast("string"), fired.cast("string"))
    none = F.lit(None).cast("date")
    return df.select(
        F.substring(F.sha1(key), 1, 12).alias("signal_id"), F.lit(detector).alias("detector"), F.lit(entity_type).alias("entity_type"), entity.cast("string").alias("entity_id"),
        F.lit(w.cfg.as_of).alias("as_of_date"), fired.alias("fired_date"), severity.cast("double").alias("severity"), lit(direction).alias("direction"), lit(classification).alias("classification"),
        lit(tier).alias("attribution_tier"), F.lit(1.0).alias("data_quality_score"), (F.lit(None).cast("double") if p is None else p).alias("p_value"),
        F.to_json(F.struct(*evidence)).alias("evidence"), (window[0] if window else none).alias("window_from"), (window[1] if window else none).alias("window_to"),
    )


def _trailing(df: DataFrame, last: DataFrame, days: int, day: str = "date_day") -> DataFrame:
    return df.crossJoin(F.broadcast(last)).where(F.col(day) > F.date_sub("last_day", days)).drop("last_day")


def data_completeness(w: Warehouse, t: Thresholds = Thresholds()) -> DataFrame:
    """One signal for each run of consecutive missing or partial days of a source."""
    bad = w.mart_data_quality.where("issue_type <> 'ok'")
    run = F.date_sub("date_day", F.row_number().over(W.partitionBy("source_name").orderBy("date_day")))
    runs = bad.withColumn("run", run).groupBy("source_name", "run").agg(F.min("date_day").alias("first"), F.max("date_day").alias("last"), F.count("*").alias("consecutive_days"))
    window = (F.date_sub("first", t.suppression_days), F.date_add("last", t.suppression_days))
    return signal(runs, w, "data_completeness", "source", F.col("source_name"), F.least(F.col("consecutive_days") / 3.0, F.lit(1.0)), "degrading", "A", ["first", "last", "consecutive_days"], fired=F.col("last"), classification="DATA_QUALITY", window=window)


def shares(w: Warehouse, t: Thresholds, key: str, busy: DataFrame) -> DataFrame:
    """key, date_day, share, days: a product's share of the catalogue's velocity on the days from the warm-up on, for products of busy(key).

    A day on which it sold within the week is a row (days 1); days on which its share is zero are one row a run, that counts them up to the day before the last
    (the last day is a row of its own). Days on which the whole catalogue sold nothing have no share.
    """
    runs = (w.variant_runs if key == "variant_id" else w.product_runs).select(key, "start", "since", "until", "units_7d").join(busy, key)
    runs = runs.crossJoin(F.broadcast(w.last_day)).withColumn("since", F.greatest("since", F.date_add("start", t.warmup_days))).where("since <= until")
    total = w.catalogue(key).withColumn("seen", F.sum((F.col("total") != 0).cast("long")).over(W.orderBy("date_day")))  # one row a day
    sold = runs.where((F.col("units_7d") != 0) | (F.col("until") == F.col("last_day"))).withColumn("from", F.when(F.col("units_7d") != 0, F.col("since")).otherwise(F.col("last_day")))
    each = sold.select(key, "last_day", "start", "units_7d", F.explode(F.sequence("from", "until")).alias("date_day")).join(F.broadcast(total.where("total <> 0").select("date_day", "total")), "date_day")
    each = each.select(key, "last_day", "date_day", ratio(F.col("units_7d").cast("double") / F.least(F.datediff("date_day", "start") + 1, F.lit(7)), "total").alias("share"), F.lit(1).cast("long").alias("days"))
    none = runs.where("units_7d = 0").withColumn("to", F.least("until", F.date_sub("last_day", 1))).where("since <= to")
    count = lambda day, name: F.broadcast(total.select(F.col("date_day").alias(day), F.col("seen").alias(name)))
    none = none.withColumn("before", F.date_sub("since", 1)).join(count("before", "n0"), "before", "left").join(count("to", "n1"), "to")
    none = none.select(key, "last_day", F.col("to").alias("date_day"), F.lit(0.0).alias("share"), (F.col("n1") - F.coalesce("n0", F.lit(0))).alias("days")).where("days > 0")
    return each.unionByName(none)


def product_velocity(w: Warehouse, t: Thresholds = Thresholds(), key: str = "variant_id") -> DataFrame:
    """Variants (or brands, with key "sku") whose share of the catalogue's velocity leaves its own history by a robust z-score.

    Only those that sold enough of late are looked at; days without a sale within the week are counted, not made one by one.
    """
    recent = (w.variant_runs if key == "variant_id" else w.product_runs).where("units is not null").crossJoin(F.broadcast(w.last_day))
    recent = recent.where((F.col("since") > F.date_sub("last_day", 28)) & (F.col("since") >= F.date_add("start", t.warmup_days)))
    busy = recent.groupBy(key).agg(F.sum("units").alias("units_28d")).where(F.col("units_28d") >= t.velocity_units)
    days = shares(w, t, key, busy.select(key))
    now, past = F.col("date_day") == F.col("last_day"), F.col("date_day") < F.col("last_day")
    some = past & (F.col("share") != 0)
    g = days.groupBy(key).agg(
        F.max(F.when(now, F.col("share"))).alias("catalogue_share"), F.percentile(F.when(past, F.col("share")), 0.5, F.col("days")).alias("median_share"), F.coalesce(F.sum(F.when(past, F.col("days"))), F.lit(0)).alias("history"),
        F.coalesce(F.sum(F.when(past & (F.col("share") == 0), F.col("days"))), F.lit(0)).alias("_n0"), F.count_if(some).alias("_n1"), F.coalesce(F.avg(F.when(some, F.col("share"))), F.lit(0.0)).alias("_mean"), F.coalesce(F.var_pop(F.when(some, F.col("share"))), F.lit(0.0)).alias("_var"))
    # The deviation of both kinds of days together, from that of the days with a share and their number.
    spread = F.col("_var") * F.col("_n1") + F.col("_mean") * F.col("_mean") * F.col("_n0") * F.col("_n1") / F.nullif(F.col("_n0") + F.col("_n1"), F.lit(0))
    g = g.withColumn("sd", F.sqrt(spread / F.nullif(F.col("history"), F.lit(0))))
    mad = days.where(past).join(g.select(key, "median_share"), key).groupBy(key).agg(F.percentile(F.abs(F.col("share") - F.col("median_share")), 0.5, F.col("days")).alias("mad"))
    off = F.col("catalogue_share") - F.col("median_share")
    z = F.when(F.col("mad") > 0, 0.6745 * off / F.col("mad")).when(F.col("sd") > 0, off / F.col("sd")).otherwise(0.0)
    hits = g.join(mad, key).join(busy, key).where(F.col("history") >= t.history).withColumn("mad_z", z).where(F.abs("mad_z") >= t.velocity_z)
    return signal(hits, w, "product_velocity", "variant", F.col(key).cast("string"), severity_from_z(F.col("mad_z")), F.when(F.col("mad_z") > 0, "improving").otherwise("degrading"), "A", ["catalogue_share", "median_share", "mad_z", "units_28d"])


def inventory_cover(w: Warehouse, t: Thresholds = Thresholds(), latest: bool = True, key: str = "variant_id") -> DataFrame:
    """Variants (or brands, with key "sku") about to sell out, on the last day only: stock has no history, so earlier cursors get no rows."""
    now = w.product_last(key).where((F.col("days_of_cover") < t.cover_warning) & F.lit(latest and w.is_latest))
    return signal(now, w, "inventory_cover", "variant", F.col(key).cast("string"), F.when(F.col("days_of_cover") < t.cover_critical, 1.0).otherwise(0.55), "degrading", "A", ["days_of_cover", "inventory_quantity", "velocity_28d"])


def cohort_retention_shift(w: Warehouse, t: Thresholds = Thresholds()) -> DataFrame:
    """Decline of the 90-day repeat rate from the first to the last cohort, of those large and fully seen."""
    seen = w.mart_cohort_retention.where(F.col("has_full_90d_exposure") & (F.col("cohort_size") >= t.cohort_size) & (F.col("months_since") == 1))
    rates = seen.select(F.lit("all").alias("all"), "cohort_month", "repeat_rate_90d")
    trend = mann_kendall(rates, ["all"], "cohort_month", "repeat_rate_90d").select("p")
    ends = seen.agg(F.count("*").alias("n"), F.min_by("repeat_rate_90d", "cohort_month").alias("rate_then"), F.max_by("repeat_rate_90d", "cohort_month").alias("rate_now"))
    fall = ends.withColumn("decline_pct", 100 * (1 - ratio("rate_now", "rate_then"))).where((F.col("n") >= t.cohorts) & (F.col("decline_pct") >= t.cohort_decline_pct))
    fall = fall.join(trend, F.lit(True), "left")  # a row each
    return signal(fall, w, "cohort_retention_shift", "cohort", F.lit("all"), F.least(F.col("decline_pct") / 100, F.lit(1.0)), "degrading", "B", ["rate_then", "rate_now", "decline_pct", "n"], p=F.col("p"))


def _last_days(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The last n days with spend and new customers of each key, if they follow one another."""
    rows = df.where("ad_spend is not null and new_customers > 0").withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("date_day")))).where(F.col("_r") <= n)
    g = rows.groupBy(*keys).agg(F.count("*").alias("days"), F.min("date_day").alias("first"), F.max("date_day").alias("last"), F.sum("ad_spend").alias("spend"), F.sum("new_customers").alias("customers"), F.min(ratio("ad_spend", "new_customers")).alias("cheapest"))
    return g.where((F.col("days") == n) & (F.datediff("last", "first") == n - 1))


def cac_ltv_breach(w: Warehouse, t: Thresholds = Thresholds()) -> DataFrame:
    """Days on end at which a new customer costs more than the newest fully seen cohort has returned a head."""
    seen = w.mart_ltv.where((F.col("horizon_days") == t.horizon) & F.col("has_full_exposure"))
    value = seen.groupBy("cohort_month").agg(ratio(F.sum(F.col("ltv_margin") * F.col("cohort_size")), F.sum("cohort_size")).alias("v")).agg(F.max_by("v", "cohort_month").alias("ltv")).where("ltv > 0")
    daily = w.mart_daily_trading
    whole = daily.groupBy("date_day").agg(F.sum("ad_spend").alias("ad_spend"), F.sum("new_customers").alias("new_customers"), F.bool_or("ad_spend_is_complete").alias("ok")).where("ok").select(F.lit("blended").alias("entity"), "date_day", "ad_spend", "new_customers")
    each = daily.where(F.col("channel").isin("google", "meta")).select(F.col("channel").alias("entity"), "date_day", "ad_spend", "new_customers")
    rows = _last_days(whole.unionByName(each), ["entity"], t.breach_days).where(F.col("customers") >= t.breach_customers).crossJoin(F.broadcast(value))
    hits = rows.withColumns({"cac": ratio("spend", "customers"), "over": ratio(ratio("spend", "customers"), "ltv")}).where(F.col("cheapest") / F.col("ltv") > t.breach_ratio)
    severity = F.least(0.5 + (F.col("over") / t.breach_ratio - 1) / 2, F.lit(1.0))
    blended = F.col("entity") == "blended"
    out = [signal(hits.where(c), w, "cac_ltv_breach", kind, F.col("entity"), severity, "degrading", tier, ["cac", "ltv", "over", "first", "last"]) for c, kind, tier in ((blended, "account", "B"), (~blended, "channel", "C"))]
    return out[0].unionByName(out[1])


def _trend(df: DataFrame, value: str) -> DataFrame:
    """entity, n, slope, z, p, med of a weekday-adjusted daily series by entity."""
    adjusted = dow_adjusted(df.where(F.col(value).isNotNull()).select("entity", "date_day", "iso_dow", F.col(value).cast("double").alias("v")), ["entity"], "iso_dow", "v")
    adjusted = adjusted.withColumn("adjusted", F.round("adjusted", NOISE))
    keys = (["entity"], "date_day", "adjusted")
    med = adjusted.groupBy("entity").agg(F.percentile("adjusted", 0.5).alias("med"))
    return theil_sen(adjusted, *keys).join(mann_kendall(adjusted, *keys).select("entity", "z", "p"), "entity").join(med, "entity").where("med > 0")


def cac_trend(w: Warehouse, t: Thresholds = Thresholds()) -> DataFrame:
    """Rising or falling cost per new customer over 90 days, weekday-adjusted."""
    d = _trailing(w.mart_daily_trading, w.last_day, t.trend_days)
    series = d.where("channel = 'meta'").select(F.lit("blended").alias("entity"), "date_day", "iso_dow", F.col("blended_cac").alias("v")).unionByName(d.where(F.col("channel").isin("google", "meta")).select(F.col("channel").alias("entity"), "date_day", "iso_dow", F.col("channel_cac").alias("v")))
    hits = _trend(series, "v").withColumn("pct_per_day", 100 * F.col("slope") / F.col("med")).where((F.abs("pct_per_day") >= t.cac_pct_per_day) & (F.col("p") <= t.max_p))
    blended = F.col("entity") == "blended"
    out = [
        signal(hits.where(c), w, "cac_trend", kind, F.col("entity"), severity_from_z(F.col("z")), F.when(F.col("slope") > 0, "degrading").otherwise("improving"), tier, ["pct_per_day", "z", "p", "n"], p=F.col("p"))
        for c, kind, tier in ((blended, "account", "B"), (~blended, "channel", "C"))
    ]
    return out[0].unionByName(out[1])


def channel_cvr_shift(w: Warehouse, t: Thresholds = Thresholds()) -> DataFrame:
    """Orders per click over 90 days."""
    d = _trailing(w.mart_daily_trading, w.last_day, t.trend_days).where(F.col("channel").isin("google", "meta")).withColumnRenamed("channel", "entity")
    busy = d.groupBy("entity").agg(F.sum("clicks").alias("clicks")).where(F.col("clicks") >= t.cvr_clicks)
    hits = _trend(d.withColumn("v", ratio("orders", "clicks")), "v").join(busy, "entity").withColumn("change_pct", 100 * F.col("slope") * (F.col("n") - 1) / F.col("med")).where((F.abs("change_pct") >= t.cvr_pct) & (F.col("p") <= t.max_p))
    return signal(hits, w, "channel_cvr_shift", "channel", F.col("entity"), severity_from_z(F.col("z")), F.when(F.col("slope") > 0, "improving").otherwise("degrading"), "C", ["change_pct", "p", "clicks"], p=F.col("p"))


def _two_windows(d: DataFrame, last: DataFrame, days: int, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums of a column over the last `days` (c_now) and the ones before (c_then)."""
    d = _trailing(d, last, 2 * days).crossJoin(F.broadcast(last))
    now = F.col("date_day") > F.date_sub("last_day", days)
    return d.groupBy(*keys).agg(*[F.sum(F.when(now, F.col(c))).alias(f"{c}_now") for c in sums], *[F.sum(F.when(~now, F.col(c))).alias(f"{c}_then") for c in sums])


def cpc_decomposition(w: Warehouse, t: Thresholds = Thresholds(), traded: bool = False) -> DataFrame:
    """Which of auction price and click rate moved the cost of a click, 28 days up to the last with ads against the 28 before.

    With `traded` the windows are those of daily trading: they end on its last day, whether its ads have landed or not."""
    ads = w.fct_ad_spend_daily.select(F.col("platform").alias("channel"), F.col("ad_date").alias("date_day"), F.col("spend").alias("ad_spend"), "clicks", "impressions")
    if traded:
        ads = w.mart_daily_trading.where("ad_spend is not null").select("channel", "date_day", "ad_spend", "clicks", "impressions")
    sums = ("ad_spend", "clicks", "impressions")
    g = _two_windows(ads, w.last_day if traded else ads.agg(F.max("date_day").alias("last_day")), t.evidence_days, ["channel"], list(sums))
    g = g.where(" and ".join(f"{c}_{x} > 0" for c in sums for x in ("now", "then")))
    cpc = ratio(ratio("ad_spend_now", "clicks_now"), ratio("ad_spend_then", "clicks_then"))
    cpm = ratio(ratio("ad_spend_now", "impressions_now"), ratio("ad_spend_then", "impressions_then"))
    ctr = ratio(ratio("clicks_now", "impressions_now"), ratio("clicks_then", "impressions_then"))
    a, b = log_shares(cpm, ctr)
    g = g.withColumns({"change_pct": 100 * (cpc - 1), "auction_share": a, "creative_share": b, "ctr_change_pct": 100 * (ctr - 1)}).where(F.abs("change_pct") >= t.cpc_pct)
    driver = F.when(F.col("auction_share") >= t.dominance * F.col("creative_share"), "auction").when(F.col("creative_share") >= t.dominance * F.col("auction_share"), "creative").otherwise("mixed")
    return signal(g.withColumn("driver", driver), w, "cpc_decomposition", "channel", F.col("channel"), F.least(F.abs("change_pct") / 50, F.lit(1.0)), F.when(F.col("change_pct") > 0, "degrading").otherwise("improving"), "A", ["change_pct", "auction_share", "creative_share", "ctr_change_pct", "driver"])


def aov_decomposition(w: Warehouse, t: Thresholds = Thresholds()) -> DataFrame:
    """Which of basket size and price moved the average order, with a trend test on the daily figure."""
    whole = w.mart_daily_trading.groupBy("date_day").agg(*[F.sum(c).alias(c) for c in ("net_revenue", "orders", "units")]).where("orders > 0").withColumn("all", F.lit("all"))
    last = whole.agg(F.max("date_day").alias("last_day"), F.count("*").alias("_n")).where(F.col("_n") >= 2 * t.min_points).select("last_day")
    sums = ("net_revenue", "orders", "units")
    g = _two_windows(whole, last, t.evidence_days, ["all"], list(sums)).where(" and ".join(f"{c}_{x} > 0" for c in sums for x in ("now", "then")))
    aov = ratio(ratio("net_revenue_now", "orders_now"), ratio("net_revenue_then", "orders_then"))
    basket = ratio(ratio("units_now", "orders_now"), ratio("units_then", "orders_then"))
    price = ratio(ratio("net_revenue_now", "units_now"), ratio("net_revenue_then", "units_then"))
    a, b = log_shares(basket, price)
    trend = mann_kendall(_trailing(whole, last, t.evidence_days).withColumn("aov", ratio("net_revenue", "orders")), ["all"], "date_day", "aov").select("all", "p")
    g = g.withColumns({"change_pct": 100 * (aov - 1), "basket_share": a, "price_share": b}).join(trend, "all", "left").where((F.abs("change_pct") >= t.aov_pct) & (F.col("p").isNull() | (F.col("p") <= t.max_p)))
    return signal(g, w, "aov_decomposition", "account", F.lit("blended"), F.least(F.abs("change_pct") / 25, F.lit(1.0)), F.when(F.col("change_pct") > 0, "improving").otherwise("degrading"), "B", ["change_pct", "basket_share", "price_share", "p"], p=F.col("p"))


def email_engagement_decay(w: Warehouse, t: Thresholds = Thresholds()) -> DataFrame:
    """Falling opens; commercial only where conversion falls with them."""
    weeks = w.mart_email_flow_weekly.withColumn("_r", F.row_number().over(W.partitionBy("flow_name").orderBy("week_start"))).where(F.col("_r") > t.email_warmup)

    def moved(c: str) -> DataFrame:
        mid = weeks.groupBy("flow_name").agg(F.percentile(c, 0.5).alias("med"))
        return theil_sen(weeks, ["flow_name"], "week_start", c).join(mid, "flow_name").select("flow_name", "n", F.when((F.col("n") >= 3) & (F.col("med") > 0), 100 * F.col("slope") * (F.col("n") - 1) / F.col("med")).alias(f"{c}_pct"))

    tested = lambda c, name: mann_kendall(weeks, ["flow_name"], "week_start", c).select("flow_name", F.col("p").alias(name))
    g = moved("open_rate").join(moved("conversion_rate").withColumnRenamed("n", "n_conversion"), "flow_name").join(tested("open_rate", "p"), "flow_name").join(tested("conversion_rate", "conversion_p"), "flow_name")
    g = g.where((F.col("n") >= t.email_weeks) & (F.col("n_conversion") >= t.email_weeks) & F.col("conversion_rate_pct").isNotNull() & (F.col("open_rate_pct") <= -t.open_decline_pct))
    with_it = (F.col("conversion_rate_pct") < 0) & (F.col("conversion_rate_pct") / F.col("open_rate_pct") >= t.comovement) & (F.col("conversion_p") <= t.max_p)
    return signal(g, w, "email_engagement_decay", "flow", F.col("flow_name"), F.least(-F.col("open_rate_pct") / 40, F.lit(1.0)), "degrading", "B", ["open_rate_pct", "conversion_rate_pct", "conversion_p"], p=F.col("p"), classification=F.when(F.coalesce(with_it, F.lit(False)), "COMMERCIAL").otherwise("ARTIFACT"))


DETECTORS = {f.__name__: f for f in (
    cac_ltv_breach, cac_trend, cpc_decomposition, channel_cvr_shift, email_engagement_decay, cohort_retention_shift, product_velocity, inventory_cover, aov_decomposition, data_completeness,
)}


#: Days of a bucket that intervals are dealt to, so that they meet by equality before their ends are compared.
BUCKET = 32


def _buckets(first: Column, last: Column) -> Column:
    at = lambda d: F.floor(F.unix_date(d) / BUCKET)
    return F.explode(F.sequence(at(first), at(last)))


def suppressed(other: DataFrame, signals: DataFrame, days: DataFrame, evidence_days: int = 28) -> DataFrame:
    """`other`, which holds no outages, with suppressed_by: the sources of outages among `signals` that its evidence windows meet. days(as_of_date, fired_date) are the pairs that
    `other` may hold, few rows, so nothing of `other` is exchanged."""
    outages = signals.where("detector = 'data_completeness'").select("as_of_date", "window_from", "window_to", F.col("entity_id").alias("_s"))
    outages = outages.select("*", _buckets(F.col("window_from"), F.col("window_to")).alias("_k"))
    days = days.distinct().select("*", _buckets(F.date_sub("fired_date", evidence_days), F.col("fired_date")).alias("_k"))
    meet = (F.date_sub("fired_date", evidence_days) <= F.col("window_to")) & (F.col("fired_date") >= F.col("window_from"))
    by = settled(days.join(outages, ["as_of_date", "_k"]).where(meet).groupBy("as_of_date", "fired_date").agg(F.array_sort(F.collect_set("_s")).alias("suppressed_by")))
    hit = F.col("suppressed_by").isNotNull()
    return other.join(F.broadcast(by), ["as_of_date", "fired_date"], "left").select(*other.columns, "suppressed_by").withColumns({
        "classification": F.when(hit, "DATA_QUALITY").otherwise(F.col("classification")), "data_quality_score": F.when(hit, 0.3).otherwise(F.col("data_quality_score"))})


def suppress_over_outages(signals: DataFrame, evidence_days: int = 28) -> DataFrame:
    """Signals whose evidence window meets an outage of the same cursor become data-quality ones, with a score of 0.3.

    Windows and outages are dealt to buckets of days and meet within a cursor and bucket; of signals with one cursor and day, which
    share a window, one row takes part.
    """
    other = signals.where("detector <> 'data_completeness'")
    out = suppressed(other, signals, other.select("as_of_date", "fired_date"), evidence_days)
    return out.unionByName(signals.where("detector = 'data_completeness'").withColumn("suppressed_by", F.lit(None).cast("array<string>")))


def judged(s: DataFrame) -> DataFrame:
    """Signals with suppressed_by and `kept`: whether they pass, how far they are trusted and whether to act."""
    tested = F.col("p_value").isNotNull() & ~F.isnan("p_value")
    tier = reduce(lambda c, kv: F.when(F.col("attribution_tier") == kv[0], kv[1]).otherwise(c), TIERS.items(), F.lit(None).cast("double"))
    s = s.withColumns({"passed_fdr": F.when(tested, F.col("kept")).otherwise(True), "confidence": F.round(F.col("severity") * tier * F.col("data_quality_score"), 4)}).drop("kept")
    return s.withColumn("is_actionable", (F.col("classification") == "COMMERCIAL") & F.col("passed_fdr"))


def adjudicate(signals: DataFrame, alpha: float = 0.10, evidence_days: int = 28) -> DataFrame:
    """Suppression, false-discovery control over a cursor's tested signals, confidence and whether to act."""
    return judged(benjamini_hochberg(suppress_over_outages(signals, evidence_days), "p_value", alpha, ["as_of_date"]))


def ordered(signals: DataFrame) -> DataFrame:
    """Adjudicated signals as they are reported: what can be acted on first, then by confidence; ties by id."""
    return signals.orderBy(F.desc("is_actionable"), F.desc("confidence"), "as_of_date", "signal_id")


def detect(w: Warehouse, t: Thresholds = Thresholds(), only: list[str] | None = None) -> DataFrame:
    w.persist("mart_daily_trading", "variant_runs", "mart_data_quality", "mart_cohort_retention", "mart_ltv", "mart_email_flow_weekly", "last_day")
    parts = [f(w, t) for name, f in DETECTORS.items() if enabled(name, t) and (only is None or name in only)]
    return adjudicate(settled(reduce(DataFrame.unionByName, parts)), w.cfg.fdr_alpha, t.evidence_days)
