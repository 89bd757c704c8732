"""Measures of the semantic layer: functions from a mart to its value by any columns. Ratios are ratios of sums; a zero or
missing denominator gives null."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import ratio


def _complete(c: str) -> Column:
    return F.sum(F.when(F.col("ad_spend_is_complete"), F.col(c)))


def _where(flag: Column, c: str) -> Column:
    return F.sum(F.when(flag, F.col(c)))


def trading() -> dict[str, Column]:
    """Measures over mart_daily_trading."""
    s = F.sum
    return {
        "net_revenue": s("net_revenue"), "contribution_margin": s("contribution_margin"), "margin_pct": ratio(s("contribution_margin"), s("net_revenue")),
        "orders": s("orders"), "aov": ratio(s("net_revenue"), s("orders")), "new_customers": s("new_customers"), "ad_spend": s("ad_spend"),
        "blended_cac": ratio(_complete("ad_spend"), _complete("new_customers")), "cpc": ratio(s("ad_spend"), s("clicks")),
        "cpm": ratio(s("ad_spend").cast("double") * 1000, s("impressions")), "ctr": ratio(s("clicks"), s("impressions")), "units_sold": s("units"),
        "complete_spend_days": F.count_distinct(F.when(F.col("ad_spend_is_complete"), F.col("date_day"))), "repeat_order_share": ratio(s("returning_customers"), s("orders")),
    }


def email() -> dict[str, Column]:
    rate = lambda c: ratio(F.sum(c), F.sum("recipients"))
    return {"open_rate": rate("unique_opens"), "click_rate": rate("unique_clicks"), "email_conversion_rate": rate("unique_orders"), "email_revenue": F.sum("order_value")}


def product() -> dict[str, Column]:
    return {"velocity_28d": F.avg("velocity_28d"), "days_of_cover": F.min("days_of_cover"), "units_sold": F.sum("units")}


def quality() -> dict[str, Column]:
    return {"gap_days": F.count_if("is_gap")}


def retention() -> dict[str, Column]:
    seen, first = F.col("has_full_exposure"), F.col("months_since") == 1
    return {
        "retention_rate": ratio(_where(seen, "repeat_customers"), _where(seen, "cohort_size")), "cohort_size": _where(first, "cohort_size"),
        "repeat_rate_90d": ratio(_where(first & F.col("has_full_90d_exposure"), "repeat_within_90d"), _where(first & F.col("has_full_90d_exposure"), "cohort_size")),
    }


def ltv() -> dict[str, Column]:
    seen = (F.col("horizon_days") == 60) & F.col("has_full_exposure")
    return {f"ltv_60d_{n}": ratio(_where(seen, c), _where(seen, "cohort_size")) for n, c in (("margin", "cum_contribution_margin"), ("revenue", "cum_net_revenue"))}


def measured(mart: DataFrame, measures: dict[str, Column], *by: str, only: list[str] | None = None) -> DataFrame:
    return mart.groupBy(*by).agg(*[c.alias(n) for n, c in measures.items() if only is None or n in only])


def channel_cac(mart: DataFrame, *by: str) -> DataFrame:
    """Cost per new customer on complete days, null for channels without cost data."""
    value = F.when(F.col("channel").isin("meta", "google"), ratio(_complete("ad_spend"), _complete("new_customers")))
    return mart.groupBy("channel", *by).agg(value.alias("channel_cac"))


def ltv_over_cac(daily: DataFrame, ltv_mart: DataFrame) -> DataFrame:
    """Per cohort month: margin in 60 days a head, cost a new customer of that calendar month, and their ratio."""
    cac = daily.groupBy(F.trunc("date_day", "MM").alias("cohort_month")).agg(trading()["blended_cac"].alias("cohort_cac"))
    return measured(ltv_mart, ltv(), "cohort_month").join(cac, "cohort_month", "left").withColumn("ltv_over_cac", ratio("ltv_60d_margin", "cohort_cac"))


def to_date(mart: DataFrame, numerator: str, denominator: str, day: str = "date_day") -> DataFrame:
    """A ratio of sums up to each day of its month, quarter and year: both sums run, then divide."""
    daily = mart.groupBy(day).agg(F.sum(numerator).alias("a"), F.sum(denominator).alias("b"))
    out = {"today": ratio("a", "b")}
    for name, unit in (("mtd", "MM"), ("qtd", "quarter"), ("ytd", "year")):
        w = W.partitionBy(F.trunc(day, unit)).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
        out[name] = ratio(F.sum("a").over(w), F.sum("b").over(w))
    return daily.select(day, *[c.alias(n) for n, c in out.items()])


@dataclass(frozen=True)
class State:
    """A measure as what can be added up over days: the sum of `top`, over that of `bottom` if there is one, times `scale`; or the number of
    distinct values of `key`, each on the first day of the period on which it stands."""

    top: Column | None = None
    bottom: Column | None = None
    scale: float = 1.0
    key: Column | None = None


def trading_states() -> dict[str, State]:
    """The measures of `trading` as states."""
    c, whole = F.col, F.col("ad_spend_is_complete")
    kept = lambda name: F.when(whole, c(name))
    return {
        **{n: State(c(n)) for n in ("net_revenue", "contribution_margin", "orders", "new_customers", "ad_spend")}, "units_sold": State(c("units")),
        "margin_pct": State(c("contribution_margin"), c("net_revenue")), "aov": State(c("net_revenue"), c("orders")), "blended_cac": State(kept("ad_spend"), kept("new_customers")),
        "cpc": State(c("ad_spend"), c("clicks")), "cpm": State(c("ad_spend"), c("impressions"), 1000.0), "ctr": State(c("clicks"), c("impressions")),
        "complete_spend_days": State(key=F.when(whole, c("date_day"))), "repeat_order_share": State(c("returning_customers"), c("orders")),
    }


#: Views of a day: itself, and all days of its month, quarter or year up to it.
VIEWS = {"current": "DD", "mtd": "MM", "qtd": "quarter", "ytd": "year"}


def to_date_views(mart: DataFrame, states: dict[str, State], *by: str, day: str = "date_day") -> DataFrame:
    """day, by, view and a column for each measure: any measures as they stand on each day in each of VIEWS.

    A mart is summed to days once; the views run over those states in their period, of at most 366 rows a key, and divide last.
    Distinct values are counted on their first day in the period, so their number runs like any sum.
    """
    sums = {n: s for n, s in states.items() if s.key is None}
    aggregates = [F.sum(x).alias(f"{n}__{i}") for n, s in sums.items() for i, x in enumerate((s.top, s.bottom)) if x is not None]
    keys = [*by, day]
    daily = mart.groupBy(*keys).agg(*aggregates, F.count("*").alias("__rows"))
    out = []
    for view, unit in VIEWS.items():
        period = F.col(day) if view == "current" else F.trunc(day, unit)
        w = W.partitionBy(*by, period).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
        d = daily
        for n, s in states.items():
            if s.key is not None:
                first = mart.select(*keys, s.key.alias("__key")).where("__key is not null").groupBy(*by, period.alias("__period"), "__key").agg(F.min(day).alias(day))
                d = d.join(first.groupBy(*keys).agg(F.count("*").alias(f"{n}__0")), keys, "left")
        columns = []
        for n, s in states.items():
            top = F.sum(f"{n}__0").over(w)
            if s.key is not None:
                top = F.coalesce(top, F.lit(0))
            elif s.bottom is not None:
                top = ratio(top.cast("double") * s.scale if s.scale != 1.0 else top, F.sum(f"{n}__1").over(w))
            columns.append(top.alias(n))
        out.append(d.select(*keys, F.lit(view).alias("view"), *columns))
    return reduce(DataFrame.unionByName, out)


def retention_pivot(retention: DataFrame, ages: list[int]) -> DataFrame:
    """Cohort months down, months since across; null where the window hasn't passed."""
    return retention.groupBy("cohort_month").pivot("months_since", ages).agg(F.max("retention_rate"))
