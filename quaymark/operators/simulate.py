"""Reproducible Monte Carlo as DataFrames: draws come from digests of (seed, stream, draw), whatever the partitions.

A simulation takes a frame of cases, one row a decision, and returns a row for each draw of each. Its inputs come from the
marts: what channels spend and what a customer costs there, what a cohort is worth, what a variant sells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import ratio
from .stats import elasticity


def uniform(seed: int, stream: str, draw: Column | str = "draw") -> Column:
    """In (0, 1), from the first 13 hex digits of md5."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), F.col(draw).cast("string") if isinstance(draw, str) else draw.cast("string"))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def normal(seed: int, stream: str, draw: Column | str = "draw") -> Column:
    """Box-Muller on two streams."""
    return F.sqrt(-2 * F.ln(uniform(seed, stream + ":a", draw))) * F.cos(uniform(seed, stream + ":b", draw) * (2 * math.pi))


def draws(spark: SparkSession, n: int = 10_000) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("draw"))


DRAWS, HORIZON, WINDOW = 10_000, 30, 90


def _each(cases: DataFrame, n: int) -> DataFrame:
    return cases.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def _clip(x: Column, lo: float, hi: float | Column) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), hi if isinstance(hi, Column) else F.lit(hi))


def _around(c: Column, share: float, z: Column) -> Column:
    return c * (1 + share * z)


def channel_state(daily: DataFrame, window: int = WINDOW) -> DataFrame:
    """channel, spend_per_day, cac, beta, beta_se of the last `window` days, over days whose spend is known.

    Elasticity is of the cost of a customer to spend, over the window that ends on the channel's last day with both.
    """
    last = daily.agg(F.max("date_day").alias("_last"))
    spent = daily.where("ad_spend is not null").crossJoin(F.broadcast(last)).where(F.col("date_day") > F.date_sub("_last", window))
    g = spent.groupBy("channel").agg(F.avg(F.col("ad_spend").cast("double")).alias("spend_per_day"), (F.sum("ad_spend").cast("double") / F.greatest(F.sum("new_customers").cast("double"), F.lit(1.0))).alias("cac"))
    both = daily.where("ad_spend is not null and new_customers > 0")
    ends = both.groupBy("channel").agg(F.max("date_day").alias("_end"))
    points = both.join(F.broadcast(ends), "channel").where(F.col("date_day") > F.date_sub("_end", window)).select("channel", F.col("ad_spend").alias("x"), ratio("ad_spend", "new_customers").alias("y"))
    e = elasticity(points, ["channel"], "x", "y").select("channel", "beta", F.col("se").alias("beta_se"))
    return g.where("spend_per_day > 0").join(e, "channel", "left").select("channel", "spend_per_day", "cac", F.coalesce("beta", F.lit(0.35)).alias("beta"), F.coalesce("beta_se", F.lit(0.20)).alias("beta_se"))


def cohort_value(ltv: DataFrame, horizon: int = 60) -> DataFrame:
    """One row: ltv_margin and ltv_revenue a head of the newest fully seen cohort."""
    by = ltv.where((F.col("horizon_days") == horizon) & F.col("has_full_exposure")).groupBy("cohort_month").agg(
        *[ratio(F.sum(F.col(c).cast("double") * F.col("cohort_size")), F.sum("cohort_size")).alias(c) for c in ("ltv_margin", "ltv_revenue")])
    return by.agg(F.max_by(F.struct("ltv_margin", "ltv_revenue"), "cohort_month").alias("v")).select("v.*")


def reallocation(cases: DataFrame, n: int = DRAWS, seed: int = 7, days: int = HORIZON) -> DataFrame:
    """Each draw's margin_delta and revenue_delta of moving `shift` of a donor's spend to a receiver for `days` days.

    Reads donor_* and receiver_* spend_per_day, cac, beta, beta_se, and shift, ltv_margin, ltv_revenue. The next customer
    costs cac * scale ** beta on either side; betas, costs and the value of a customer are drawn.
    """
    c = F.col
    moved = c("donor_spend_per_day") * c("shift")
    scale = {"receiver": 1 + moved / c("receiver_spend_per_day"), "donor": F.greatest(1 - moved / c("donor_spend_per_day"), F.lit(0.01))}

    def customers(side: str) -> Column:
        beta = _clip(c(f"{side}_beta") + c(f"{side}_beta_se") * normal(seed, f"{side} beta"), 0.0, 1.5)
        cac = F.greatest(_around(c(f"{side}_cac"), 0.15, normal(seed, f"{side} cac")), F.lit(0.01))
        return moved * days / (cac * F.pow(scale[side], beta))

    d = _each(cases, n).withColumn("net_customers", customers("receiver") - customers("donor"))
    return d.withColumns({f"{k}_delta": c("net_customers") * F.greatest(_around(c(f"ltv_{k}"), 0.20, normal(seed, f"ltv {k}")), F.lit(0.0)) for k in ("margin", "revenue")})


def creative_refresh(cases: DataFrame, n: int = DRAWS, seed: int = 11, days: int = HORIZON) -> DataFrame:
    """Each draw's margin_delta and revenue_delta of winning back part of a fall in click rate at the same spend.

    Reads spend_per_day, cac, uplift (the fall), ltv_margin, ltv_revenue. A customer gets cheaper in proportion; the cost of
    production bounds the loss.
    """
    c = F.col
    won = _clip(c("uplift") * (0.5 + 0.4 * normal(seed, "uplift")), 0.0, c("uplift") * 1.5)
    d = _each(cases, n).withColumn("net_customers", c("spend_per_day") * days / c("cac") * won)
    worth = {k: c("net_customers") * F.greatest(_around(c(f"ltv_{k}"), 0.20, normal(seed, f"ltv {k}")), F.lit(0.0)) for k in ("margin", "revenue")}
    return d.withColumns({"margin_delta": worth["margin"] - (1500.0 + 400.0 * normal(seed, "cost")), "revenue_delta": worth["revenue"]})


def stock_cases(variants: DataFrame, last_day: DataFrame, window: int = WINDOW) -> DataFrame:
    """variant_id, on_hand, unit_margin, pool (units a day of the last `window` days, by day) from the product mart.

    Margin a unit is the last day's, or that of the whole history where the last day has none; without either there is no case.
    """
    c = F.col
    d = variants.crossJoin(F.broadcast(last_day))
    now, recent = c("date_day") == c("last_day"), c("date_day") > F.date_sub("last_day", window)
    g = d.groupBy("variant_id").agg(
        F.coalesce(F.max(F.when(now, c("inventory_quantity"))), F.lit(0)).cast("double").alias("on_hand"),
        ratio(F.sum(F.when(now, c("contribution_margin"))), F.sum(F.when(now, c("units")))).alias("_today"), ratio(F.sum("contribution_margin"), F.sum("units")).alias("_ever"),
        F.transform(F.sort_array(F.collect_list(F.when(recent, F.struct("date_day", c("units").cast("double").alias("units"))))), lambda x: x["units"]).alias("pool"))
    return g.select("variant_id", "on_hand", F.when(c("_today") > 0, c("_today")).otherwise(c("_ever")).alias("unit_margin"), "pool").where((c("unit_margin") > 0) & (F.size("pool") > 0))


def reorder(cases: DataFrame, lead_days: float = 21.0, n: int = DRAWS, seed: int = 13) -> DataFrame:
    """Each draw's short and margin_delta (never above zero): demand over a drawn lead time against stock. Reads on_hand, unit_margin, pool.

    Lead time is normal with a quarter of it as deviation, at least a day, cut to whole days; a day's demand is one of the pool's.
    """
    lead = F.greatest(_around(F.lit(lead_days), 0.25, normal(seed, "lead")), F.lit(1.0)).cast("int")
    pick = lambda d: F.floor(uniform(seed, "pick", F.concat_ws("/", F.col("draw").cast("string"), d.cast("string"))) * F.size("pool")).cast("int")
    sold = F.aggregate(F.sequence(F.lit(1), F.col("_lead")), F.lit(0.0), lambda total, d: total + F.get("pool", pick(d)))
    d = _each(cases, n).withColumn("_lead", lead).withColumn("sold", sold).drop("_lead", "pool")
    short = F.greatest(F.col("sold") - F.col("on_hand"), F.lit(0.0))
    return d.withColumn("short", short).withColumn("margin_delta", F.lit(0.0) - F.col("short") * F.col("unit_margin"))


def summary(outcome: DataFrame, *by: str, value: str = "margin_delta", directional: bool = True) -> DataFrame:
    """Median, 10th and 90th percentile and share above zero (null for a measure of risk); no mean, as tails are long.

    With revenue_delta its median comes along; with short, the chance of any and its 90th percentile.
    """
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    more = [F.percentile("revenue_delta", 0.5).alias("revenue_median")] if "revenue_delta" in outcome.columns else []
    if "short" in outcome.columns:
        more += [F.avg((F.col("short") > 0).cast("double")).alias("p_stockout"), F.percentile("short", 0.9).alias("short_p90")]
    p = F.avg((F.col(value) > 0).cast("double")) if directional else F.lit(None).cast("double")
    g = outcome.groupBy(*by).agg(F.count("*").alias("draws"), q.alias("q"), p.alias("p_positive"), *more)
    return g.withColumns({"p10": F.col("q")[0], "median": F.col("q")[1], "p90": F.col("q")[2]}).drop("q")


def worth_waiting(outcome: DataFrame, p: str = "p_positive", lo: str = "p10", hi: str = "p90", days: int = 7, seen: int = WINDOW) -> DataFrame:
    """How far a week more data would narrow the interval, and whether to wait for it. A measure of risk (p null) never waits."""
    shrink = math.sqrt(seen / (seen + days))
    wait = F.coalesce((F.col(lo) < 0) & (F.col(hi) > 0) & (F.col(p) > 0.35) & (F.col(p) < 0.65), F.lit(False))
    width = F.col(hi) - F.col(lo)
    return outcome.withColumns({"width": width, "width_after": F.when(F.col(p).isNotNull(), width * shrink), "advice": F.when(wait, "WAIT").otherwise("ACT")})


def autonomy(df: DataFrame, auto: float = 0.80, least: float = 0.50, cap: float = 0.10, gain: float = 0.55) -> DataFrame:
    """What may be done without a person, first match wins. Reads action_type, p_positive (null: not simulated, or a risk), advice, confidence, is_reversible, attribution_tier."""
    c = F.col
    gate = (
        F.when(c("action_type") == "INVESTIGATE_DATA", "FLAG FOR REVIEW").when(c("p_positive") < gain, "MONITOR").when(c("advice") == "WAIT", "WAIT").when(c("confidence") < least, "MONITOR")
        .when(~c("is_reversible") | (c("attribution_tier") == "C"), "FLAG FOR REVIEW").when(c("confidence") >= auto, "AUTO-EXECUTE").otherwise("AUTO-EXECUTE (capped magnitude)")
    )
    return df.withColumn("autonomy", gate).withColumn("cap", F.when(c("autonomy") == "AUTO-EXECUTE (capped magnitude)", cap))
