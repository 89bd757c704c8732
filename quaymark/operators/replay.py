"""Every detector at every cursor in one job.

A mart is built once. What a cursor may see is told by validity: a row, or the state that a row makes, is shown to the
cursors from the day on which it became visible to the day before the next one, and windows of days are met by equality on the
cursor. The cursor is one more key of every statistic, so nothing is looped over and no cursor is gathered in one task.
All functions give rows of SIGNAL_COLUMNS with `as_of_date` as the cursor, as `signals.detect` does at one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import ratio
from ..plans.warehouse import Warehouse
from ..session import settled
from .pit import LAGS, clock
from .signals import NOISE, SIGNAL_COLUMNS, SIGNAL_SCHEMA, Thresholds, adjudicate, enabled, judged, suppressed
from .stats import dow_adjusted, log_shares, mann_kendall, severity_from_z, theil_sen

ENDLESS = "9999-12-31"


def _signal(
    df: DataFrame, detector: str, entity_type: str, entity: Column, severity: Column, direction: Column | str, tier: Column | str, evidence: list[str],
    p: Column | None = None, fired: str = "window_end", classification: Column | str = "COMMERCIAL", window: tuple[str, str] | None = None,
) -> DataFrame:
    """Rows of the common schema from rows that carry cursor and window_end."""
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    kind = lit(entity_type)
    key = F.concat_ws("|", F.lit(detector), kind, entity.cast("string"), F.col(fired).cast("string"))
    none = F.lit(None).cast("date")
    values = {
        "signal_id": F.substring(F.sha1(key), 1, 12), "detector": F.lit(detector), "entity_type": kind, "entity_id": entity.cast("string"), "as_of_date": F.col("cursor"), "fired_date": F.col(fired),
        "severity": severity.cast("double"), "direction": lit(direction), "classification": lit(classification), "attribution_tier": lit(tier), "data_quality_score": F.lit(1.0),
        "p_value": F.lit(None).cast("double") if p is None else p, "evidence": F.to_json(F.struct(*evidence)), "window_from": F.col(window[0]) if window else none, "window_to": F.col(window[1]) if window else none,
    }
    return df.select(*[values[c].alias(c) for c in SIGNAL_COLUMNS])


def shown(df: DataFrame, times: DataFrame, since: Column, until: Column) -> DataFrame:
    """df with the cursors from `since` to `until`, both included, and what times(cursor, window_end, is_latest) says of them.

    Days are dealt out and met by equality; they are cut to the replayed time first.
    """
    span = times.agg(F.min("cursor").alias("_lo"), F.max("cursor").alias("_hi"))
    cut = df.crossJoin(span).withColumns({"_a": F.greatest(since, F.col("_lo")), "_b": F.least(until, F.col("_hi"))}).where("_a <= _b")
    return cut.withColumn("cursor", F.explode(F.sequence("_a", "_b"))).drop("_lo", "_hi", "_a", "_b").join(times, "cursor")


def states(df: DataFrame, keys: list[str], since: str) -> tuple[DataFrame, DataFrame]:
    """(rows of each state, states): a key's state begins on every day on which rows of it become visible and holds all that were by
    then; states(keys, state, until) has the day before the next one begins."""
    begun = df.select(*keys, F.col(since).alias("state")).distinct()
    nxt = F.lead("state").over(W.partitionBy(*keys).orderBy("state"))
    spans = begun.withColumn("until", F.coalesce(F.date_sub(nxt, 1), F.lit(ENDLESS).cast("date")))
    return df.join(begun, keys).where(F.col(since) <= F.col("state")), spans


def data_completeness(w: Warehouse, times: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """A run of bad days is shown as far as a cursor sees it: each of its days ends it for the cursor of that day, the last for all after."""
    bad = w.mart_data_quality.where("issue_type <> 'ok'")
    of = W.partitionBy("source_name")
    runs = bad.withColumn("run", F.date_sub("date_day", F.row_number().over(of.orderBy("date_day"))))
    run = W.partitionBy("source_name", "run")
    runs = runs.select("source_name", F.min("date_day").over(run).alias("first"), F.col("date_day").alias("last"), (F.col("date_day") == F.max("date_day").over(run)).alias("whole"))
    runs = runs.withColumn("consecutive_days", (F.datediff("last", "first") + 1).cast("long"))
    r = shown(runs, times, F.col("last"), F.when(F.col("whole"), F.lit(ENDLESS).cast("date")).otherwise(F.col("last")))
    # The window end is the last order day at later cursors: a run that goes on past it is cut there, which `last` already is.
    r = r.withColumns({"a": F.date_sub("first", t.suppression_days), "b": F.date_add("last", t.suppression_days)})
    severity = F.least(F.col("consecutive_days") / 3.0, F.lit(1.0))
    return _signal(r, "data_completeness", "source", F.col("source_name"), severity, "degrading", "A", ["first", "last", "consecutive_days"], fired="last", classification="DATA_QUALITY", window=("a", "b"))


def product_velocity(w: Warehouse, times: DataFrame, t: Thresholds = Thresholds(), sorted_all: bool = False) -> DataFrame:
    """A variant's share of the catalogue against its own past at each cursor.

    Where over half of a variant's past days have no share of sales, their median is zero and so is the deviation about it: the score is then of sums that a window
    carries on, over the days with sales alone. Only variants with a cursor at which that isn't so (`sorted_all`: every one) go with all their days, as many as the
    calendar has, to a function, which keeps them sorted: the median absolute deviation about a moving median is no sum.
    """
    start = w.dim_date.agg(F.date_add(F.min("date_day"), t.warmup_days).alias("first_day"))
    asked = times.select(F.col("window_end").alias("date_day")).distinct().withColumn("asked", F.lit(True))
    known = w.catalogue("variant_id").crossJoin(F.broadcast(start)).where("date_day >= first_day and total <> 0")
    past = (F.row_number().over(W.orderBy("date_day")) - 1).cast("long")  # one row a day
    calendar = settled(known.select("date_day", "total", past.alias("n")).join(asked, "date_day", "left").select("date_day", "total", "n", F.coalesce("asked", F.lit(False)).alias("asked")))
    opening = calendar.agg(F.min(F.when(F.col("asked"), F.col("n"))).alias("opening"))
    runs = w.variant_runs.where("units_7d <> 0 or units is not null").select("variant_id", "start", "since", "until", "units", "units_7d").repartition("variant_id")  # runs are exchanged, not days
    runs = runs.crossJoin(F.broadcast(start)).withColumn("to", F.when(F.col("units_7d") != 0, F.col("until")).otherwise(F.col("since")))
    days = runs.where("`to` >= first_day").select("variant_id", "start", "since", "units", "units_7d", F.explode(F.sequence(F.greatest("since", "first_day"), "to")).alias("date_day"))
    days = days.join(F.broadcast(calendar), "date_day").select(
        "variant_id", "date_day", "n", "asked", F.coalesce(F.when(F.col("date_day") == F.col("since"), F.col("units")), F.lit(0)).alias("units"),
        ratio(F.col("units_7d").cast("double") / F.least(F.datediff("date_day", "start") + 1, F.lit(7)), "total").alias("share"))
    of = W.partitionBy("variant_id")
    before, month = of.orderBy("date_day").rowsBetween(W.unboundedPreceding, -1), of.orderBy(F.unix_date("date_day")).rangeBetween(-27, 0)
    x = F.col("share")
    days = days.withColumns({
        "n1": F.count_if(x != 0).over(before), "s1": F.coalesce(F.sum("share").over(before), F.lit(0.0)), "s2": F.coalesce(F.sum(x * x).over(before), F.lit(0.0)), "units_28d": F.sum("units").over(month).cast("double")})
    # Of the days up to this one, or to the first that is asked for, over half without a share.
    upto, having = F.greatest(F.col("n") + 1, "opening"), F.col("n1") + (x != 0).cast("long")
    days = days.crossJoin(F.broadcast(opening)).withColumn("dense", F.lit(sorted_all) | (upto - having < F.floor(upto / 2) + 1)).withColumn("sorted", F.max("dense").over(of))
    sd = F.sqrt(F.col("s2") / F.col("n") - F.pow(F.col("s1") / F.col("n"), 2))
    sparse = days.where((~F.col("sorted")) & F.col("asked") & (x != 0) & (F.col("n") >= t.history) & (F.col("units_28d") >= t.velocity_units) & (F.col("s2") > 0)).withColumn("mad_z", x / sd).where(F.abs("mad_z") >= t.velocity_z)
    sparse = sparse.select("variant_id", "date_day", x.alias("catalogue_share"), F.lit(0.0).alias("median_share"), "mad_z", "units_28d")
    # A variant's days with sales are one row of lists, at most as long as the calendar, which is a row of lists as well.
    own = days.where("sorted").groupBy("variant_id").agg(F.collect_list(F.struct("n", F.coalesce("share", F.lit(0.0)).alias("share"), F.col("units").cast("double").alias("units"))).alias("d"))
    whole = calendar.agg(F.array_sort(F.collect_list(F.struct("n", F.unix_date("date_day").alias("day"), "asked"))).alias("c"))
    rows = own.crossJoin(F.broadcast(whole)).select("variant_id", *[F.col(f"d.{c}").alias(c) for c in ("n", "share", "units")], F.col("c.day").alias("day"), F.col("c.asked").alias("asked"))
    history, units, least_z = t.history, t.velocity_units, t.velocity_z

    def scores(key, place, share_at, units_at, ordinal, asked):
        import bisect

        import numpy as np

        ordinal, asked = np.asarray(ordinal, int), np.asarray(asked, bool)
        share, sold = np.zeros(len(ordinal)), np.zeros(len(ordinal))
        share[place], sold[place] = share_at, units_at
        summed = np.r_[0.0, np.cumsum(sold)]
        recent = summed[1:] - summed[np.searchsorted(ordinal, ordinal - 28, side="right")]  # by the calendar
        past: list[float] = []
        for i, x in enumerate(share):
            if asked[i] and len(past) >= history and recent[i] >= units:
                known = np.array(past)
                mid = float(np.median(known))
                mad = float(np.median(np.abs(known - mid)))
                sd = 0.0 if mad else float(np.std(known))
                z = 0.6745 * (x - mid) / mad if mad else (x - mid) / sd if sd else 0.0
                if abs(z) >= least_z:
                    yield key, int(ordinal[i]), float(x), mid, float(z), float(recent[i])
            bisect.insort(past, float(x))

    def scored(batches):
        import pandas as pd

        for f in batches:
            out = [hit for row in f[["variant_id", "n", "share", "units", "day", "asked"]].itertuples(index=False) for hit in scores(*row)]
            yield pd.DataFrame(out, columns=["variant_id", "day", "catalogue_share", "median_share", "mad_z", "units_28d"])

    schema = "variant_id long, day int, catalogue_share double, median_share double, mad_z double, units_28d double"
    found = rows.mapInPandas(scored, schema).select("variant_id", F.date_from_unix_date("day").alias("date_day"), "catalogue_share", "median_share", "mad_z", "units_28d")
    hits = found.unionByName(sparse).join(F.broadcast(times.withColumnRenamed("window_end", "date_day")), "date_day").withColumnRenamed("date_day", "window_end")
    return _signal(hits, "product_velocity", "variant", F.col("variant_id"), severity_from_z(F.col("mad_z")), F.when(F.col("mad_z") > 0, "improving").otherwise("degrading"), "A", ["catalogue_share", "median_share", "mad_z", "units_28d"])


def inventory_cover(w: Warehouse, times: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Stock has no history: only the cursors that see the last day have rows."""
    now = w.product_last("variant_id").withColumnRenamed("date_day", "last_day").where(F.col("days_of_cover") < t.cover_warning)
    rows = now.select("variant_id", "days_of_cover", "inventory_quantity", "velocity_28d", "last_day").join(times.where("is_latest"), F.col("last_day") == F.col("window_end"))
    severity = F.when(F.col("days_of_cover") < t.cover_critical, 1.0).otherwise(0.55)
    return _signal(rows, "inventory_cover", "variant", F.col("variant_id"), severity, "degrading", "A", ["days_of_cover", "inventory_quantity", "velocity_28d"])


def cohort_retention_shift(w: Warehouse, times: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The cohorts seen whole change on few days: statistics are of those states, which cursors then show."""
    seen = w.mart_cohort_retention.where(F.col("repeat_rate_90d").isNotNull() & (F.col("cohort_size") >= t.cohort_size) & (F.col("months_since") == 1))
    rates = seen.select(F.lit("all").alias("all"), "cohort_month", "repeat_rate_90d", F.greatest("exposure_90d_end", "cohort_month").alias("since"))
    rows, spans = states(rates, ["all"], "since")
    ends = rows.groupBy("all", "state").agg(F.count("*").alias("n"), F.min_by("repeat_rate_90d", "cohort_month").alias("rate_then"), F.max_by("repeat_rate_90d", "cohort_month").alias("rate_now"))
    p = mann_kendall(rows, ["all", "state"], "cohort_month", "repeat_rate_90d").select("all", "state", "p")
    fall = ends.withColumn("decline_pct", 100 * (1 - ratio("rate_now", "rate_then"))).where((F.col("n") >= t.cohorts) & (F.col("decline_pct") >= t.cohort_decline_pct))
    fall = shown(fall.join(p, ["all", "state"], "left").join(spans, ["all", "state"]), times, F.col("state"), F.col("until"))
    return _signal(fall, "cohort_retention_shift", "cohort", F.lit("all"), F.least(F.col("decline_pct") / 100, F.lit(1.0)), "degrading", "B", ["rate_then", "rate_now", "decline_pct", "n"], p=F.col("p"))


def _value_of_a_customer(w: Warehouse, horizon: int) -> DataFrame:
    """state, until, ltv: what the newest cohort seen whole at a horizon had returned a head, by the days on which that changes."""
    whole = w.mart_ltv.where((F.col("horizon_days") == horizon) & F.col("ltv_margin").isNotNull())
    rows, spans = states(whole.select(F.lit(1).alias("one"), "cohort_month", "ltv_margin", "cohort_size", F.greatest("exposure_end", "cohort_month").alias("since")), ["one"], "since")
    heads = rows.groupBy("state", "cohort_month").agg(ratio(F.sum(F.col("ltv_margin") * F.col("cohort_size")), F.sum("cohort_size")).alias("v"))
    return heads.groupBy("state").agg(F.max_by("v", "cohort_month").alias("ltv")).join(spans.drop("one"), "state").where("ltv > 0")


def cac_ltv_breach(w: Warehouse, times: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """A run of days with cost ends on each such day, and is the last one for the cursors until the next day's cost is there."""
    daily = w.mart_daily_trading
    whole = daily.groupBy("date_day").agg(F.sum("ad_spend").alias("ad_spend"), F.sum("new_customers").alias("new_customers"), F.bool_or("ad_spend_is_complete").alias("ok"), F.max("spend_available_on").alias("there")).where("ok")
    each = daily.where(F.col("channel").isin("google", "meta"))
    columns = ("date_day", "ad_spend", "new_customers", "there")
    rows = whole.select(F.lit("blended").alias("entity"), *columns).unionByName(each.withColumn("there", F.col("spend_available_on")).select(F.col("channel").alias("entity"), *columns))
    rows = rows.where("ad_spend is not null and new_customers > 0").withColumn("since", F.greatest(F.col("date_day"), F.coalesce("there", F.col("date_day"))))
    by = W.partitionBy("entity").orderBy("date_day")
    run = by.rowsBetween(1 - t.breach_days, 0)
    rows = rows.select(
        "entity", F.col("date_day").alias("last"), "since", F.date_sub(F.lead("since").over(by), 1).alias("until"), F.count("*").over(run).alias("days"), F.min("date_day").over(run).alias("first"),
        F.sum("ad_spend").over(run).alias("spend"), F.sum("new_customers").over(run).alias("customers"), F.min(ratio("ad_spend", "new_customers")).over(run).alias("cheapest"))
    rows = rows.where((F.col("days") == t.breach_days) & (F.datediff("last", "first") == t.breach_days - 1) & (F.col("customers") >= t.breach_customers))
    now = shown(rows, times, F.col("since"), F.coalesce("until", F.lit(ENDLESS).cast("date"))).drop("since", "until")
    value = shown(_value_of_a_customer(w, t.horizon), times, F.col("state"), F.col("until")).select("cursor", "ltv")
    hits = now.join(value, "cursor").withColumns({"cac": ratio("spend", "customers"), "over": ratio(ratio("spend", "customers"), "ltv")}).where(F.col("cheapest") / F.col("ltv") > t.breach_ratio)
    blended = F.col("entity") == "blended"
    severity = F.least(0.5 + (F.col("over") / t.breach_ratio - 1) / 2, F.lit(1.0))
    return _signal(hits, "cac_ltv_breach", F.when(blended, "account").otherwise("channel"), F.col("entity"), severity, "degrading", F.when(blended, "B").otherwise("C"), ["cac", "ltv", "over", "first", "last"])


def _trend(df: DataFrame, times: DataFrame, days: int, value: str) -> DataFrame:
    """cursor, entity, n, slope, z, p, med of the weekday-adjusted values of the last `days` days of df(entity, date_day, iso_dow, since)."""
    rows = df.where(F.col(value).isNotNull()).select("entity", "date_day", "iso_dow", "since", F.col(value).cast("double").alias("v"), *[c for c in df.columns if c == "clicks"])
    seen = shown(rows, times, F.col("since"), F.date_add("date_day", days)).where(F.col("date_day") > F.date_sub("window_end", days))
    keys = ["cursor", "entity"]
    adjusted = settled(dow_adjusted(seen, keys, "iso_dow", "v").withColumn("adjusted", F.round("adjusted", NOISE)))
    more = [F.sum("clicks").alias("clicks")] if "clicks" in rows.columns else []
    med = adjusted.groupBy(*keys).agg(F.percentile("adjusted", 0.5).alias("med"), F.max("window_end").alias("window_end"), *more)
    tested = mann_kendall(adjusted, keys, "date_day", "adjusted").where("p is not null").select(*keys, "z", "p")
    return theil_sen(adjusted, keys, "date_day", "adjusted").join(tested, keys).join(med, keys).where("med > 0")


def _since(c: str = "spend_available_on") -> Column:
    return F.greatest(F.col("date_day"), F.coalesce(c, F.col("date_day"))).alias("since")


def cac_trend(w: Warehouse, times: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The blended cost of a day is known when the last channel's spend is there."""
    daily = w.mart_daily_trading
    whole = daily.groupBy("date_day", "iso_dow").agg(F.max("blended_cac").alias("v"), F.max("spend_available_on").alias("there")).select(F.lit("blended").alias("entity"), "date_day", "iso_dow", _since("there"), "v")
    each = daily.where(F.col("channel").isin("google", "meta")).select(F.col("channel").alias("entity"), "date_day", "iso_dow", _since(), F.col("channel_cac").alias("v"))
    hits = _trend(whole.unionByName(each), times, t.trend_days, "v").withColumn("pct_per_day", 100 * F.col("slope") / F.col("med")).where((F.abs("pct_per_day") >= t.cac_pct_per_day) & (F.col("p") <= t.max_p))
    blended = F.col("entity") == "blended"
    return _signal(hits, "cac_trend", F.when(blended, "account").otherwise("channel"), F.col("entity"), severity_from_z(F.col("z")), F.when(F.col("slope") > 0, "degrading").otherwise("improving"), F.when(blended, "B").otherwise("C"), ["pct_per_day", "z", "p", "n"], p=F.col("p"))


def channel_cvr_shift(w: Warehouse, times: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    d = w.mart_daily_trading.where(F.col("channel").isin("google", "meta")).select(F.col("channel").alias("entity"), "date_day", "iso_dow", _since(), "clicks", ratio("orders", "clicks").alias("v"))
    hits = _trend(d, times, t.trend_days, "v").where(F.col("clicks") >= t.cvr_clicks).withColumn("change_pct", 100 * F.col("slope") * (F.col("n") - 1) / F.col("med"))
    hits = hits.where((F.abs("change_pct") >= t.cvr_pct) & (F.col("p") <= t.max_p))
    return _signal(hits, "channel_cvr_shift", "channel", F.col("entity"), severity_from_z(F.col("z")), F.when(F.col("slope") > 0, "improving").otherwise("degrading"), "C", ["change_pct", "p", "clicks"], p=F.col("p"))


def _windows(df: DataFrame, days: DataFrame, length: int, keys: list[str], sums: list[str]) -> DataFrame:
    """keys, day, and the sums of df(keys, date_day) over the `length` days up to each of days(day) (c_now) and the ones before (c_then)."""
    dealt = df.withColumn("day", F.explode(F.sequence(F.col("date_day"), F.date_add("date_day", 2 * length - 1)))).join(days.select("day"), "day")
    now = F.col("date_day") > F.date_sub("day", length)
    return dealt.groupBy("day", *keys).agg(*[F.sum(F.when(now, F.col(c))).alias(f"{c}_now") for c in sums], *[F.sum(F.when(~now, F.col(c))).alias(f"{c}_then") for c in sums])


def cpc_decomposition(w: Warehouse, times: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Windows end on the last day with ads that a cursor sees, which stays the same until ads of another day are there."""
    ads = w.fct_ad_spend_daily
    days = ads.groupBy(F.col("ad_date").alias("day")).agg(F.max("available_on").alias("there")).withColumn("since", F.greatest(F.date_add("day", LAGS["ads"]), F.col("there")))
    days = days.withColumn("until", F.coalesce(F.date_sub(F.lead("since").over(W.orderBy("day")), 1), F.lit(ENDLESS).cast("date")))  # a row a day of the calendar
    daily = ads.groupBy(F.col("platform").alias("channel"), F.col("ad_date").alias("date_day")).agg(*[F.sum(c).alias(c) for c in ("spend", "clicks", "impressions")])
    g = _windows(daily, days, t.evidence_days, ["channel"], ["spend", "clicks", "impressions"]).where("least(spend_now, clicks_now, impressions_now, spend_then, clicks_then, impressions_then) > 0")
    g = g.where(" and ".join(f"{c}_{x} is not null" for c in ("spend", "clicks", "impressions") for x in ("now", "then")))
    cpc = ratio(ratio("spend_now", "clicks_now"), ratio("spend_then", "clicks_then"))
    cpm = ratio(ratio("spend_now", "impressions_now"), ratio("spend_then", "impressions_then"))
    ctr = ratio(ratio("clicks_now", "impressions_now"), ratio("clicks_then", "impressions_then"))
    a, b = log_shares(cpm, ctr)
    g = g.withColumns({"change_pct": 100 * (cpc - 1), "auction_share": a, "creative_share": b, "ctr_change_pct": 100 * (ctr - 1)}).where(F.abs("change_pct") >= t.cpc_pct)
    driver = F.when(F.col("auction_share") >= t.dominance * F.col("creative_share"), "auction").when(F.col("creative_share") >= t.dominance * F.col("auction_share"), "creative").otherwise("mixed")
    g = shown(g.withColumn("driver", driver).join(days, "day"), times, F.col("since"), F.col("until"))
    return _signal(g, "cpc_decomposition", "channel", F.col("channel"), F.least(F.abs("change_pct") / 50, F.lit(1.0)), F.when(F.col("change_pct") > 0, "degrading").otherwise("improving"), "A", ["change_pct", "auction_share", "creative_share", "ctr_change_pct", "driver"])


def aov_decomposition(w: Warehouse, times: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Windows end on the last day with orders; a trend needs as many days behind it as two shortest series have."""
    whole = w.mart_daily_trading.groupBy("date_day").agg(*[F.sum(c).alias(c) for c in ("net_revenue", "orders", "units")]).where("orders > 0").withColumn("all", F.lit("all"))
    by = W.partitionBy("all").orderBy("date_day")  # a row a day of the calendar
    days = whole.select("all", F.col("date_day").alias("day"), F.row_number().over(by).alias("place"), F.coalesce(F.date_sub(F.lead("date_day").over(by), 1), F.lit(ENDLESS).cast("date")).alias("until")).where(F.col("place") >= 2 * t.min_points)
    g = _windows(whole, days, t.evidence_days, ["all"], ["net_revenue", "orders", "units"]).where("least(net_revenue_now, orders_now, units_now, net_revenue_then, orders_then, units_then) > 0")
    aov = ratio(ratio("net_revenue_now", "orders_now"), ratio("net_revenue_then", "orders_then"))
    basket = ratio(ratio("units_now", "orders_now"), ratio("units_then", "orders_then"))
    price = ratio(ratio("net_revenue_now", "units_now"), ratio("net_revenue_then", "units_then"))
    a, b = log_shares(basket, price)
    moved = g.withColumns({"change_pct": 100 * (aov - 1), "basket_share": a, "price_share": b}).where(F.abs("change_pct") >= t.aov_pct)
    series = whole.withColumn("day", F.explode(F.sequence(F.col("date_day"), F.date_add("date_day", t.evidence_days - 1)))).join(moved.select("day"), "day").withColumn("aov", ratio("net_revenue", "orders"))
    g = moved.join(mann_kendall(series, ["day"], "date_day", "aov").select("day", "p"), "day", "left").where(F.col("p").isNull() | (F.col("p") <= t.max_p))
    g = shown(g.join(days.drop("all"), "day"), times, F.col("day"), F.col("until"))
    return _signal(g, "aov_decomposition", "account", F.lit("blended"), F.least(F.abs("change_pct") / 25, F.lit(1.0)), F.when(F.col("change_pct") > 0, "improving").otherwise("degrading"), "B", ["change_pct", "basket_share", "price_share", "p"], p=F.col("p"))


def email_engagement_decay(w: Warehouse, times: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """A flow's weeks change when one ends: statistics are of those states. The first seven weeks, whose means are of fewer, are left out."""
    place = F.row_number().over(W.partitionBy("flow_name").orderBy("week_start"))
    weeks = w.mart_email_flow_weekly.withColumn("place", place).where(F.col("place") > t.email_warmup)
    weeks = weeks.select("flow_name", "week_start", "open_rate", "conversion_rate", F.date_add("week_start", LAGS["email"]).alias("since"))
    rows, spans = states(weeks, ["flow_name"], "since")
    rows, at = settled(rows), ["flow_name", "state"]

    def moved(c: str) -> DataFrame:
        med = rows.groupBy(*at).agg(F.percentile(c, 0.5).alias("med"))
        change = F.when((F.col("n") >= 3) & (F.col("med") > 0), 100 * F.col("slope") * (F.col("n") - 1) / F.col("med"))
        p = mann_kendall(rows, at, "week_start", c).select(*at, F.col("p").alias(f"{c}_p"))
        return theil_sen(rows, at, "week_start", c).join(med, at).select(*at, F.col("n").alias(f"{c}_n"), change.alias(f"{c}_pct")).join(p, at)

    g = moved("open_rate").join(moved("conversion_rate"), at)
    g = g.where((F.col("open_rate_n") >= t.email_weeks) & (F.col("conversion_rate_n") >= t.email_weeks) & F.col("conversion_rate_pct").isNotNull() & (F.col("open_rate_pct") <= -t.open_decline_pct))
    with_it = (F.col("conversion_rate_pct") < 0) & (F.col("conversion_rate_pct") / F.col("open_rate_pct") >= t.comovement) & (F.col("conversion_rate_p") <= t.max_p)
    g = shown(g.join(spans, at), times, F.col("state"), F.col("until"))
    return _signal(g, "email_engagement_decay", "flow", F.col("flow_name"), F.least(-F.col("open_rate_pct") / 40, F.lit(1.0)), "degrading", "B", ["open_rate_pct", "conversion_rate_pct", "conversion_rate_p"], p=F.col("open_rate_p"), classification=F.when(F.coalesce(with_it, F.lit(False)), "COMMERCIAL").otherwise("ARTIFACT"))


REPLAYED = {f.__name__: f for f in (
    cac_ltv_breach, cac_trend, cpc_decomposition, channel_cvr_shift, email_engagement_decay, cohort_retention_shift, product_velocity, inventory_cover, aov_decomposition, data_completeness,
)}
#: What several detectors read: computed once.
SHARED = ("sold_lines", "mart_daily_trading", "variant_runs", "mart_data_quality", "mart_cohort_retention", "mart_ltv", "mart_email_flow_weekly", "fct_ad_spend_daily", "dim_date", "last_day")


#: Detectors of variants, whose signals are the bulk: they have no p-value, are no outages and fire on the last day that a cursor sees, so a verdict on them is of the cursor alone.
MANY = ("product_velocity", "inventory_cover")


def raise_all(w: Warehouse, times: DataFrame, t: Thresholds = Thresholds(), only: tuple[str, ...] | None = None) -> DataFrame:
    """Signals of all detectors at all cursors, before adjudication."""
    names = [n for n in REPLAYED if enabled(n, t) and (only is None or n in only)]
    if not names:
        return w.last_day.sparkSession.createDataFrame([], SIGNAL_SCHEMA)
    return reduce(DataFrame.unionByName, [REPLAYED[n](w, times, t) for n in names])


def replay(w: Warehouse, warmup: int = 120, step: int = 1, t: Thresholds = Thresholds(), only: tuple[str, ...] | None = None) -> DataFrame:
    """Adjudicated signals at every `step`-th cursor from the warm-up's end to the day after the last orders: SIGNAL_COLUMNS (as_of_date is
    the cursor), suppressed_by, passed_fdr, confidence, is_actionable. Signals of variants are judged as they are made and kept nowhere."""
    w.persist(*SHARED)
    times = settled(clock(w, warmup, step))
    names = [n for n in REPLAYED if only is None or n in only]
    few = settled(raise_all(w, times, t, tuple(n for n in names if n not in MANY)))
    many = raise_all(w, times, t, tuple(n for n in names if n in MANY))
    return adjudicate(few, w.cfg.fdr_alpha, t.evidence_days).unionByName(judged(suppressed(many, few, times.select(F.col("cursor").alias("as_of_date"), F.col("window_end").alias("fired_date")), t.evidence_days).withColumn("kept", F.lit(False))))


def signals_per_cursor(replayed: DataFrame) -> DataFrame:
    """cursor, detector, signals, actionable."""
    return replayed.groupBy(F.col("as_of_date").alias("cursor"), "detector").agg(F.count("*").alias("signals"), F.count_if("is_actionable").alias("actionable"))
