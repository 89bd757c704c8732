"""Marts as they stood at earlier cursors, without a rebuild: what was not yet available is blanked or left out."""

from __future__ import annotations

import dataclasses
import datetime as dt
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.warehouse import VARIANT, Warehouse
from ..session import settled

#: Columns of daily trading that come from ad spend and land a day late.
SPEND = ("ad_spend", "clicks", "impressions", "channel_cac", "channel_roas", "channel_margin_roas")
#: Days that a source's rows take to arrive: ads come the day after, an email week when it is over.
LAGS = {"orders": 0, "ads": 1, "email": 7}


def daily_trading_as_of(daily: DataFrame, cursors: DataFrame) -> DataFrame:
    """mart_daily_trading at each cursor of cursors(cursor): one job for any number of them.

    Rows after the cursor or the last order day go; spend that was not available at the cursor is null (channels without a
    cost source have no availability and are not stale); a day with spend still to come is incomplete, its blended cost null.
    """
    stale = F.col("spend_available_on") > F.col("cursor")
    rows = daily.join(cursors, F.col("date_day") <= F.col("cursor"))
    rows = rows.withColumn("pending", F.max(F.coalesce(stale, F.lit(False))).over(W.partitionBy("cursor", "date_day")))
    blanked = {c: F.when(~F.coalesce(stale, F.lit(False)), F.col(c)) for c in SPEND}
    return rows.withColumns({
        **blanked, "ad_spend_is_complete": F.col("ad_spend_is_complete") & ~F.col("pending"), "blended_cac": F.when(~F.col("pending"), F.col("blended_cac")),
    }).drop("pending")


def exposure_as_of(mart: DataFrame, cursors: DataFrame, end: str, flag: str, values: list[str]) -> DataFrame:
    """Exposure flags and guarded values of a cohort mart at each cursor, from the days on which windows end."""
    seen = F.col(end) <= F.col("cursor")
    return mart.join(cursors, F.col("cohort_month") <= F.col("cursor")).withColumns({flag: seen, **{v: F.when(seen, F.col(v)) for v in values}})


def cursors_between(spark, first, last, step: int = 1) -> DataFrame:
    return spark.sql(f"select explode(sequence(date '{first}', date '{last}', interval {int(step)} days)) as cursor")


def latest_cursor(last_day: DataFrame) -> DataFrame:
    return last_day.select(F.date_add("last_day", 1).alias("cursor"))


def clock(w: Warehouse, warmup: int = 120, step: int = 1) -> DataFrame:
    """cursor, window_end (the last day visible: the cursor or the last order day), is_latest: every `step` days from the warm-up on to
    the day after the last orders, when their costs have landed."""
    days = w.dim_date.agg(F.min("date_day").alias("first_day"), F.max("date_day").alias("last_day"))
    cursors = days.where(F.date_add("first_day", warmup) <= F.date_add("last_day", 1)).select(
        "last_day", F.explode(F.expr(f"sequence(date_add(first_day, {int(warmup)}), date_add(last_day, 1), interval {int(step)} days)")).alias("cursor"))
    return cursors.select("cursor", F.least("cursor", "last_day").alias("window_end"), (F.col("cursor") >= F.col("last_day")).alias("is_latest"))


def lag_table(spark, lags: dict[str, int] | None = None) -> DataFrame:
    """source, valid_from, lag_days: how late a source's rows are from a day on. One row a source that never changed."""
    return spark.createDataFrame([(s, dt.date(1900, 1, 1), n) for s, n in (lags or LAGS).items()], "source string, valid_from date, lag_days int")


def cutoffs(times: DataFrame, lags: DataFrame) -> DataFrame:
    """cursor, source, cutoff: the last day of a source that a cursor of times(cursor, window_end) sees, by the lag in force at the cursor:
    the latest one that began by then. Nothing is seen past the last order day."""
    held = times.join(lags, F.col("valid_from") <= F.col("cursor")).groupBy("cursor", "window_end", "source").agg(F.max_by("lag_days", "valid_from").alias("lag"))
    return held.select("cursor", "source", F.least(F.date_sub("cursor", F.col("lag")), F.col("window_end")).alias("cutoff"))


def seen_at(frame: DataFrame, day: str, limits: DataFrame, source: str) -> DataFrame:
    """frame at each cursor: its rows up to the source's cutoff, with `cursor`."""
    own = limits.where(F.col("source") == source).select("cursor", "cutoff")
    return frame.join(own, F.col(day) <= F.col("cutoff")).drop("cutoff")


class AsOfWarehouse(Warehouse):
    """The marts of a finished build as one cursor sees them, for whatever reads a warehouse: `detect(AsOfWarehouse(w, day))`.

    Rows past the window end go; spend not yet there is blanked; ads and email are cut by their lags; exposure flags are those of the
    cursor, and cohorts not yet born are left out. Cohorts that may be used at the cursor have been whole for long, so
    filtering a finished mart is exact for them.
    """

    def __init__(self, w: Warehouse, cursor: dt.date, lags: dict[str, int] | None = None):
        super().__init__(w.raw, dataclasses.replace(w.cfg, as_of=cursor))
        self.w, self.lags = w, LAGS | (lags or {})
        newest = w.last_day.first()["last_day"]
        self.end = min(cursor, newest)
        self.is_latest = self.end >= newest

    def _upto(self, frame: DataFrame, day: str, source: str = "orders") -> DataFrame:
        return frame.where(F.col(day) <= F.lit(min(self.end, self.cfg.as_of - dt.timedelta(days=self.lags[source]))))

    @cached_property
    def dim_date(self) -> DataFrame:
        return self._upto(self.w.dim_date, "date_day")

    @cached_property
    def fct_ad_spend_daily(self) -> DataFrame:
        return self._upto(self.w.fct_ad_spend_daily, "ad_date", "ads")

    @cached_property
    def mart_daily_trading(self) -> DataFrame:
        cursor = self.w.dim_date.sparkSession.createDataFrame([(self.cfg.as_of,)], "cursor date")
        return self._upto(daily_trading_as_of(self.w.mart_daily_trading, cursor).drop("cursor"), "date_day")

    def _runs(self, runs: DataFrame) -> DataFrame:
        return runs.where(F.col("since") <= F.lit(self.end)).withColumn("until", F.least("until", F.lit(self.end)))

    @cached_property
    def variant_runs(self) -> DataFrame:
        return self._runs(self.w.variant_runs)

    @cached_property
    def product_runs(self) -> DataFrame:
        return self._runs(self.w.product_runs)

    def catalogue(self, key: str) -> DataFrame:
        return self._upto(self.w.catalogue(key), "date_day")

    @cached_property
    def mart_data_quality(self) -> DataFrame:
        return self._upto(self.w.mart_data_quality, "date_day")

    @cached_property
    def mart_email_flow_weekly(self) -> DataFrame:
        return self._upto(self.w.mart_email_flow_weekly, "week_start", "email")

    @cached_property
    def mart_cohort_retention(self) -> DataFrame:
        born, seen, seen_90d = (F.col(c) <= F.lit(self.end) for c in ("cohort_month", "window_end", "exposure_90d_end"))
        return self.w.mart_cohort_retention.where(born).withColumns({
            "has_full_exposure": seen, "has_full_90d_exposure": seen_90d, "retention_rate": F.when(seen, F.col("retention_rate")), "repeat_rate_90d": F.when(seen_90d, F.col("repeat_rate_90d"))})

    @cached_property
    def mart_ltv(self) -> DataFrame:
        seen = F.col("exposure_end") <= F.lit(self.end)
        return self.w.mart_ltv.where(F.col("cohort_month") <= F.lit(self.end)).withColumns({"has_full_exposure": seen, **{c: F.when(seen, F.col(c)) for c in ("ltv_revenue", "ltv_margin")}})


def equivalence(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.005) -> DataFrame:
    """column, rows, only_left, only_right, null_mismatches, differences: two frames met by their keys (null is a key), in one pass.

    A value differs where both have it and numbers are more than `tolerance` apart or others are unequal; where one side alone is null
    it is a mismatch of nulls. Every column of the result is counted over the same full join.
    """
    a, b = left.select(*keys, F.struct(*values).alias("__a")).alias("a"), right.select(*keys, F.struct(*values).alias("__b")).alias("b")
    met = a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]), "full")
    here, there = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    kinds = dict(left.dtypes)

    def differs(c: str) -> Column:
        x, y = F.col(f"__a.{c}"), F.col(f"__b.{c}")
        number = kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")
        return F.abs(x.cast("double") - y.cast("double")) > tolerance if number else x != y

    one = [F.count_if(here & there & (F.col(f"__a.{c}").isNull() != F.col(f"__b.{c}").isNull())).alias(f"n{i}") for i, c in enumerate(values)]
    two = [F.count_if(here & there & differs(c)).alias(f"d{i}") for i, c in enumerate(values)]
    totals = met.agg(F.count("*").alias("rows"), F.count_if(here & ~there).alias("only_left"), F.count_if(there & ~here).alias("only_right"), *one, *two)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_mismatches"), F.col(f"d{i}").alias("differences")) for i, c in enumerate(values)])
    return totals.select("rows", "only_left", "only_right", F.explode(each).alias("c")).select("c.column", "rows", "only_left", "only_right", "c.null_mismatches", "c.differences")


def equivalence_of_runs(left: DataFrame, right: DataFrame, key: str, values: list[str], carried: tuple[str, ...] = VARIANT, tolerance: float = 0.005) -> DataFrame:
    """What `equivalence` says of the days of two frames of runs (Warehouse.spread), by date_day and key.

    A product all of whose runs stand on both sides, once each and none over another, has equal days: they are counted by the runs' lengths. The days of every other product
    are made and met one by one. So the work is as many runs as there are sales, and days where something differs.
    """
    said = [c for c in left.columns if c not in carried]
    both = left.select(*said, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*said, F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy(*said).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    of = W.partitionBy(key).orderBy("since", "until")
    apart = (F.col("l") != 1) | (F.col("r") != 1) | (F.col("until") < F.col("since")) | F.coalesce(F.col("since") <= F.lag("until").over(of), F.lit(False))
    products = settled(both.withColumn("apart", apart).groupBy(key).agg(F.bool_or("apart").alias("apart"), F.sum(F.datediff("until", "since") + 1).alias("days")))
    some = products.where("apart").select(F.col(key).alias("_k"))
    a, b = (Warehouse.spread(x.join(some, F.col(key).eqNullSafe(F.col("_k")), "left_semi"), key, *carried) for x in (left, right))
    alike = products.where("not apart").agg(F.coalesce(F.sum("days"), F.lit(0)).alias("alike"))
    return equivalence(a, b, ["date_day", key], values, tolerance).crossJoin(F.broadcast(alike)).select("column", (F.col("rows") + F.col("alike")).alias("rows"), "only_left", "only_right", "null_mismatches", "differences")


#: mart: its keys, the columns compared, and the newest row (by this column, so many days before the cursor) that a rebuild has right.
PROVEN = {
    "mart_daily_trading": (["date_day", "channel"], ["orders", "new_customers", "returning_customers", "net_revenue", "contribution_margin", "aov", "units", "discounts", *SPEND, "ad_spend_is_complete", "blended_cac"], None),
    "mart_variant_daily": (["date_day", "variant_id"], ["units", "net_revenue", "contribution_margin", "velocity_7d", "velocity_28d", "velocity_ratio", "days_of_cover"], None),
    "mart_cohort_retention": (["cohort_month", "months_since"], ["cohort_size", "has_full_90d_exposure", "repeat_within_90d", "repeat_rate_90d"], "has_full_90d_exposure and months_since = 1"),
    "mart_ltv": (["cohort_month", "acquisition_channel", "horizon_days"], ["cohort_size", "has_full_exposure", "cum_net_revenue", "cum_contribution_margin", "ltv_revenue", "ltv_margin"], "has_full_exposure"),
    "mart_data_quality": (["source_name", "date_day"], ["observed", "is_gap", "row_count", "issue_type"], "date_day"),
    "mart_email_flow_weekly": (["flow_name", "week_start"], ["recipients", "unique_opens", "unique_orders", "order_value", "open_rate", "conversion_rate", "open_rate_8w", "conversion_rate_8w"], None),
    "fct_ad_spend_daily": (["campaign_key", "ad_date"], ["impressions", "clicks", "spend", "conversions", "cpc", "cpm", "ctr"], None),
}


def order_days(w: Warehouse, back: tuple[int, ...]) -> list[dt.date]:
    """The last days with orders that are at least so many days before the newest: a rebuild's calendar ends on one, so they make cursors."""
    days = w.fct_order.select("order_date").distinct().crossJoin(w.last_day)
    found = days.agg(*[F.max(F.when(F.col("order_date") <= F.date_sub("last_day", n), F.col("order_date"))).alias(str(n)) for n in back]).first()
    return [found[str(n)] for n in back]


def proof(w: Warehouse, cursors: list[dt.date], marts: dict | None = None) -> DataFrame:
    """mart, cursor, column and the counts of `equivalence`: each mart as a cursor sees it against a rebuild at that cursor.

    Cohort marts are compared where a detector may use them (fully exposed; of retention a cohort's one row), data quality up to the day before the cursor, as on
    the day itself a rebuild takes ads that land tomorrow for missing. A rebuild is a build: cursors are a sample. Variants' days are compared by their runs.
    """
    found = []
    for cursor in cursors:
        fast, rebuilt = AsOfWarehouse(w, cursor), Warehouse(w.raw, dataclasses.replace(w.cfg, as_of=cursor))
        rebuilt.persist("sold_lines")
        for mart, (keys, values, usable) in (marts or PROVEN).items():
            if mart == "mart_variant_daily":
                compared = equivalence_of_runs(fast.variant_runs, rebuilt.variant_runs, "variant_id", values)
                found.append(compared.select(F.lit(mart).alias("mart"), F.lit(cursor).alias("cursor"), "*"))
                continue
            a, b = getattr(fast, mart), getattr(rebuilt, mart)
            if usable == "date_day":
                a, b = (x.where(F.col("date_day") < F.lit(cursor)) for x in (a, b))
            elif usable:
                a, b = (x.where(usable) for x in (a, b))
            found.append(equivalence(a, b, keys, values).select(F.lit(mart).alias("mart"), F.lit(cursor).alias("cursor"), "*"))
    return reduce(DataFrame.unionByName, found)
