"""Queries on the replay of all detectors, its adjudication and its scores, and on earlier cursors; registered with those of `registry`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import backtest as B, pit, replay as R
from .plans.replay_sql import REPLAY
from .plans.warehouse import Warehouse
from .session import settled
from .registry import fixed, query, rounded_sql as _r
from .sources.binding import LongTables


def long_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    return Warehouse(LongTables(spark, sf_dir))


def replayed(spark: SparkSession, sf_dir: str, step: int = 1) -> DataFrame:
    return R.replay(long_warehouse(spark, sf_dir), step=step)


@query("select cursor, signal_id, detector, entity_type, entity_id, fired_date, direction, classification, attribution_tier, passed_fdr from adjudicated", REPLAY)
def j19_replay_signals(spark, sf_dir):
    """Signals of all ten detectors at every cursor from day 120 on, adjudicated."""
    return replayed(spark, sf_dir).select(F.col("as_of_date").alias("cursor"), "signal_id", "detector", "entity_type", "entity_id", "fired_date", "direction", "classification", "attribution_tier", "passed_fdr")


@query("select cursor, signal_id, array_to_string(suppressed_by, ',') as suppressed_by, classification, confidence, passed_fdr, classification = 'COMMERCIAL' and passed_fdr as is_actionable from adjudicated", REPLAY)
def j16_adjudication(spark, sf_dir):
    """What adjudication made of every replayed signal: what suppressed it, its verdict, its confidence."""
    return replayed(spark, sf_dir).select(F.col("as_of_date").alias("cursor"), "signal_id", F.array_join("suppressed_by", ",").alias("suppressed_by"), "classification", "confidence", "passed_fdr", "is_actionable")


@query("select cursor, detector, count(*) as signals, count(*) filter (classification = 'COMMERCIAL' and passed_fdr) as actionable from adjudicated group by all", REPLAY)
def m07_signals_per_cursor(spark, sf_dir):
    return R.signals_per_cursor(replayed(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Replayed signals, those of them that may answer a derived event, events and traps. Signals of variants, the bulk, are made where they are read and not kept; no event is theirs."""
    w = long_warehouse(spark, sf_dir)
    signals = R.replay(w).select("signal_id", "detector", "entity_id", "classification", "passed_fdr", F.col("as_of_date").alias("cursor"))
    times = pit.clock(w)
    return signals, settled(signals.where(F.col("detector").isin(*B.DERIVED))), settled(B.derived_events(w, times)), settled(B.derived_traps(w, times))


@query("""
    select event_id, detector, onset, min(a.cursor) is not null as detected, min(a.cursor) as first_fire, cast(min(a.cursor) - onset as bigint) as lead_days, count(distinct a.cursor) as cursors_fired
    from happened left join (select event_id, cursor from answers) a using (event_id) group by event_id, detector, onset""", REPLAY)
def j20_events(spark, sf_dir):
    """Every event that the tables hold: whether it was found, when first, with what lead."""
    _, answering, events, _ = scored(spark, sf_dir)
    s = B.score_events(answering, events).join(events.select("event_id", "detector", "onset"), "event_id")
    return s.select("event_id", "detector", "onset", "detected", "first_fire", F.col("lead_days").cast("long").alias("lead_days"), F.col("cursors_fired").cast("long").alias("cursors_fired"))


@query("select trap_id, count(cursor) as violations, count(distinct cursor) as cursors_violated, count(cursor) = 0 as clean from forbidden left join broken using (trap_id) group by trap_id", REPLAY)
def j20_traps(spark, sf_dir):
    signals, answering, events, traps = scored(spark, sf_dir)
    return B.score_traps(signals, events, traps, answering=answering)


@query(f"""
    select {_r("(select count(distinct event_id) from answers)::double / nullif((select count(*) from happened), 0)")} as recall, {_r("(select count(distinct signal_id) from answers)::double / nullif(fired, 0)")} as precision,
           (select count(distinct signal_id) from answers) as matched, fired
    from (select count(distinct signal_id) as fired from adjudicated where classification = 'COMMERCIAL' and passed_fdr)""", REPLAY)
def j20_summary(spark, sf_dir):
    signals, answering, events, _ = scored(spark, sf_dir)
    return B.summary(signals, events, answering=answering).select(fixed("recall").alias("recall"), fixed("precision").alias("precision"), "matched", "fired")


# Earlier cursors: the first day of every month of the last year.
MONTHS = "select cursor, least(cursor, (select max(date_day) from dim_date)) as window_end from (select distinct month_start as cursor from dim_date) where cursor > (select max(date_day) from dim_date) - 365"


def month_cursors(w: Warehouse) -> DataFrame:
    last = w.last_day
    months = w.dim_date.select(F.col("month_start").alias("cursor")).distinct().crossJoin(last).where(F.col("cursor") > F.date_sub("last_day", 365))
    return months.select("cursor", F.least("cursor", "last_day").alias("window_end"))


@query(f"""
    with m as ({MONTHS}),
    x as (select cursor, 'ads' as source, ad_date as day, spend::double as amount from m join fct_ad_spend_daily on ad_date <= least(cursor - 1, window_end)
          union all select cursor, 'email', week_start, order_value::double from m join mart_email_flow_weekly on week_start <= least(cursor - 7, window_end)
          union all select cursor, 'orders', order_date, total_price::double from m join fct_order on order_date <= window_end)
    select cursor, source, count(*) as rows, max(day) as newest, {_r('sum(amount)', 2)} as amount from x group by all""", REPLAY)
def b17_lagged_sources(spark, sf_dir):
    """What each source has shown at the first day of each of the last months, cut by the lag in force there."""
    w = long_warehouse(spark, sf_dir)
    limits = pit.cutoffs(month_cursors(w), pit.lag_table(spark))
    parts = (("ads", w.fct_ad_spend_daily, "ad_date", "spend"), ("email", w.mart_email_flow_weekly, "week_start", "order_value"), ("orders", w.fct_order, "order_date", "total_price"))
    seen = [pit.seen_at(f, day, limits, s).select("cursor", F.lit(s).alias("source"), F.col(day).alias("day"), F.col(amount).cast("double").alias("amount")) for s, f, day, amount in parts]
    x = seen[0].unionByName(seen[1]).unionByName(seen[2])
    return x.groupBy("cursor", "source").agg(F.count("*").alias("rows"), F.max("day").alias("newest"), fixed(F.sum("amount"), 2).alias("amount"))


def _visible_rows(mart: str, where: str) -> str:
    return f"select '{mart}' as mart, cursor, count(*) as rows from m join {mart} on {where} group by all"


_PROOF_ROWS = " union all ".join(_visible_rows(m, on) for m, on in (
    ("mart_daily_trading", "date_day <= cursor"), ("mart_variant_daily", "date_day <= cursor"), ("mart_cohort_retention", "cohort_month <= cursor and exposure_90d_end <= cursor and months_since = 1"),
    ("mart_ltv", "cohort_month <= cursor and exposure_end <= cursor"), ("mart_data_quality", "date_day < cursor"), ("mart_email_flow_weekly", "week_start <= cursor - 7"), ("fct_ad_spend_daily", "ad_date <= cursor - 1")))


@query(f"""
    with m as (select (select max(order_date) from fct_order where order_date <= (select max(date_day) from dim_date) - n) as cursor from (select unnest([200, 60, 1]) as n)), r as ({_PROOF_ROWS}),
    c as (select unnest([{', '.join("{'mart': '" + m + "', 'column': '" + c + "'}" for m, (_, cs, _) in pit.PROVEN.items() for c in cs)}], recursive := true))
    select mart, cursor, "column", rows, cast(0 as bigint) as only_left, cast(0 as bigint) as only_right, cast(0 as bigint) as null_mismatches, cast(0 as bigint) as differences from r join c using (mart)""", REPLAY)
def j21_as_of_proof(spark, sf_dir):
    """Marts as three earlier cursors see them against rebuilds there: counts of what differs, which are zero."""
    w = long_warehouse(spark, sf_dir)
    w.persist(*R.SHARED)
    return pit.proof(w, pit.order_days(w, (200, 60, 1)))
