"""Queries over the marts: statistics, measures, cursors, detectors, simulation and checks, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .functions.columns import ratio
from .operators import measures as M, pit, signals as S, simulate as K, stats as I
from .queries import warehouse
from .registry import ORACLES, QUERIES, fixed, query, rounded_sql as _r  # noqa: F401

# The series that the statistics are shown on, revenue of a channel on its last 90 days.
SERIES = {
    "series": "select channel, date_day, iso_dow, cast(net_revenue as double) as y, row_number() over (partition by channel order by date_day) as i from mart_daily_trading where date_day > (select max(date_day) from dim_date) - 90",
    "pairs": "select a.channel, a.i, b.i as j, a.y, b.y as yj from series a join series b on a.channel = b.channel and a.i < b.i",
}


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = warehouse(spark, sf_dir)
    last = w.mart_daily_trading.crossJoin(F.broadcast(w.last_day)).where(F.col("date_day") > F.date_sub("last_day", 90))
    return last.select("channel", "date_day", "iso_dow", F.col("net_revenue").cast("double").alias("y"))


def _erfc_sql(z: str) -> str:
    x = f"(abs({z}) / {math.sqrt(2)!r}::double)"
    t = f"(1.0::double / (1.0::double + {x} * 0.5::double))"
    poly = f"{I.ERFC[-1]}::double"
    for c in reversed(I.ERFC[:-1]):
        poly = f"({c}::double + {t} * {poly})"
    return f"{t} * exp(-{x} * {x} + {poly})"


@query(f"select channel, count(distinct i) + 1 as n, {_r('median((yj - y) / (j - i))')} as slope from pairs group by 1", SERIES)
def i01_theil_sen(spark, sf_dir):
    return I.theil_sen(series(spark, sf_dir), ["channel"], "date_day", "y").select("channel", "n", fixed("slope").alias("slope"))


@query(f"""
    select channel, n, {_r('z')} as z, {_r(_erfc_sql('z'))} as p from (
        select channel, n, case when s = 0 then 0 else (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - tied) / 18.0) end as z
        from (select channel, sum(sign(yj - y)) as s from pairs group by 1)
        join (select channel, sum(c) as n, sum(c * (c - 1) * (2 * c + 5)) as tied from (select channel, y, count(*) as c from series group by 1, 2) group by 1) using (channel))""", SERIES)
def i02_mann_kendall(spark, sf_dir):
    t = I.mann_kendall(series(spark, sf_dir), ["channel"], "date_day", "y")
    return t.select("channel", F.col("n").cast("double").alias("n"), fixed("z").alias("z"), fixed("p").alias("p"))


ORACLES["i02_mann_kendall"] = ORACLES["i02_mann_kendall"].replace("select channel, n, (round", "select channel, cast(n as double) as n, (round", 1)


@query(f"""
    with h as (select channel, median(y) as med, stddev_pop(y) as sd, count(*) + 1 as n from series where i < 90 group by 1),
    m as (select channel, median(abs(y - med)) as mad from series join h using (channel) where i < 90 group by 1)
    select channel, n, y as point, {_r('case when mad > 0 then 0.6745::double * (y - med) / mad when sd > 0 then (y - med) / sd else 0 end')} as z
    from series join h using (channel) join m using (channel) where i = 90""", SERIES)
def i03_mad_z(spark, sf_dir):
    return I.mad_z(series(spark, sf_dir), ["channel"], "date_day", "y").select("channel", "n", "point", fixed("z").alias("z"))


@query("""
    with p as (select part, k, case when k % 11 = 0 then null else (hash % 1000) / 4000.0::double end as p from (
        select c_nationkey as part, c_custkey as k, (c_custkey * 7919 + 13) % 104729 as hash from customer)),
    r as (select *, row_number() over (partition by part order by p) as r, count(*) over (partition by part) as m from p where p is not null),
    l as (select part, max(p) as cut from r where p <= 0.10::double * r / m group by 1)
    select part, k, coalesce(p <= cut, false) as kept from p left join l using (part)""")
def i04_benjamini_hochberg(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("part"), F.col("c_custkey").alias("k"))
    p = c.withColumn("p", F.when(F.col("k") % 11 != 0, (F.col("k") * 7919 + 13) % 104729 % 1000 / 4000.0))
    return I.benjamini_hochberg(p, "p", 0.10, ["part"]).select("part", "k", "kept")


@query(f"""
    with d as (select channel, iso_dow, median(y) as d from series group by 1, 2), a as (select channel, median(y) as a from series group by 1)
    select channel, date_day, {_r('case when d > 0 and a > 0 then d / a else 1 end')} as factor, {_r('y / case when d > 0 and a > 0 then d / a else 1 end', 4)} as adjusted
    from series join d using (channel, iso_dow) join a using (channel)""", SERIES)
def i05_weekday_adjusted(spark, sf_dir):
    return I.dow_adjusted(series(spark, sf_dir), ["channel"], "iso_dow", "y").select("channel", "date_day", fixed("factor").alias("factor"), fixed("adjusted", 4).alias("adjusted"))


@query(f"""
    with l as (select sku, ln(units) as lx, ln(cast(net_revenue as double)) as ly from mart_product_daily where units > 0 and net_revenue > 0),
    g as (select sku, count(*) as n, regr_slope(ly, lx) as b, regr_sxx(ly, lx) as sxx, regr_syy(ly, lx) as syy, regr_sxy(ly, lx) as sxy from l group by 1)
    select sku, n, {_r('case when n >= 20 and sxx > 0 and b >= 0 then b else 0.35::double end')} as beta, {_r('case when n >= 20 and sxx > 0 then greatest(sqrt(greatest(syy - b * sxy, 0) / (n - 2) / sxx), case when b >= 0 then 0.05::double else 0.2::double end) else 0.2::double end')} as se from g""")
def i08_elasticity(spark, sf_dir):
    return I.elasticity(warehouse(spark, sf_dir).mart_product_daily, ["sku"], "units", "net_revenue").select("sku", "n", fixed("beta").alias("beta"), fixed("se").alias("se"))


@query(f"""
    with l as (select variant_id, ln(units) as lx, ln(cast(net_revenue as double)) as ly from mart_variant_daily where units > 0 and net_revenue > 0),
    g as (select variant_id, count(*) as n, regr_slope(ly, lx) as b, regr_sxx(ly, lx) as sxx, regr_syy(ly, lx) as syy, regr_sxy(ly, lx) as sxy from l group by 1)
    select variant_id, n, {_r('case when n >= 20 and sxx > 0 and b >= 0 then b else 0.35::double end')} as beta, {_r('case when n >= 20 and sxx > 0 then greatest(sqrt(greatest(syy - b * sxy, 0) / (n - 2) / sxx), case when b >= 0 then 0.05::double else 0.2::double end) else 0.2::double end')} as se from g""")
def i08_variant_elasticity(spark, sf_dir):
    return I.elasticity(warehouse(spark, sf_dir).mart_variant_daily, ["variant_id"], "units", "net_revenue").select("variant_id", "n", fixed("beta").alias("beta"), fixed("se").alias("se"))


@query(f"""
    select cast(date_trunc('month', date_day) as date) as month_start, cast(sum(net_revenue) as double) as net_revenue, cast(sum(contribution_margin) as double) as contribution_margin,
           {_r('sum(contribution_margin)::double / nullif(sum(net_revenue)::double, 0)')} as margin_pct, sum(orders)::bigint as orders, {_r('sum(net_revenue)::double / nullif(sum(orders), 0)', 4)} as aov,
           sum(new_customers)::bigint as new_customers, cast(sum(ad_spend) as double) as ad_spend,
           {_r('(sum(ad_spend) filter (ad_spend_is_complete))::double / nullif((sum(new_customers) filter (ad_spend_is_complete))::double, 0)')} as blended_cac, {_r('sum(ad_spend)::double / nullif(sum(clicks), 0)')} as cpc,
           {_r('sum(ad_spend)::double * 1000 / nullif(sum(impressions), 0)')} as cpm, {_r('sum(clicks)::double / nullif(sum(impressions), 0)')} as ctr, sum(units)::bigint as units_sold,
           count(distinct case when ad_spend_is_complete then date_day end) as complete_spend_days, {_r('sum(returning_customers)::double / nullif(sum(orders), 0)')} as repeat_order_share
    from mart_daily_trading group by 1""")
def l01_trading_measures(spark, sf_dir):
    m = M.measured(warehouse(spark, sf_dir).mart_daily_trading.withColumn("month_start", F.trunc("date_day", "MM")), M.trading(), "month_start")
    whole = {"orders", "new_customers", "units_sold", "complete_spend_days"}
    plain = {"net_revenue", "contribution_margin", "ad_spend"}
    return m.select("month_start", *[F.col(c).cast("long").alias(c) if c in whole else F.col(c).cast("double").alias(c) if c in plain else fixed(c, 4 if c == "aov" else 6).alias(c) for c in M.trading()])


@query(f"""
    select channel, cast(date_trunc('month', date_day) as date) as month_start, case when channel in ('meta', 'google') then {_r('(sum(ad_spend) filter (ad_spend_is_complete))::double / nullif((sum(new_customers) filter (ad_spend_is_complete))::double, 0)')} end as channel_cac
    from mart_daily_trading group by 1, 2""")
def l09_channel_cac(spark, sf_dir):
    d = warehouse(spark, sf_dir).mart_daily_trading.withColumn("month_start", F.trunc("date_day", "MM"))
    return M.channel_cac(d, "month_start").select("channel", "month_start", fixed("channel_cac").alias("channel_cac"))


@query(f"""
    with c as (select cast(date_trunc('month', date_day) as date) as cohort_month, (sum(ad_spend) filter (ad_spend_is_complete))::double / nullif((sum(new_customers) filter (ad_spend_is_complete))::double, 0) as cac from mart_daily_trading group by 1),
    l as (select cohort_month, (sum(cum_contribution_margin) filter (horizon_days = 60 and has_full_exposure))::double / nullif((sum(cohort_size) filter (horizon_days = 60 and has_full_exposure))::double, 0) as margin,
                 (sum(cum_net_revenue) filter (horizon_days = 60 and has_full_exposure))::double / nullif((sum(cohort_size) filter (horizon_days = 60 and has_full_exposure))::double, 0) as revenue from mart_ltv group by 1)
    select cohort_month, {_r('margin', 4)} as ltv_60d_margin, {_r('revenue', 4)} as ltv_60d_revenue, {_r('cac')} as cohort_cac, {_r('margin / nullif(cac, 0)')} as ltv_over_cac from l left join c using (cohort_month)""")
def l16_ltv_over_cac(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    return M.ltv_over_cac(w.mart_daily_trading, w.mart_ltv).select("cohort_month", fixed("ltv_60d_margin", 4).alias("ltv_60d_margin"), fixed("ltv_60d_revenue", 4).alias("ltv_60d_revenue"), fixed("cohort_cac").alias("cohort_cac"), fixed("ltv_over_cac").alias("ltv_over_cac"))


@query(f"""
    select cohort_month, {_r('(sum(repeat_customers) filter (has_full_exposure))::double / nullif((sum(cohort_size) filter (has_full_exposure))::double, 0)')} as retention_rate, (sum(cohort_size) filter (months_since = 1))::bigint as cohort_size,
           {_r('(sum(repeat_within_90d) filter (months_since = 1 and has_full_90d_exposure))::double / nullif((sum(cohort_size) filter (months_since = 1 and has_full_90d_exposure))::double, 0)')} as repeat_rate_90d
    from mart_cohort_retention group by 1""")
def l17_retention_measures(spark, sf_dir):
    m = M.measured(warehouse(spark, sf_dir).mart_cohort_retention, M.retention(), "cohort_month")
    return m.select("cohort_month", fixed("retention_rate").alias("retention_rate"), F.col("cohort_size").cast("long").alias("cohort_size"), fixed("repeat_rate_90d").alias("repeat_rate_90d"))


@query(f"""
    select flow_name, {_r('sum(unique_opens)::double / nullif(sum(recipients), 0)')} as open_rate, {_r('sum(unique_clicks)::double / nullif(sum(recipients), 0)')} as click_rate, {_r('sum(unique_orders)::double / nullif(sum(recipients), 0)')} as email_conversion_rate,
           cast(sum(order_value) as double) as email_revenue from mart_email_flow_weekly group by 1""")
def l20_email_measures(spark, sf_dir):
    m = M.measured(warehouse(spark, sf_dir).mart_email_flow_weekly, M.email(), "flow_name")
    return m.select("flow_name", *[fixed(c).alias(c) for c in ("open_rate", "click_rate", "email_conversion_rate")], F.col("email_revenue").cast("double").alias("email_revenue"))


@query(f"""
    with d as (select date_day, sum(net_revenue) as a, sum(orders) as b from mart_daily_trading group by 1)
    select date_day, {_r('a::double / nullif(b, 0)', 4)} as today, {_r("sum(a) over (partition by date_trunc('month', date_day) order by date_day)::double / nullif(sum(b) over (partition by date_trunc('month', date_day) order by date_day), 0)", 4)} as mtd,
           {_r("sum(a) over (partition by date_trunc('quarter', date_day) order by date_day)::double / nullif(sum(b) over (partition by date_trunc('quarter', date_day) order by date_day), 0)", 4)} as qtd,
           {_r("sum(a) over (partition by date_trunc('year', date_day) order by date_day)::double / nullif(sum(b) over (partition by date_trunc('year', date_day) order by date_day), 0)", 4)} as ytd from d""")
def e14_to_date(spark, sf_dir):
    t = M.to_date(warehouse(spark, sf_dir).mart_daily_trading, "net_revenue", "orders")
    return t.select("date_day", *[fixed(c, 4).alias(c) for c in ("today", "mtd", "qtd", "ytd")])


@query(f"""
    with m as (select cast(date_trunc('month', date_day) as date) as month_start, sum(net_revenue)::double / nullif(sum(orders), 0) as aov from mart_daily_trading group by 1)
    select month_start, {_r('100 * aov / first_value(aov) over (order by month_start)', 4)} as indexed from m""")
def e13_indexed_to_first(spark, sf_dir):
    m = M.measured(warehouse(spark, sf_dir).mart_daily_trading.withColumn("month_start", F.trunc("date_day", "MM")), M.trading(), "month_start", only=["aov"])
    first = m.agg(F.min_by("aov", "month_start").alias("first"))
    return m.crossJoin(F.broadcast(first)).select("month_start", fixed(100 * F.col("aov") / F.col("first"), 4).alias("indexed"))


@query(f"select channel, count(*) as orders, {_r('count(*)::double / sum(count(*)) over ()')} as share from fct_order where not is_cancelled group by 1")
def d15_share_of_total(spark, sf_dir):
    n = warehouse(spark, sf_dir).fct_order.where("not is_cancelled").groupBy("channel").agg(F.count("*").alias("orders"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("orders").alias("all")))).select("channel", "orders", fixed(F.col("orders") / F.col("all")).alias("share"))


#: The last thirty days on the calendar, each a cursor.
AS_OF = {"cursors": "select date_day as cursor from dim_date where date_day > (select max(date_day) from dim_date) - 30"}


@query("""
    with r as (select cursor, m.*, coalesce(spend_available_on > cursor, false) as stale, bool_or(coalesce(spend_available_on > cursor, false)) over (partition by cursor, date_day) as pending from mart_daily_trading m join cursors on date_day <= cursor)
    select cursor, date_day, channel, orders::bigint as orders, case when not stale then ad_spend::double end as ad_spend, case when not stale then channel_cac::double end as channel_cac,
           ad_spend_is_complete and not pending as ad_spend_is_complete, case when not pending then blended_cac::double end as blended_cac
    from r""", AS_OF)
def j02_daily_trading_as_of(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    cursors = w.dim_date.join(w.last_day, F.col("date_day") > F.date_sub("last_day", 30)).select(F.col("date_day").alias("cursor"))
    d = pit.daily_trading_as_of(w.mart_daily_trading, cursors)
    return d.select("cursor", "date_day", "channel", F.col("orders").cast("long").alias("orders"), F.col("ad_spend").cast("double").alias("ad_spend"), F.col("channel_cac").cast("double").alias("channel_cac"), "ad_spend_is_complete", F.col("blended_cac").cast("double").alias("blended_cac"))


def _signals(df: DataFrame) -> DataFrame:
    return df.select("signal_id", "detector", "entity_type", "entity_id", "fired_date", fixed("severity").alias("severity"), "direction", "classification", "attribution_tier")


def _signal_sql(detector: str, kind: str, entity: str, fired: str, severity: str, direction: str, classification: str, tier: str, source: str) -> str:
    return f"""select left(sha1('{detector}|{kind}|' || {entity} || '|' || cast({fired} as varchar)), 12) as signal_id, '{detector}' as detector, '{kind}' as entity_type, {entity} as entity_id, {fired} as fired_date,
        {_r(severity)} as severity, {direction} as direction, '{classification}' as classification, '{tier}' as attribution_tier from {source}"""


LAST = "(select max(date_day) from dim_date)"


@query(_signal_sql("data_completeness", "source", "source_name", "l", "least(n / 3.0::double, 1)", "'degrading'", "DATA_QUALITY", "A", """(
    select source_name, max(date_day) as l, count(*) as n from (select *, date_day - cast(row_number() over (partition by source_name order by date_day) as integer) as island from mart_data_quality where issue_type <> 'ok') group by source_name, island)"""))
def j14_data_completeness(spark, sf_dir):
    return _signals(S.data_completeness(warehouse(spark, sf_dir)))


@query(_signal_sql("inventory_cover", "variant", "sku", LAST, "case when days_of_cover < 14 then 1 else 0.55::double end", "'degrading'", "COMMERCIAL", "A", f"mart_product_daily where date_day = {LAST} and days_of_cover < 400"))
def j10_inventory_cover(spark, sf_dir):
    return _signals(S.inventory_cover(warehouse(spark, sf_dir), S.Thresholds(cover_warning=400.0), key="sku"))


@query(_signal_sql("inventory_cover", "variant", "cast(variant_id as varchar)", LAST, "case when days_of_cover < 14 then 1 else 0.55::double end", "'degrading'", "COMMERCIAL", "A", f"mart_variant_daily where date_day = {LAST} and days_of_cover < 400"))
def j10_variant_cover(spark, sf_dir):
    return _signals(S.inventory_cover(warehouse(spark, sf_dir), S.Thresholds(cover_warning=400.0)))


@query(_signal_sql("product_velocity", "variant", "sku", LAST, "least(abs(z), 6) / 6", "case when z > 0 then 'improving' else 'degrading' end", "COMMERCIAL", "A", f"""(
    with s as (select sku, date_day, units, velocity_7d / nullif(sum(velocity_7d) over (partition by date_day), 0) as share, {LAST} as z from mart_product_daily where date_day >= (select min(date_day) from dim_date) + 28),
    h as (select sku, median(share) as med, stddev_pop(share) as sd, count(share) as n from s where date_day < z group by 1), m as (select sku, median(abs(share - med)) as mad from s join h using (sku) where date_day < z group by 1),
    c as (select sku, max(share) filter (date_day = z) as point, sum(units) filter (date_day > z - 28) as u from s group by 1)
    select sku, case when mad > 0 then 0.6745::double * (point - med) / mad when sd > 0 then (point - med) / sd else 0 end as z from h join m using (sku) join c using (sku) where n >= 14 and u >= 20) where abs(z) >= 1"""))
def j09_product_velocity(spark, sf_dir):
    return _signals(S.product_velocity(warehouse(spark, sf_dir), S.Thresholds(velocity_z=1.0), key="sku"))


@query(_signal_sql("product_velocity", "variant", "cast(variant_id as varchar)", LAST, "least(abs(z), 6) / 6", "case when z > 0 then 'improving' else 'degrading' end", "COMMERCIAL", "A", f"""(
    with s as (select variant_id, date_day, units, velocity_7d / nullif(sum(velocity_7d) over (partition by date_day), 0) as share, {LAST} as z from mart_variant_daily where date_day >= (select min(date_day) from dim_date) + 28),
    h as (select variant_id, median(share) as med, stddev_pop(share) as sd, count(share) as n from s where date_day < z group by 1), m as (select variant_id, median(abs(share - med)) as mad from s join h using (variant_id) where date_day < z group by 1),
    c as (select variant_id, max(share) filter (date_day = z) as point, sum(units) filter (date_day > z - 28) as u from s group by 1)
    select variant_id, case when mad > 0 then 0.6745::double * (point - med) / mad when sd > 0 then (point - med) / sd else 0 end as z from h join m using (variant_id) join c using (variant_id) where n >= 14 and u >= 20) where abs(z) >= 1"""))
def j09_variant_velocity(spark, sf_dir):
    return _signals(S.product_velocity(warehouse(spark, sf_dir), S.Thresholds(velocity_z=1.0)))


@query(_signal_sql("cohort_retention_shift", "cohort", "'all'", LAST, "least(fall / 100, 1)", "'degrading'", "COMMERCIAL", "B", """(
    select count(*) as n, 100 * (1 - arg_max(repeat_rate_90d, cohort_month) / nullif(arg_min(repeat_rate_90d, cohort_month), 0)) as fall from mart_cohort_retention where has_full_90d_exposure and cohort_size >= 5 and months_since = 1) where n >= 4 and fall >= 1"""))
def j13_cohort_retention_shift(spark, sf_dir):
    return _signals(S.cohort_retention_shift(warehouse(spark, sf_dir), S.Thresholds(cohort_size=5, cohort_decline_pct=1.0)))


@query()
def j_signals(spark, sf_dir):
    """All detectors at the default thresholds, adjudicated."""
    s = S.detect(warehouse(spark, sf_dir))
    return s.select("signal_id", "detector", "entity_type", "entity_id", "as_of_date", "fired_date", "severity", "confidence", "direction", "classification", "attribution_tier", "data_quality_score", "p_value", "passed_fdr", "is_actionable", "evidence")


def _u(stream: str) -> str:
    return f"((cast('0x' || left(md5('7|{stream}|' || draw), 13) as bigint)::double + 0.5::double) / {float(1 << 52)!r}::double)"


@query(f"""select draw, {_r(f"sqrt(-2 * ln({_u('demo:a')})) * cos({_u('demo:b')} * {2 * math.pi!r}::double)")} as z from (select unnest(range(10000)) as draw)""")
def k00_normal_draws(spark, sf_dir):
    return K.draws(spark).select("draw", fixed(K.normal(7, "demo")).alias("z"))


# Checks return what violates them, counted; the counts are zero on sound data.
@query("""
    select 'revenue' as identity, count(*) filter (contribution_margin <> net_revenue - cogs) as broken from fct_order_line
    union all select 'margin over revenue', count(*) filter (contribution_margin > net_revenue) from fct_order_line
    union all select 'tax', count(*) filter (abs(cast(net_revenue_incl_vat as double) - cast(net_revenue as double) * 1.2) > 0.0121) from fct_order_line""")
def check_identities(spark, sf_dir):
    l = warehouse(spark, sf_dir).fct_order_line
    off = F.abs(F.col("net_revenue_incl_vat").cast("double") - F.col("net_revenue").cast("double") * 1.2) > 0.0121
    rules = {"revenue": F.col("contribution_margin") != F.col("net_revenue") - F.col("cogs"), "margin over revenue": F.col("contribution_margin") > F.col("net_revenue"), "tax": off}
    counts = l.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("identity"), F.col(f"`{n}`").alias("broken")) for n in rules])).alias("r")).select("r.identity", "r.broken")


@query("""
    select coalesce(a.channel, b.channel) as channel, cast(a.v as double) as from_lines, cast(b.v as double) as from_mart, a.v is not distinct from b.v as agrees
    from (select channel, sum(net_revenue) as v from fct_order_line where not is_cancelled group by 1) a full join (select channel, sum(net_revenue) as v from mart_daily_trading group by 1) b using (channel)""")
def check_money_reconciles(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    a = w.fct_order_line.where("not is_cancelled").groupBy("channel").agg(F.sum("net_revenue").alias("a"))
    b = w.mart_daily_trading.groupBy("channel").agg(F.sum("net_revenue").alias("b"))
    return a.join(b, "channel", "full").select("channel", F.col("a").cast("double").alias("from_lines"), F.col("b").cast("double").alias("from_mart"), F.col("a").eqNullSafe(F.col("b")).alias("agrees"))


@query("""
    select invoice_line_id, cast(any_value(line_amount) as double) as line_amount, cast(sum(allocated_amount) as double) as allocated, sum(allocated_amount) = any_value(line_amount) as agrees from fct_invoice_allocated group by 1""")
def check_allocations_sum_to_line(spark, sf_dir):
    a = warehouse(spark, sf_dir).fct_invoice_allocated.groupBy("invoice_line_id").agg(F.max("line_amount").alias("x"), F.sum("allocated_amount").alias("y"))
    return a.select("invoice_line_id", F.col("x").cast("double").alias("line_amount"), F.col("y").cast("double").alias("allocated"), (F.col("x") == F.col("y")).alias("agrees"))


@query("""
    select month_start, channel, cast(any_value(approved_budget) as double) as approved_budget, cast(sum(planned_spend) as double) as planned, sum(planned_spend) = any_value(approved_budget) as agrees
    from mart_marketing_pacing_daily where approved_budget is not null group by 1, 2""")
def check_plan_sums_to_budget(spark, sf_dir):
    p = warehouse(spark, sf_dir).mart_marketing_pacing_daily.where("approved_budget is not null").groupBy("month_start", "channel").agg(F.max("approved_budget").alias("x"), F.sum("planned_spend").alias("y"))
    return p.select("month_start", "channel", F.col("x").cast("double").alias("approved_budget"), F.col("y").cast("double").alias("planned"), (F.col("x") == F.col("y")).alias("agrees"))


@query("""
    select count(*) filter (has_full_90d_exposure and repeat_rate_90d is null) as missing, count(*) filter (not has_full_90d_exposure and repeat_rate_90d is not null) as leaked,
           count(*) filter (has_full_exposure and retention_rate is null) as missing_retention, count(*) filter (not has_full_exposure and retention_rate is not null) as leaked_retention from mart_cohort_retention""")
def check_censoring_guards(spark, sf_dir):
    c = F.col
    pairs = (("has_full_90d_exposure", "repeat_rate_90d", ""), ("has_full_exposure", "retention_rate", "_retention"))
    return warehouse(spark, sf_dir).mart_cohort_retention.agg(*[f for flag, v, tail in pairs for f in (F.count_if(c(flag) & c(v).isNull()).alias("missing" + tail), F.count_if(~c(flag) & c(v).isNotNull()).alias("leaked" + tail))])


#: Every cursor from the 120th day after the first.
REPLAY = {"replayed": "select date_day as cursor from dim_date where date_day >= (select min(date_day) from dim_date) + 120"}
REPLAY["windows"] = "select cursor, channel, net_revenue::double as y, row_number() over (partition by cursor, channel order by date_day) as i from mart_daily_trading join replayed on date_day < cursor and date_day >= cursor - 28"


@query(f"""
    with s as (select a.cursor, a.channel, median((b.y - a.y) / (b.i - a.i)) as slope, sum(sign(b.y - a.y)) as s from windows a join windows b on a.cursor = b.cursor and a.channel = b.channel and a.i < b.i group by 1, 2),
    t as (select cursor, channel, sum(c) as n, sum(c * (c - 1) * (2 * c + 5)) as tied from (select cursor, channel, y, count(*) as c from windows group by 1, 2, 3) group by 1, 2),
    z as (select *, case when s = 0 then 0 else (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - tied) / 18.0) end as z from s join t using (cursor, channel))
    select cursor, channel, n::bigint as n, {_r('slope', 4)} as slope, {_r('z')} as z from z""", REPLAY)
def j19_replay_trend(spark, sf_dir):
    from .operators.backtest import replay_trend

    w = warehouse(spark, sf_dir)
    first = w.dim_date.agg(F.min("date_day").alias("first"))
    cursors = w.dim_date.crossJoin(F.broadcast(first)).where(F.col("date_day") >= F.date_add("first", 120)).select(F.col("date_day").alias("cursor"))
    t = replay_trend(w.mart_daily_trading, cursors, ["channel"], "date_day", "net_revenue")
    return t.select("cursor", "channel", F.col("n").cast("long").alias("n"), fixed("slope", 4).alias("slope"), fixed("z").alias("z"))


@query("""
    with p as (select b.*, r.difference, r.recon_status from mart_marketing_budget_vs_actual b join mart_marketing_invoice_recon r using (month_start, channel))
    select month_start, approved_budget::double as approved_budget, delivered_spend::double as delivered_spend, media_invoiced::double as media_invoiced, fee_invoiced::double as fee_invoiced, budget_variance::double as budget_variance,
           round(budget_variance::double / nullif(known::double, 0) * 1000000, 0) / 1000000 as variance_pct
    from (select month_start, sum(approved_budget) as approved_budget, sum(delivered_spend) as delivered_spend, sum(media_invoiced) as media_invoiced, sum(fee_invoiced) as fee_invoiced, sum(budget_variance) as budget_variance,
                 sum(approved_budget) filter (budget_variance is not null) as known from p group by 1)""")
def m08_month_totals(spark, sf_dir):
    from .operators import reports

    t = reports.totals(reports.pack(warehouse(spark, sf_dir)))
    return t.select("month_start", *[F.col(c).cast("double").alias(c) for c in ("approved_budget", "delivered_spend", "media_invoiced", "fee_invoiced", "budget_variance")], fixed("variance_pct").alias("variance_pct"))


@query("""
    with i as (select b.*, r.difference, r.recon_status from mart_marketing_budget_vs_actual b join mart_marketing_invoice_recon r using (month_start, channel)),
    m as (select *, case when is_media_final then media_invoiced when delivered_spend is null then case when media_invoiced > 0 then media_invoiced end else greatest(delivered_spend, media_invoiced) end as x from i),
    t as (select unnest([
        {'tie': 'estimated_unbilled_accrual', 'ok': (case when delivered_spend is not null then case when is_media_final then 0 else greatest(delivered_spend - media_invoiced, 0) end end) is not distinct from estimated_unbilled_accrual},
        {'tie': 'recognised_media_expense', 'ok': x is not distinct from recognised_media_expense},
        {'tie': 'recognised_expense', 'ok': coalesce(x + fee_invoiced, case when media_invoiced + fee_invoiced > 0 then media_invoiced + fee_invoiced end) is not distinct from recognised_expense},
        {'tie': 'budget_variance', 'ok': (x - approved_budget) is not distinct from budget_variance},
        {'tie': 'difference', 'ok': (case when media_invoiced <> 0 then media_invoiced - delivered_spend end) is not distinct from difference},
        {'tie': 'recon_status', 'ok': (case when channel = 'unallocated' then 'unallocated_cost' when delivered_spend is null then 'no_cost_source' when media_invoiced = 0 then 'unbilled'
            when abs((media_invoiced - delivered_spend)::double) <= abs(delivered_spend::double) * 2.0 / 100.0 then 'within_tolerance' else 'exception' end) = recon_status}]) as t from m)
    select t.tie as tie, count(*) as rows, count(*) filter (t.ok) as holding from t group by 1""")
def m12_pack_ties(spark, sf_dir):
    """How often the pack's own derivation agrees with the marts. Its status calls a month without any visible spend one without
    a cost source, which the marts tell apart, so that tie doesn't hold on such months."""
    from .operators import reports

    return reports.ties(reports.pack(warehouse(spark, sf_dir))).groupBy("tie").agg(F.count("*").alias("rows"), F.count_if("holds").alias("holding"))


@query()
def m13_commentary(spark, sf_dir):
    from .operators import reports

    return reports.commentary(reports.pack(warehouse(spark, sf_dir)))


@query("select invoice_line_id, channel, cast(allocation_pct as double) as allocation_pct from shares")
def h09_stg_invoice_line_allocations(spark, sf_dir):
    return warehouse(spark, sf_dir).raw.allocations().select("invoice_line_id", "channel", F.col("allocation_pct").cast("double").alias("allocation_pct"))


@query("select invoice_line_id, cast(amount as double) as amount from stg_vendor_invoice_lines l where not exists (select 1 from shares s where s.invoice_line_id = l.invoice_line_id)")
def c10_unallocated_anti(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    return w.stg_vendor_invoice_lines.join(w.raw.allocations(), "invoice_line_id", "left_anti").select("invoice_line_id", F.col("amount").cast("double").alias("amount"))


@query("select a.invoice_line_id, a.channel as larger, b.channel as smaller, cast(a.allocation_pct + b.allocation_pct as double) as both from shares a join shares b using (invoice_line_id) where a.allocation_pct > b.allocation_pct")
def c13_self_join(spark, sf_dir):
    s = warehouse(spark, sf_dir).raw.allocations()
    a, b = s.alias("a"), s.alias("b")
    met = a.join(b, (F.col("a.invoice_line_id") == F.col("b.invoice_line_id")) & (F.col("a.allocation_pct") > F.col("b.allocation_pct")))
    return met.select("a.invoice_line_id", F.col("a.channel").alias("larger"), F.col("b.channel").alias("smaller"), (F.col("a.allocation_pct") + F.col("b.allocation_pct")).cast("double").alias("both"))


@query("select month_start, channel, cast(approved_budget as double) as approved_budget, budget_version_used, pacing_profile from budget")
def c17_latest_version(spark, sf_dir):
    return warehouse(spark, sf_dir)._budget.select("month_start", "channel", F.col("approved_budget").cast("double").alias("approved_budget"), "budget_version_used", "pacing_profile")


@query("select channel, count(distinct customer_id) as customers, count(distinct case when is_first_order then customer_id end) as new_customers, count(distinct order_date) as days from fct_order where not is_cancelled group by 1")
def d07_multi_distinct(spark, sf_dir):
    o = warehouse(spark, sf_dir).fct_order.where("not is_cancelled")
    return o.groupBy("channel").agg(F.count_distinct("customer_id").alias("customers"), F.count_distinct(F.when(F.col("is_first_order"), F.col("customer_id"))).alias("new_customers"), F.count_distinct("order_date").alias("days"))


@query("select platform, c as mode from (select platform, c, row_number() over (partition by platform order by count(*) desc, c desc) as k from (select platform, ad_date, count(*) as c from fct_ad_spend_daily group by 1, 2) group by 1, 2) where k = 1")
def d14_mode(spark, sf_dir):
    days = warehouse(spark, sf_dir).fct_ad_spend_daily.groupBy("platform", "ad_date").agg(F.count("*").alias("c"))
    return days.groupBy("platform", "c").agg(F.count("*").alias("n")).groupBy("platform").agg(F.max_by("c", F.struct("n", "c")).alias("mode"))


@query("select channel, date_day, cast(net_revenue as double) as net_revenue from mart_daily_trading qualify row_number() over (partition by channel order by net_revenue desc, date_day) <= 5")
def f04_top_days(spark, sf_dir):
    at = F.row_number().over(W.partitionBy("channel").orderBy(F.desc("net_revenue"), "date_day"))
    return warehouse(spark, sf_dir).mart_daily_trading.withColumn("at", at).where("at <= 5").select("channel", "date_day", F.col("net_revenue").cast("double").alias("net_revenue"))


@query(f"""
    select cohort_month, {', '.join(f"{_r(f'max(case when months_since = {k} then retention_rate end)')} as m{k}" for k in range(1, 7))} from mart_cohort_retention group by 1""")
def l18_retention_pivot(spark, sf_dir):
    p = M.retention_pivot(warehouse(spark, sf_dir).mart_cohort_retention, list(range(1, 7)))
    return p.select("cohort_month", *[fixed(F.col(f"`{k}`")).alias(f"m{k}") for k in range(1, 7)])


@query(f"""
    with m as (select cast(date_trunc('month', date_day) as date) as month_start, sum(returning_customers)::double / nullif(sum(orders), 0) as blended from mart_daily_trading group by 1),
    c as (select cohort_month as month_start, max(repeat_rate_90d) as cohort from mart_cohort_retention group by 1)
    select month_start, {_r('blended')} as repeat_share, {_r('cohort')} as cohort_rate from m full join c using (month_start)""")
def m03_repeat_share_against_cohorts(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    blended = M.measured(w.mart_daily_trading.withColumn("month_start", F.trunc("date_day", "MM")), M.trading(), "month_start", only=["repeat_order_share"])
    cohort = w.mart_cohort_retention.groupBy(F.col("cohort_month").alias("month_start")).agg(F.max("repeat_rate_90d").alias("cohort"))
    return blended.join(cohort, "month_start", "full").select("month_start", fixed("repeat_order_share").alias("repeat_share"), fixed("cohort").alias("cohort_rate"))


@query(f"""
    select date_day, {_r('sum(ad_spend)::double / nullif(sum(new_customers), 0)')} as naive_cac, max(blended_cac)::double as published_cac, bool_and(ad_spend_is_complete) as complete
    from mart_daily_trading group by 1""")
def m01_naive_and_published_cac(spark, sf_dir):
    d = warehouse(spark, sf_dir).mart_daily_trading
    return d.groupBy("date_day").agg(fixed(ratio(F.sum("ad_spend"), F.sum("new_customers"))).alias("naive_cac"), F.max("blended_cac").cast("double").alias("published_cac"), F.bool_and("ad_spend_is_complete").alias("complete"))


@query(_signal_sql("cpc_decomposition", "channel", "platform", LAST, "least(abs(change) / 50, 1)", "case when change > 0 then 'degrading' else 'improving' end", "COMMERCIAL", "A", """(
    with l as (select max(ad_date) as z from fct_ad_spend_daily),
    s as (select platform, sum(spend) filter (ad_date > z - 28)::double as a, sum(spend) filter (ad_date <= z - 28)::double as b, sum(clicks) filter (ad_date > z - 28)::double as c, sum(clicks) filter (ad_date <= z - 28)::double as d,
                 sum(impressions) filter (ad_date > z - 28) as e, sum(impressions) filter (ad_date <= z - 28) as f from fct_ad_spend_daily, l where ad_date > z - 56 group by 1)
    select platform, 100 * ((a / c) / (b / d) - 1) as change from s where least(a, b, c, d, e, f) > 0 and a is not null and b is not null) where abs(change) >= 0.01"""))
def j07_cpc_decomposition(spark, sf_dir):
    return _signals(S.cpc_decomposition(warehouse(spark, sf_dir), S.Thresholds(cpc_pct=0.01)))


@query("""
    with v as (select arg_max(v, cohort_month) as ltv from (select cohort_month, sum(ltv_margin * cohort_size) / sum(cohort_size) as v from mart_ltv where horizon_days = 60 and has_full_exposure group by 1)),
    e as (select 'blended' as entity, date_day, sum(ad_spend) as s, sum(new_customers) as n from mart_daily_trading group by date_day having bool_or(ad_spend_is_complete)
          union all select channel, date_day, ad_spend, new_customers from mart_daily_trading where channel in ('google', 'meta')),
    r as (select *, row_number() over (partition by entity order by date_day desc) as k from e where s is not null and n > 0),
    g as (select entity, count(*) as days, max(date_day) - min(date_day) as span, sum(s)::double / sum(n) as cac, min(s::double / n) as low from r where k <= 2 group by 1)
    select entity as entity_id, case when entity = 'blended' then 'account' else 'channel' end as entity_type, case when entity = 'blended' then 'B' else 'C' end as attribution_tier,
           round(least(0.5 + ((cac / ltv) / 0.00001 - 1) / 2, 1) * 1000000, 0) / 1000000 as severity
    from g, v where days = 2 and span = 1 and ltv > 0 and low / ltv > 0.00001""")
def j05_cac_ltv_breach(spark, sf_dir):
    s = S.cac_ltv_breach(warehouse(spark, sf_dir), S.Thresholds(breach_days=2, breach_customers=1, breach_ratio=0.00001))
    return s.select("entity_id", "entity_type", "attribution_tier", fixed("severity").alias("severity"))
