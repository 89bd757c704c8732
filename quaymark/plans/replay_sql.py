"""DuckDB SQL for the replay of all detectors, written apart from operators.replay: expressions over those of plans.oracle."""

from __future__ import annotations

from ..operators.signals import NOISE, TIERS, Thresholds
from .oracle import LONG

T = Thresholds()
LAST = "(select max(date_day) from dim_date)"
FOREVER = "date '9999-12-31'"


def erfc(x: str) -> str:
    """erfc(|x| / sqrt 2) by the same fit as the library's."""
    from ..operators.stats import ERFC

    arg = f"(abs({x}) / sqrt(2.0::double))"
    t = f"(1.0::double / (1.0::double + {arg} * 0.5::double))"
    poly = f"{ERFC[-1]}::double"
    for c in reversed(ERFC[:-1]):
        poly = f"({c}::double + {t} * {poly})"
    return f"({t} * exp(-{arg} * {arg} + {poly}))"


def placed(source: str, keys: str, order: str, value: str) -> str:
    return f"select {keys}, row_number() over (partition by {keys} order by {order}) as i, cast({value} as double) as y from {source} where {value} is not null"


def trend_test(points: str, keys: str) -> str:
    """keys, n, z, p of points(keys, i, y): Mann-Kendall from eight on."""
    return f"""
        select {keys}, n, z, case when var <= 0 then 1.0::double else {erfc('z')} end as p from (
            select {keys}, n, var, case when var <= 0 or s = 0 then 0.0::double else (s - sign(s)) / sqrt(var) end as z from (
                select {keys}, n, (n * (n - 1) * (2 * n + 5) - tied)::double / 18.0::double as var, coalesce(s, 0)::double as s
                from (select {keys}, cast(sum(c) as bigint) as n, cast(sum(c * (c - 1) * (2 * c + 5)) as bigint) as tied from (select {keys}, y, count(*) as c from {points} group by all) group by all)
                left join (select {keys}, sum(sign(b.y - a.y)) as s from {points} a join {points} b using ({keys}) where a.i < b.i group by all) using ({keys})))
        where n >= {T.min_points}"""


def slopes(points: str, keys: str) -> str:
    """keys, n, slope of points(keys, i, y): Theil-Sen."""
    return f"""
        select {keys}, n, slope from (select {keys}, count(*) as n from {points} group by all)
        left join (select {keys}, median((b.y - a.y) / (b.i - a.i)) as slope from {points} a join {points} b using ({keys}) where a.i < b.i group by all) using ({keys})"""


def adjusted(points: str) -> str:
    return f"""
        select cursor, window_end, entity, date_day, round(v / case when d > 0 and a > 0 then d / a else 1.0::double end, {NOISE}) as y, clicks from {points}
        join (select cursor, entity, iso_dow, median(v) as d from {points} group by all) using (cursor, entity, iso_dow) join (select cursor, entity, median(v) as a from {points} group by all) using (cursor, entity)"""


def windowed(rows: str) -> str:
    """rows(entity, date_day, iso_dow, since, v, clicks) as each cursor's last days show them."""
    return f"select cursor, window_end, r.* from {rows} r join clock on cursor >= since and date_day <= window_end and date_day > window_end - {T.trend_days}"


def signal(detector: str, kind: str, entity: str, severity: str, direction: str, tier: str, source: str, p: str = "null", fired: str = "window_end", classification: str = "'COMMERCIAL'", window: tuple[str, str] = ("null", "null")) -> str:
    return f"""
        select cursor, '{detector}' as detector, {kind} as entity_type, cast({entity} as varchar) as entity_id, {fired} as fired_date, cast({severity} as double) as severity, {direction} as direction, {classification} as classification,
               {tier} as attribution_tier, cast({p} as double) as p_value, cast({window[0]} as date) as window_from, cast({window[1]} as date) as window_to from {source}"""


def _both(c: str) -> str:
    """Sums of a window of days and of the one before it."""
    return f"sum({c}) filter (date_day > day - {T.evidence_days})::double as {c}_now, sum({c}) filter (date_day <= day - {T.evidence_days})::double as {c}_then"


def _kept(*columns: str) -> str:
    return " and ".join(f"{c}_{x} > 0" for c in columns for x in ("now", "then"))


_KIND, _TIER = "case when entity = 'blended' then 'account' else 'channel' end", "case when entity = 'blended' then 'B' else 'C' end"
RAISED = {
    "clock": f"""
        select cast(c as date) as cursor, least(cast(c as date), hi) as window_end, cast(c as date) >= hi as is_latest
        from (select unnest(generate_series(lo + 120, hi + 1, interval 1 day)) as c, hi from (select min(date_day) as lo, max(date_day) as hi from dim_date))""",
    "r_completeness": signal("data_completeness", "'source'", "source_name", "least((b - a + 1) / 3.0::double, 1.0::double)", "'degrading'", "'A'", f"""(
        select source_name, min(date_day) over w as a, date_day as b, max(date_day) over w as z from (select *, date_day - cast(row_number() over (partition by source_name order by date_day) as integer) as island from mart_data_quality where issue_type <> 'ok')
        window w as (partition by source_name, island)) join clock on cursor = b or (b = z and cursor > b)""", fired="b", classification="'DATA_QUALITY'", window=(f"a - {T.suppression_days}", f"b + {T.suppression_days}")),
    "variant_shares": f"""
        select variant_id, date_day, units, velocity_7d / nullif(sum(velocity_7d) over (partition by date_day), 0) as share from mart_variant_daily where date_day >= (select min(date_day) from dim_date) + {T.warmup_days}""",
    "moves": f"""
        select *, case when mad > 0 then 0.6745::double * (share - med) / mad when sd > 0 then (share - med) / sd else 0.0::double end as z from (
            select variant_id, date_day, share, median(share) over past as med, mad(share) over past as mad, stddev_pop(share) over past as sd, count(share) over past as n, sum(units) over (partition by variant_id order by date_day rows 27 preceding) as u
            from variant_shares window past as (partition by variant_id order by date_day rows between unbounded preceding and 1 preceding))
        where n >= {T.history} and u >= {T.velocity_units} and share is not null""",
    "r_velocity": signal("product_velocity", "'variant'", "variant_id", "least(abs(z), 6) / 6", "case when z > 0 then 'improving' else 'degrading' end", "'A'", f"moves join clock on window_end = date_day where abs(z) >= {T.velocity_z}"),
    "r_cover": signal("inventory_cover", "'variant'", "variant_id", f"case when days_of_cover < {T.cover_critical}::double then 1 else 0.55::double end", "'degrading'", "'A'", f"mart_variant_daily join clock on window_end = date_day where is_latest and days_of_cover < {T.cover_warning}::double"),
    "cohorts": f"select cohort_month, repeat_rate_90d as rate, greatest(exposure_90d_end, cohort_month) as since from mart_cohort_retention where repeat_rate_90d is not null and cohort_size >= {T.cohort_size} and months_since = 1",
    "cohort_states": f"select s as state, coalesce(lead(s) over (order by s) - 1, {FOREVER}) as until from (select distinct since as s from cohorts)",
    "cohort_rows": "select state, cohort_month, rate from cohorts join cohort_states on since <= state",
    "cohort_points": placed("cohort_rows", "state", "cohort_month", "rate"),
    "cohort_trend": trend_test("cohort_points", "state"),
    "r_cohort": signal("cohort_retention_shift", "'cohort'", "'all'", "least(fall / 100, 1)", "'degrading'", "'B'", f"""(
        select state, count(*) as n, 100 * (1 - arg_max(rate, cohort_month) / nullif(arg_min(rate, cohort_month), 0)) as fall from cohort_rows group by 1) left join cohort_trend using (state) join cohort_states using (state)
        join clock on cursor between state and until where cohort_rows_n >= {T.cohorts} and fall >= {T.cohort_decline_pct}::double""".replace("count(*) as n,", "count(*) as cohort_rows_n,"), p="p"),
    "heads": f"select cohort_month, ltv_margin, cohort_size, greatest(exposure_end, cohort_month) as since from mart_ltv where horizon_days = {T.horizon} and ltv_margin is not null",
    "head_states": f"select s as state, coalesce(lead(s) over (order by s) - 1, {FOREVER}) as until from (select distinct since as s from heads)",
    "head_values": """
        select state, until, ltv from (select state, until, arg_max(v, cohort_month) as ltv from (
            select state, until, cohort_month, sum(ltv_margin * cohort_size) / nullif(sum(cohort_size), 0) as v from heads join head_states on since <= state group by all) group by all) where ltv > 0""",
    "costs": """
        select 'blended' as entity, date_day, sum(ad_spend) as s, sum(new_customers) as n, greatest(date_day, coalesce(max(spend_available_on), date_day)) as since from mart_daily_trading group by date_day having bool_or(ad_spend_is_complete)
        union all select channel, date_day, ad_spend, new_customers, greatest(date_day, coalesce(spend_available_on, date_day)) from mart_daily_trading where channel in ('google', 'meta')""",
    "cost_runs": f"""
        select entity, date_day, since, coalesce(lead(since) over (partition by entity order by date_day) - 1, {FOREVER}) as until, count(*) over w as days, min(date_day) over w as first, cast(sum(s) over w as double) as spend, sum(n) over w as customers, min(s::double / n) over w as low
        from costs where s is not null and n > 0 window w as (partition by entity order by date_day rows {T.breach_days - 1} preceding)""",
    "r_breach": signal("cac_ltv_breach", _KIND, "entity", f"least(0.5 + (spend / customers / ltv / {T.breach_ratio}::double - 1) / 2, 1)", "'degrading'", _TIER, f"""
        cost_runs c join clock on cursor between c.since and c.until join head_values h on cursor between h.state and h.until
        where days = {T.breach_days} and date_day - first = {T.breach_days - 1} and customers >= {T.breach_customers} and low / ltv > {T.breach_ratio}::double"""),
    "cac_rows": """
        select 'blended' as entity, date_day, iso_dow, greatest(date_day, coalesce(max(spend_available_on), date_day)) as since, max(blended_cac)::double as v, 0 as clicks from mart_daily_trading group by date_day, iso_dow having max(blended_cac) is not null
        union all select channel, date_day, iso_dow, greatest(date_day, coalesce(spend_available_on, date_day)), channel_cac::double, 0 from mart_daily_trading where channel in ('google', 'meta') and channel_cac is not null""",
    "cac_seen": windowed("cac_rows"),
    "cac_adjusted": adjusted("cac_seen"),
    "cac_points": placed("cac_adjusted", "cursor, entity", "date_day", "y"),
    "cac_tests": trend_test("cac_points", "cursor, entity"),
    "cac_slopes": slopes("cac_points", "cursor, entity"),
    "cac_middle": "select cursor, entity, window_end, median(y) as med from cac_adjusted group by all",
    "r_cac": signal("cac_trend", _KIND, "entity", "least(abs(z), 6) / 6", "case when slope > 0 then 'degrading' else 'improving' end", _TIER, f"""
        cac_slopes join (select cursor, entity, z, p from cac_tests) using (cursor, entity) join cac_middle using (cursor, entity) where med > 0 and abs(100 * slope / med) >= {T.cac_pct_per_day}::double and p <= {T.max_p}::double""", p="p"),
    "cvr_rows": """
        select channel as entity, date_day, iso_dow, greatest(date_day, coalesce(spend_available_on, date_day)) as since, orders::double / clicks as v, clicks from mart_daily_trading where channel in ('google', 'meta') and clicks > 0""",
    "cvr_seen": windowed("cvr_rows"),
    "cvr_adjusted": adjusted("cvr_seen"),
    "cvr_points": placed("cvr_adjusted", "cursor, entity", "date_day", "y"),
    "cvr_tests": trend_test("cvr_points", "cursor, entity"),
    "cvr_slopes": slopes("cvr_points", "cursor, entity"),
    "cvr_middle": "select cursor, entity, window_end, median(y) as med, sum(clicks) as clicks from cvr_adjusted group by all",
    "r_cvr": signal("channel_cvr_shift", "'channel'", "entity", "least(abs(z), 6) / 6", "case when slope > 0 then 'improving' else 'degrading' end", "'C'", f"""
        cvr_slopes join (select cursor, entity, z, p from cvr_tests) using (cursor, entity) join cvr_middle using (cursor, entity)
        where med > 0 and clicks >= {T.cvr_clicks} and abs(100 * slope * (n - 1) / med) >= {T.cvr_pct}::double and p <= {T.max_p}::double""", p="p"),
    "ad_days": f"select ad_date as day, greatest(ad_date + 1, max(available_on)) as since, coalesce(lead(greatest(ad_date + 1, max(available_on))) over (order by ad_date) - 1, {FOREVER}) as until from fct_ad_spend_daily group by ad_date",
    "ad_sums": "select platform, ad_date as date_day, sum(spend) as spend, sum(clicks) as clicks, sum(impressions) as impressions from fct_ad_spend_daily group by all",
    "ad_windows": f"select day, since, until, platform, {_both('spend')}, {_both('clicks')}, {_both('impressions')} from ad_sums join ad_days on date_day between day - {2 * T.evidence_days - 1} and day group by all",
    "r_cpc": signal("cpc_decomposition", "'channel'", "platform", "least(abs(change) / 50, 1)", "case when change > 0 then 'degrading' else 'improving' end", "'A'", f"""(
        select *, 100 * ((spend_now / clicks_now) / (spend_then / clicks_then) - 1) as change from ad_windows where {_kept('spend', 'clicks', 'impressions')}) join clock on cursor between since and until where abs(change) >= {T.cpc_pct}::double"""),
    "baskets": "select date_day, sum(net_revenue) as net_revenue, sum(orders) as orders, sum(units) as units from mart_daily_trading group by 1 having sum(orders) > 0",
    "basket_days": f"select * from (select date_day as day, row_number() over (order by date_day) as place, coalesce(lead(date_day) over (order by date_day) - 1, {FOREVER}) as until from baskets) where place >= {2 * T.min_points}",
    "basket_moves": f"""
        select *, 100 * ((net_revenue_now / orders_now) / (net_revenue_then / orders_then) - 1) as change from (
            select day, until, {_both('net_revenue')}, {_both('orders')}, {_both('units')} from baskets join basket_days on date_day between day - {2 * T.evidence_days - 1} and day group by all) where {_kept('net_revenue', 'orders', 'units')}""",
    "basket_rows": f"select day, date_day, net_revenue::double / orders as v from baskets join (select day from basket_moves where abs(change) >= {T.aov_pct}::double) on date_day > day - {T.evidence_days} and date_day <= day",
    "basket_points": placed("basket_rows", "day", "date_day", "v"),
    "basket_tests": trend_test("basket_points", "day"),
    "r_aov": signal("aov_decomposition", "'account'", "'blended'", "least(abs(change) / 25, 1)", "case when change > 0 then 'improving' else 'degrading' end", "'B'", f"""
        basket_moves left join (select day, p from basket_tests) using (day) join clock on cursor between day and until where abs(change) >= {T.aov_pct}::double and (p is null or p <= {T.max_p}::double)""", p="p"),
    "weeks": f"select * from (select flow_name, week_start, open_rate, conversion_rate, week_start + 7 as since, row_number() over (partition by flow_name order by week_start) as place from mart_email_flow_weekly) where place > {T.email_warmup}",
    "week_states": f"select flow_name, s as state, coalesce(lead(s) over (partition by flow_name order by s) - 1, {FOREVER}) as until from (select distinct flow_name, since as s from weeks)",
    "week_rows": "select w.flow_name, state, week_start, open_rate, conversion_rate from weeks w join week_states s on s.flow_name = w.flow_name and since <= state",
    "open_points": placed("week_rows", "flow_name, state", "week_start", "open_rate"),
    "conv_points": placed("week_rows", "flow_name, state", "week_start", "conversion_rate"),
    "open_tests": trend_test("open_points", "flow_name, state"),
    "conv_tests": trend_test("conv_points", "flow_name, state"),
    "open_slopes": slopes("open_points", "flow_name, state"),
    "conv_slopes": slopes("conv_points", "flow_name, state"),
    "week_moves": """
        select flow_name, state, o.n as n_open, c.n as n_conv, case when o.n >= 3 and mo > 0 then 100 * o.slope * (o.n - 1) / mo end as opens, case when c.n >= 3 and mc > 0 then 100 * c.slope * (c.n - 1) / mc end as conv, ot.p as open_p, ct.p as conv_p
        from open_slopes o join conv_slopes c using (flow_name, state) join (select flow_name, state, median(open_rate) as mo, median(conversion_rate) as mc from week_rows group by all) using (flow_name, state)
        left join open_tests ot using (flow_name, state) left join conv_tests ct using (flow_name, state)""",
    "r_email": signal("email_engagement_decay", "'flow'", "flow_name", "least(-opens / 40, 1)", "'degrading'", "'B'", f"""
        week_moves join week_states using (flow_name, state) join clock on cursor between state and until where n_open >= {T.email_weeks} and n_conv >= {T.email_weeks} and conv is not null and opens <= -{T.open_decline_pct}::double""", p="open_p",
        classification=f"case when conv < 0 and conv / opens >= {T.comovement}::double and conv_p <= {T.max_p}::double then 'COMMERCIAL' else 'ARTIFACT' end"),
    "raised": " union all ".join(f"select * from {r}" for r in ("r_completeness", "r_velocity", "r_cover", "r_cohort", "r_breach", "r_cac", "r_cvr", "r_cpc", "r_aov", "r_email")),
    "outages": "select cursor, entity_id as source, window_from, window_to from r_completeness",
    "hidden": f"""
        select r.cursor, r.fired_date, list_sort(list(distinct source)) as suppressed_by from (select distinct cursor, fired_date from raised where detector <> 'data_completeness') r
        join outages o on o.cursor = r.cursor and r.fired_date - {T.evidence_days} <= window_to and r.fired_date >= window_from group by all""",
    "verdicts": """
        select cursor, max(p_value) as cut from (select cursor, p_value, count(*) over (partition by cursor order by p_value) as r, count(*) over (partition by cursor) as m from raised where p_value is not null)
        where p_value <= 0.10::double * r / m group by 1""",
    "adjudicated": f"""
        select x.cursor, left(sha1(detector || '|' || entity_type || '|' || entity_id || '|' || cast(x.fired_date as varchar)), 12) as signal_id, detector, entity_type, entity_id, x.fired_date, severity, direction,
               case when suppressed_by is null then classification else 'DATA_QUALITY' end as classification, attribution_tier, p_value, case when detector <> 'data_completeness' then suppressed_by end as suppressed_by,
               p_value is null or coalesce(p_value <= cut, false) as passed_fdr,
               round(severity * case attribution_tier {' '.join(f"when '{k}' then {v}::double" for k, v in TIERS.items())} end * case when suppressed_by is null then 1 else 0.3::double end, 4) as confidence
        from raised x left join hidden h on h.cursor = x.cursor and h.fired_date = x.fired_date and x.detector <> 'data_completeness' left join verdicts v on v.cursor = x.cursor""",
}
RUNS = "(select source_name, min(date_day) as first, max(date_day) as last from (select *, date_day - cast(row_number() over (partition by source_name order by date_day) as integer) as island from mart_data_quality where issue_type <> 'ok') group by source_name, island)"


def _breaks(kind: str, detector: str, monthly: str) -> str:
    """monthly(entity, month, x)"""
    return f"""
        select '{kind}:' || entity || ':' || cast(month as varchar), '{detector}', entity, month, last_day(month) + {T.evidence_days}, 'COMMERCIAL' from (
            select *, lag(x) over (partition by entity order by month) as before from ({monthly})) where abs(100 * (x / before - 1)) >= 10"""


SCORED = {
    "happened": f"""
        select * from (select 'outage:' || source_name || ':' || cast(first as varchar) as event_id, 'data_completeness' as detector, source_name as entity_id, first as onset, cast(null as date) as until, 'DATA_QUALITY' as must_classify from {RUNS}
            union all {_breaks('price', 'cpc_decomposition', "select platform as entity, cast(date_trunc('month', ad_date) as date) as month, sum(spend)::double / nullif(sum(clicks)::double, 0) as x from fct_ad_spend_daily group by all")}
            union all {_breaks('basket', 'aov_decomposition', "select 'blended' as entity, cast(date_trunc('month', date_day) as date) as month, sum(net_revenue)::double / nullif(sum(orders)::double, 0) as x from mart_daily_trading group by all")})
        where onset >= (select min(cursor) from clock)""",
    "answers": """
        select event_id, signal_id, cursor, onset from adjudicated s join happened e on s.detector = e.detector and s.entity_id = e.entity_id and s.classification = e.must_classify
        where passed_fdr and cursor >= onset - 14 and (until is null or cursor <= until)""",
    "forbidden": f"""
        select 'opens' as trap_id, 'email_engagement_decay' as detector, cast(null as date) as from_day, cast(null as date) as to_day, false as exclude_labelled, cast(null as integer) as per_cursor
        union all select 'gap:' || source_name || ':' || cast(first as varchar), 'cac_trend', first, last + 15, false, null from {RUNS} where source_name <> 'orders'
        union all select distinct 'january:' || year(cursor), null, make_date(year(cursor), 1, 1), make_date(year(cursor), 1, 31), true, 4 from clock where month(cursor) = 1""",
    "broken": """
        select trap_id, cursor from (
            select trap_id, cursor, per_cursor, count(*) over (partition by trap_id, cursor) as here from adjudicated s join forbidden t on (t.detector is null or s.detector = t.detector) and (from_day is null or cursor >= from_day) and (to_day is null or cursor <= to_day)
            where classification = 'COMMERCIAL' and passed_fdr and not (exclude_labelled and signal_id in (select signal_id from answers)))
        where per_cursor is null or here > per_cursor""",
}
#: Everything that a query over the replay of LongTables stands on.
REPLAY = LONG | RAISED | SCORED
