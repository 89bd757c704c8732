"""Queries of simulation, gate and recommendations, each with its SQL on the same draws."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .operators import recommend as R, signals as S, simulate as K
from .queries import warehouse
from .registry import fixed, query, rounded_sql as _r


def _u(seed: int, stream: str, draw: str = "draw") -> str:
    return f"((cast('0x' || left(md5('{seed}|{stream}|' || {draw}), 13) as bigint)::double + 0.5::double) / {float(1 << 52)!r}::double)"


def _z(seed: int, stream: str) -> str:
    return f"(sqrt(-2 * ln({_u(seed, stream + ':a')})) * cos({_u(seed, stream + ':b')} * {2 * math.pi!r}::double))"


LAST = "(select max(date_day) from mart_daily_trading)"
INPUTS = {
    "draws": "select unnest(range(10000)) as draw",
    "known": "select channel, date_day, ad_spend::double as x, new_customers as k from mart_daily_trading where ad_spend is not null",
    "logs": "select channel, ln(x) as lx, ln(x / k) as ly from known join (select channel, max(date_day) as e from known where k > 0 group by 1) using (channel) where x > 0 and k > 0 and date_day > e - 90",
    "fits": "select channel, count(*) as n, regr_slope(ly, lx) as b, regr_sxx(ly, lx) as sxx, sqrt(greatest(regr_syy(ly, lx) - regr_slope(ly, lx) * regr_sxy(ly, lx), 0) / nullif(count(*) - 2, 0) / nullif(regr_sxx(ly, lx), 0)) as e from logs group by 1",
    "channels": f"""select channel, avg(x) as spend, sum(x) / greatest(sum(k), 1) as cac,
        coalesce(any_value(case when n >= 20 and sxx > 0 and b >= 0 then b end), 0.35::double) as beta, coalesce(any_value(case when n >= 20 and sxx > 0 then greatest(e, case when b >= 0 then 0.05::double else 0.2::double end) end), 0.2::double) as se
        from known left join fits using (channel) where date_day > {LAST} - 90 group by 1 having avg(x) > 0""",
    "worth": """select arg_max(m, cohort_month) as margin, arg_max(r, cohort_month) as revenue from (select cohort_month, sum(ltv_margin::double * cohort_size) / sum(cohort_size) as m, sum(ltv_revenue::double * cohort_size) / sum(cohort_size) as r
        from mart_ltv where horizon_days = 60 and has_full_exposure group by 1)""",
    "costs": "select channel, sum(x) / sum(k) as cac from known group by 1 having sum(x) > 0 and sum(k) > 0",
    "pairs_of": "select d.donor, c.channel as receiver from (values ('meta'), ('google')) as d(donor) join costs c on c.channel <> d.donor qualify row_number() over (partition by d.donor order by c.cac, c.channel) = 1",
    "sides": "select p.donor, p.receiver, d.spend as d_spend, d.cac as d_cac, d.beta as d_beta, d.se as d_se, r.spend as r_spend, r.cac as r_cac, r.beta as r_beta, r.se as r_se, margin, revenue from pairs_of p join channels d on d.channel = p.donor join channels r on r.channel = p.receiver cross join worth",
}


def _moved(source: str) -> str:
    """Draws of moving `shift` in each row of a source with the columns of `sides`."""
    side = lambda s, scale, name: f"30 * d_spend * shift / (greatest({s}_cac * (1 + 0.15::double * {_z(7, name + ' cac')}), 0.01) * pow({scale}, least(greatest({s}_beta + {s}_se * {_z(7, name + ' beta')}, 0), 1.5)))"
    gain, loss = side("r", "(r_spend + d_spend * shift) / r_spend", "receiver"), side("d", "greatest(1 - shift, 0.01)", "donor")
    return f"""select *, net * greatest(margin * (1 + 0.2::double * {_z(7, 'ltv margin')}), 0) as dm, net * greatest(revenue * (1 + 0.2::double * {_z(7, 'ltv revenue')}), 0) as dr from (select *, {gain} - {loss} as net from ({source}), draws)"""


def _refreshed(source: str) -> str:
    won = f"least(greatest(uplift * (0.5::double + 0.4::double * {_z(11, 'uplift')}), 0), uplift * 1.5::double)"
    return f"""select *, net * greatest(margin * (1 + 0.2::double * {_z(11, 'ltv margin')}), 0) - (1500 + 400 * {_z(11, 'cost')}) as dm, net * greatest(revenue * (1 + 0.2::double * {_z(11, 'ltv revenue')}), 0) as dr
        from (select *, d_spend * 30 / d_cac * {won} as net from ({source}), draws)"""


TOLD = ", ".join(f"{_r(x, 4)} as {n}" for x, n in (("quantile_cont(dm, 0.1)", "p10"), ("quantile_cont(dm, 0.5)", "median"), ("quantile_cont(dm, 0.9)", "p90"), ("quantile_cont(dr, 0.5)", "revenue_median"), ("avg((dm > 0)::int)", "p_positive")))
WAITS = "case when p10 < 0 and p90 > 0 and p_positive > 0.35 and p_positive < 0.65 then 'WAIT' else 'ACT' end"


def _tell():
    return [fixed(c, 4).alias(c) for c in ("p10", "median", "p90", "revenue_median", "p_positive")]


@query("select channel, " + ", ".join(f"{_r(x)} as {n}" for x, n in (("spend", "spend_per_day"), ("cac", "cac"), ("beta", "beta"), ("se", "beta_se"))) + " from channels", INPUTS)
def i08_cac_elasticity(spark, sf_dir):
    """What channels spend, what a customer costs there and how that rises with spend, over 90 days."""
    s = K.channel_state(warehouse(spark, sf_dir).mart_daily_trading)
    return s.select("channel", *[fixed(c).alias(c) for c in ("spend_per_day", "cac", "beta", "beta_se")])


@query(f"select *, {WAITS} as advice from (select donor, receiver, {TOLD} from ({_moved('select *, 0.2::double as shift from sides')}) group by 1, 2)", INPUTS)
def k01_reallocation(spark, sf_dir):
    """A fifth of each donor's spend moved to its cheapest alternative."""
    w = warehouse(spark, sf_dir)
    donors = spark.createDataFrame([(d,) for d in R.DONORS], "donor string").coalesce(1)
    cases = R.with_channels(donors, w.mart_daily_trading).withColumn("shift", F.lit(R.SHIFT)).crossJoin(F.broadcast(K.cohort_value(w.mart_ltv)))
    return K.worth_waiting(K.summary(K.reallocation(cases), "donor", "receiver")).select("donor", "receiver", *_tell(), "advice")


@query(f"select *, {WAITS} as advice from (select donor as channel, {TOLD} from ({_refreshed('select *, 0.25::double as uplift from sides')}) group by 1)", INPUTS)
def k02_creative_refresh(spark, sf_dir):
    """A fall of a quarter in click rate to win back, for each channel with spend."""
    w = warehouse(spark, sf_dir)
    donors = spark.createDataFrame([(d,) for d in R.DONORS], "donor string").coalesce(1)
    cases = R.with_channels(donors, w.mart_daily_trading).crossJoin(F.broadcast(K.cohort_value(w.mart_ltv)))
    cases = cases.select(F.col("donor").alias("channel"), F.col("donor_spend_per_day").alias("spend_per_day"), F.col("donor_cac").alias("cac"), F.lit(0.25).alias("uplift"), "ltv_margin", "ltv_revenue")
    return K.worth_waiting(K.summary(K.creative_refresh(cases), "channel")).select("channel", *_tell(), "advice")


SHORTEST = {
    "draws": INPUTS["draws"],
    "low": f"select variant_id from mart_variant_daily where date_day = {LAST} and days_of_cover is not null order by days_of_cover, variant_id limit 3",
    "goods": f"""select variant_id, max(inventory_quantity) filter (date_day = {LAST})::double as on_hand, sum(contribution_margin) filter (date_day = {LAST})::double / nullif(sum(units) filter (date_day = {LAST}), 0) as today,
        sum(contribution_margin)::double / nullif(sum(units), 0) as ever from mart_variant_daily join low using (variant_id) group by 1""",
    "priced": "select variant_id, on_hand, case when today > 0 then today else ever end as unit from goods where case when today > 0 then today else ever end > 0",
    "pool": f"select variant_id, row_number() over (partition by variant_id order by date_day) - 1 as place, count(*) over (partition by variant_id) as size, units from mart_variant_daily join low using (variant_id) where date_day > {LAST} - 90",
    "leads": f"select draw, unnest(range(1, trunc(greatest(21 * (1 + 0.25::double * {_z(13, 'lead')}), 1))::int + 1)) as d from draws",
    "picks": f"select variant_id, draw, cast(floor({_u(13, 'pick', chr(39).join(['draw || ', '/', ' || d']))} * size) as bigint) as place from leads, (select distinct variant_id, size from pool)",
    "sold": "select variant_id, draw, sum(units)::double as sold from picks join pool using (variant_id, place) group by 1, 2",
}


@query(f"""
    select variant_id, {_r('avg((short > 0)::int)', 4)} as p_stockout, {_r('quantile_cont(short, 0.9)', 4)} as short_p90, {_r('quantile_cont(0 - short * unit, 0.1)', 4)} as p10, {_r('median(0 - short * unit)', 4)} as median, {_r('quantile_cont(0 - short * unit, 0.9)', 4)} as p90
    from (select variant_id, unit, greatest(sold - on_hand, 0) as short from sold join priced using (variant_id)) group by 1""", SHORTEST)
def k03_reorder(spark, sf_dir):
    """Margin at risk over a reorder's lead time for the three variants with the fewest days of cover (a report of three)."""
    w = warehouse(spark, sf_dir)
    low = w.product_last("variant_id").where("days_of_cover is not null").orderBy("days_of_cover", "variant_id").limit(3).select("variant_id")
    cases = K.stock_cases(w.spread(w.variant_runs.join(F.broadcast(low), "variant_id"), "variant_id"), w.last_day)
    s = K.summary(K.reorder(cases, R.LEAD_DAYS), "variant_id", directional=False)
    return s.select("variant_id", *[fixed(c, 4).alias(c) for c in ("p_stockout", "short_p90", "p10", "median", "p90")])


# Situations that the gate tells apart.
SITUATIONS = (
    ("looked into", "INVESTIGATE_DATA", 0.9, "ACT", 0.95, True, "A"), ("does not pay", "REALLOCATE_SPEND", 0.54, "WAIT", 0.95, True, "A"), ("in doubt", "REALLOCATE_SPEND", 0.6, "WAIT", 0.95, True, "A"),
    ("unsure", "REALLOCATE_SPEND", 0.9, "ACT", 0.49, False, "C"), ("for good", "REORDER_INVENTORY", None, "ACT", 0.95, False, "A"), ("by last click", "PAUSE_CAMPAIGN", None, None, 0.95, True, "C"),
    ("sure", "PAUSE_CAMPAIGN", None, None, 0.80, True, "B"), ("half sure", "ADJUST_FLOW", None, None, 0.79, True, "B"), ("on the edge", "ADJUST_FLOW", 0.55, "ACT", 0.50, True, "A"),
)
_row = lambda r: "(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")"


@query("""
    select situation, case rule when 1 then 'FLAG FOR REVIEW' when 2 then 'MONITOR' when 3 then 'WAIT' when 4 then 'MONITOR' when 5 then 'FLAG FOR REVIEW' when 6 then 'FLAG FOR REVIEW' when 7 then 'AUTO-EXECUTE' else 'AUTO-EXECUTE (capped magnitude)' end as autonomy, case when rule = 8 then 0.1::double end as cap
    from (select situation, list_min(list_filter([if(kind = 'INVESTIGATE_DATA', 1, null), if(p < 0.55, 2, null), if(advice = 'WAIT', 3, null), if(sure < 0.5, 4, null), if(not back, 5, null), if(tier = 'C', 6, null), if(sure >= 0.8, 7, null), 8], lambda x: x is not null)) as rule
          from (values """ + ", ".join(_row(r) for r in SITUATIONS) + ") as v(situation, kind, p, advice, sure, back, tier))")
def k06_gate(spark, sf_dir):
    rows = spark.createDataFrame(list(SITUATIONS), "situation string, action_type string, p_positive double, advice string, confidence double, is_reversible boolean, attribution_tier string").coalesce(1)
    return K.autonomy(rows).select("situation", "autonomy", "cap")


@query()
def k07_recommendations(spark, sf_dir):
    """Of all signals at the default thresholds, sized, gated and one for each action and entity."""
    w = warehouse(spark, sf_dir)
    r = R.dedupe(R.recommend(w, S.detect(w)))
    return r.select("as_of_date", "action_type", "entity_id", "magnitude", "magnitude_unit", "confidence", "is_reversible", "autonomy", "detector", "signal_id", "median", "revenue_median", "p_positive", "p10", "p90", "notes")


CLICKS = INPUTS | {
    "sums": f"""select channel, sum(x) filter (date_day > {LAST} - 28) as a, sum(x) filter (date_day <= {LAST} - 28) as b, sum(clicks) filter (date_day > {LAST} - 28)::double as c, sum(clicks) filter (date_day <= {LAST} - 28)::double as d,
        sum(impressions) filter (date_day > {LAST} - 28)::double as e, sum(impressions) filter (date_day <= {LAST} - 28)::double as f from known join mart_daily_trading using (channel, date_day) where date_day > {LAST} - 56 group by 1""",
    "moved": "select channel, 100 * ((a / nullif(c, 0)) / nullif(b / nullif(d, 0), 0) - 1) as change, abs(ln((a / nullif(e, 0)) / nullif(b / nullif(f, 0), 0))) as auction, (c / nullif(e, 0)) / nullif(d / nullif(f, 0), 0) as ctr from sums",
    "dearer": "select channel, least(abs(change) / 50, 1) as sure, auction / nullif(auction + abs(ln(ctr)), 0) as share, abs(100 * (ctr - 1)) / 100 as uplift from moved where abs(change) >= 0.01",
    "cases": "select s.*, sure, uplift, least(0.2::double * coalesce(share, 1), 0.3::double) as shift from dearer join sides s on s.donor = channel",
    "told": f"""select 'REALLOCATE_SPEND' as action_type, donor || ' -> ' || receiver as entity_id, round(shift * 10000, 0) / 10000 as magnitude, sure, {TOLD} from ({_moved('select * from cases')}) group by donor, receiver, shift, sure
        union all select 'REFRESH_CREATIVE', donor, uplift, sure, {TOLD} from ({_refreshed('select * from cases where uplift > 0')}) group by donor, uplift, sure""",
}


@query(f"""
    with g as (select *, case when p_positive < 0.55 then 'MONITOR' when {WAITS} = 'WAIT' then 'WAIT' when sure < 0.5 then 'MONITOR' when sure >= 0.8 then 'AUTO-EXECUTE' else 'AUTO-EXECUTE (capped magnitude)' end as autonomy from told)
    select action_type, entity_id, {_r("case when action_type = 'REALLOCATE_SPEND' and autonomy like '%capped%' then least(magnitude, 0.1) else magnitude end")} as magnitude, autonomy, p10, median, p90, revenue_median, p_positive from g""", CLICKS)
def k08_spend_recommendations(spark, sf_dir):
    """Moves of spend and refreshes for clicks that got dearer or cheaper by any measure up to the last day of trading, before suppression."""
    w = warehouse(spark, sf_dir)
    s = S.cpc_decomposition(w, S.Thresholds(cpc_pct=0.01), traded=True).withColumn("confidence", F.col("severity"))
    acted = R.actions(s).crossJoin(F.broadcast(K.cohort_value(w.mart_ltv)))  # one row
    return R.gated(R.spend(w, acted)).select("action_type", "entity_id", fixed("magnitude").alias("magnitude"), "autonomy", *_tell())
