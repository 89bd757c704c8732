import json
import math

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from quaymark.operators import signals as S, simulate as K, stats as I
from quaymark.operators.signals import adjudicate
from quaymark.queries import warehouse


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, i int, y double")


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize("values, slope", [([0, 2, 4, 6, 8, 10], 2.0), ([500 if i == 10 else i for i in range(20)], 1.0), ([1, None, 3, 5], 2.0)])
def test_slope_is_the_median_of_pairs(spark, values, slope):
    assert one(I.theil_sen(frame(spark, values), ["k"], "i", "y"))["slope"] == pytest.approx(slope, abs=0.01)


def test_order_comes_from_the_column_not_the_rows(spark):
    f = frame(spark, [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5])
    a, b = (one(I.mann_kendall(x, ["k"], "i", "y")) for x in (f, f.orderBy(F.rand(3)).repartition(3)))
    assert a == b


def test_trend_is_seen_and_ties_are_not_one(spark):
    up, flat = (one(I.mann_kendall(frame(spark, v), ["k"], "i", "y")) for v in (range(15), [5] * 15))
    assert up["p"] < 0.001 and (flat["z"], flat["p"]) == (0.0, 1.0)
    assert one(I.mann_kendall(frame(spark, [1, 2, 3]), ["k"], "i", "y"))["p"] is None


@pytest.mark.parametrize("z", [0.0, 0.5, 1.96, 5.57])
def test_two_sided_p(spark, z):
    assert one(spark.range(1).select(I.two_sided_p(F.lit(z)).alias("p")))["p"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=2e-7)


def test_robust_z(spark):
    assert one(I.mad_z(frame(spark, [10, 10, 11, 10, 9, 10, 10, 30]), ["k"], "i", "y"))["z"] > 3
    assert one(I.mad_z(frame(spark, [7] * 8), ["k"], "i", "y"))["z"] == 0.0


def test_step_up_control_keeps_up_to_the_last_passing_rank(spark):
    p = [0.001, 0.008, 0.04, 0.6, 0.9, float("nan"), None]
    kept = {r["i"]: r["kept"] for r in I.benjamini_hochberg(frame(spark, p), "y", 0.10, ["k"]).collect()}
    assert [kept[i] for i in range(7)] == [True, True, True, False, False, False, False]


def test_weekday_factor(spark):
    rows = spark.createDataFrame([("a", d, 20.0 if d == 6 else 10.0) for _ in range(8) for d in range(1, 8)], "k string, d int, v double")
    got = {r["d"]: (r["factor"], r["adjusted"]) for r in I.dow_adjusted(rows, ["k"], "d", "v").collect()}
    assert got[6] == (2.0, 10.0) and got[1] == (1.0, 10.0)


def test_persistence(spark):
    rows = spark.createDataFrame([("a", i, f) for i, f in enumerate([False, True, True, True])], "k string, i int, f boolean")
    assert [one(I.persistent(rows, ["k"], "i", "f", n))["persistent"] for n in (3, 4, 5)] == [True, False, False]


def test_draws_do_not_depend_on_partitions(spark):
    d = K.draws(spark, 2000)
    z = K.normal(7, "x").alias("z")
    a, b = ([r["z"] for r in f.select("draw", z).orderBy("draw").collect()] for f in (d, d.repartition(7)))
    assert a == b
    assert abs(sum(a) / 2000) < 0.08 and 0.94 < (sum(x * x for x in a) / 2000) ** 0.5 < 1.06


def test_stockout_is_likely_when_demand_exceeds_stock(spark):
    """21 days of 5 units against 40 in stock; the risk has no chance of gain and never waits."""
    cases = spark.createDataFrame([(1, 40.0, 10.0, [5.0] * 90)], "variant_id int, on_hand double, unit_margin double, pool array<double>")
    got = K.reorder(cases, 21.0, n=1000)
    assert got.where("short > 0").count() > 900 and got.where("margin_delta > 0").count() == 0
    r = one(K.worth_waiting(K.summary(got, "variant_id", directional=False)))
    assert r["p_positive"] is None and r["width_after"] is None and r["advice"] == "ACT" and r["p10"] <= r["median"] < 0 and r["p_stockout"] > 0.9


def case(spark, **more):
    row = {f"{s}_{c}": v for s, cac in (("donor", 42.0), ("receiver", 30.0)) for c, v in (("spend_per_day", 500.0), ("cac", cac), ("beta", 0.35), ("beta_se", 0.0))} | {"shift": 0.2, "ltv_margin": 55.0, "ltv_revenue": 80.0}
    return spark.createDataFrame([row | more])


def test_moving_spend_pays_where_customers_are_cheaper(spark):
    s = one(K.summary(K.reallocation(case(spark), n=4000)))
    assert s["p_positive"] > 0.75 and s["revenue_median"] > s["median"] > 0
    # By hand, with every draw at its middle: 3,000 moved over 30 days.
    middle = 55 * 3000 * (1 / (30 * 1.2**0.35) - 1 / (42 * 0.8**0.35))
    assert abs(s["median"] - middle) < 100
    assert one(K.summary(K.reallocation(case(spark, receiver_cac=80.0), n=4000)))["p_positive"] < 0.1
    steep = one(K.summary(K.reallocation(case(spark, receiver_beta=9.0), n=4000)))  # as at 1.5
    assert steep["median"] == one(K.summary(K.reallocation(case(spark, receiver_beta=1.5), n=4000)))["median"]


def test_a_refresh_loses_at_most_its_cost(spark):
    cases = spark.createDataFrame([(500.0, 40.0, 0.25, 55.0, 80.0), (500.0, 40.0, 0.0, 55.0, 80.0)], "spend_per_day double, cac double, uplift double, ltv_margin double, ltv_revenue double")
    d = K.creative_refresh(cases, n=4000)
    nothing = one(K.summary(d.where("uplift = 0")))
    assert abs(nothing["median"] + 1500) < 40 and nothing["revenue_median"] == 0
    assert abs(one(K.summary(d.where("uplift > 0")))["median"] - (375 * 0.125 * 55 - 1500)) < 150


def test_elasticity_of_a_falling_cost_is_the_prior(spark):
    rows = [("up", float(x), float(x) ** 0.5) for x in range(1, 41)] + [("down", float(x), 50.0 / x) for x in range(1, 41)] + [("few", float(x), float(x)) for x in range(1, 20)] + [("same", 3.0, float(x)) for x in range(1, 41)]
    got = {r["k"]: (round(r["beta"], 6), round(r["se"], 6)) for r in I.elasticity(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got == {"up": (0.5, 0.05), "down": (0.35, 0.2), "few": (0.35, 0.2), "same": (0.35, 0.2)}


def test_gate(spark):
    from quaymark.decisions import SITUATIONS

    df = spark.createDataFrame(list(SITUATIONS), "id string, action_type string, p_positive double, advice string, confidence double, is_reversible boolean, attribution_tier string")
    got = {r["id"]: (r["autonomy"], r["cap"]) for r in K.autonomy(df).collect()}
    assert got == {
        "looked into": ("FLAG FOR REVIEW", None), "does not pay": ("MONITOR", None), "in doubt": ("WAIT", None), "unsure": ("MONITOR", None), "for good": ("FLAG FOR REVIEW", None),
        "by last click": ("FLAG FOR REVIEW", None), "sure": ("AUTO-EXECUTE", None), "half sure": ("AUTO-EXECUTE (capped magnitude)", 0.1), "on the edge": ("AUTO-EXECUTE (capped magnitude)", 0.1)}


def test_an_outage_turns_overlapping_signals_into_data_quality(spark):
    schema = "signal_id string, detector string, entity_type string, entity_id string, as_of_date date, fired_date date, severity double, direction string, classification string, attribution_tier string, data_quality_score double, p_value double, evidence string, window_from date, window_to date"
    import datetime as dt

    d = dt.date
    rows = [
        ("1", "data_completeness", "source", "ads", d(2024, 3, 1), d(2024, 1, 16), 0.6, "degrading", "DATA_QUALITY", "A", 1.0, None, "{}", d(2024, 1, 9), d(2024, 1, 23)),
        ("2", "cac_trend", "channel", "x", d(2024, 3, 1), d(2024, 2, 10), 0.9, "degrading", "COMMERCIAL", "A", 1.0, 0.001, "{}", None, None),
        ("3", "cac_trend", "channel", "y", d(2024, 3, 1), d(2024, 2, 29), 0.9, "degrading", "COMMERCIAL", "C", 1.0, 0.5, "{}", None, None),
    ]
    got = {r["signal_id"]: r for r in adjudicate(spark.createDataFrame(rows, schema)).collect()}
    assert got["2"]["classification"] == "DATA_QUALITY" and got["2"]["confidence"] == 0.27 and not got["2"]["is_actionable"]
    assert got["3"]["classification"] == "COMMERCIAL" and not got["3"]["passed_fdr"] and got["1"]["passed_fdr"]


def test_product_detectors_look_at_variants(spark):
    """Every variant under the warning has its signal, also where its brand as a whole has stock."""
    w, t = warehouse(spark, SMALL), S.Thresholds(cover_warning=400.0)
    low = {str(r["variant_id"]) for r in w.mart_variant_daily.join(w.last_day, F.col("date_day") == F.col("last_day")).where("days_of_cover < 400").collect()}
    assert low and {r["entity_id"] for r in S.inventory_cover(w, t).collect()} == low
    assert w.mart_variant_daily.count() == w.dim_date.count() * w.dim_product.count()


def test_windows_of_clicks_end_with_trading_if_asked(spark):
    """57 days of trading, ads up to the last but one: the windows begin and end a day later than those of the ads."""
    import datetime as dt
    from types import SimpleNamespace

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("meta", day(n), 100.0 if n else 9000.0, 10 if n < 28 else 5 if n > 28 else 1000, 1000) for n in range(56)]
    ads = spark.createDataFrame(rows, "platform string, ad_date date, spend double, clicks long, impressions long")
    daily = ads.select(F.col("platform").alias("channel"), F.col("ad_date").alias("date_day"), F.col("spend").alias("ad_spend"), "clicks", "impressions")
    w = SimpleNamespace(fct_ad_spend_daily=ads, mart_daily_trading=daily, last_day=spark.createDataFrame([(day(56),)], "last_day date"), cfg=SimpleNamespace(as_of=day(57)))
    change = lambda traded: json.loads(one(S.cpc_decomposition(w, traded=traded))["evidence"])["change_pct"]
    ends = lambda first, mid: 100 * ((sum(r[2] for r in rows[mid:]) / sum(r[3] for r in rows[mid:])) / (sum(r[2] for r in rows[first:mid]) / sum(r[3] for r in rows[first:mid])) - 1)
    assert abs(change(False) - ends(0, 28)) < 1e-6 and abs(change(True) - ends(1, 29)) < 1e-6


def test_variants_are_runs_of_sales_until_they_are_shown(spark):
    """Runs are as many as sales and their leaving, not days times variants, and what is dense is made of them without an exchange of its own."""
    w = warehouse(spark, SMALL)
    sales, variants, days = w._sold("variant_id").count(), w.dim_product.count(), w.dim_date.count()
    runs = w.variant_runs
    assert runs.count() <= 3 * sales + variants < days * variants / 10
    assert runs.agg(F.sum(F.datediff("until", "since") + 1)).first()[0] == days * variants
    exchanges = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("REPARTITION_BY_COL") + df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(variant_id")
    assert exchanges(w.mart_variant_daily.groupBy("variant_id").count()) == exchanges(runs.groupBy("variant_id").count())
    # By hand for one variant: the sum of a week at each of its days.
    one_of = w._sold("variant_id").groupBy("variant_id").agg(F.max(F.struct("date_day", "units")).alias("m")).orderBy("variant_id").first()
    at = {r["date_day"]: r for r in w.mart_variant_daily.where(F.col("variant_id") == one_of["variant_id"]).collect()}
    units = {d: r["units"] for d, r in at.items()}
    for d, r in list(at.items())[100::97] + [(one_of["m"]["date_day"], at[one_of["m"]["date_day"]])]:
        assert r["velocity_7d"] == sum(u for e, u in units.items() if 0 <= (d - e).days < 7) / 7
