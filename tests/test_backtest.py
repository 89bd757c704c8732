import datetime as dt

from pyspark.sql import functions as F

from conftest import SMALL
from quaymark.operators import backtest as B, recommend as R
from quaymark.queries import warehouse

D = dt.date
SIGNALS = "signal_id string, detector string, entity_id string, classification string, passed_fdr boolean, cursor date"
EVENTS = "event_id string, detector string, entity_id string, entity_contains string, onset date, must_classify string"
TRAPS = "trap_id string, detector string, must_not_classify string, from_day date, to_day date, exclude_labelled boolean, per_cursor int"


def frames(spark):
    s = [("a", "cac_trend", "blended", "COMMERCIAL", True, D(2024, 2, 1)), ("a", "cac_trend", "blended", "COMMERCIAL", True, D(2024, 2, 2)), ("b", "cac_trend", "blended", "COMMERCIAL", True, D(2023, 1, 1)),
         ("c", "velocity", "Vitamin D3 1000", "COMMERCIAL", True, D(2024, 3, 1)), ("d", "velocity", "Zinc", "COMMERCIAL", False, D(2024, 3, 1)), ("e", "email", "Flow 1", "COMMERCIAL", True, D(2024, 3, 1))]
    e = [("cost", "cac_trend", "blended", None, D(2024, 2, 10), "COMMERCIAL"), ("d3", "velocity", None, "d3", D(2024, 2, 20), "COMMERCIAL"), ("gap", "data_completeness", "ads", None, D(2024, 2, 1), "DATA_QUALITY")]
    return spark.createDataFrame(s, SIGNALS), spark.createDataFrame(e, EVENTS)


def test_events_are_scored(spark):
    s, e = frames(spark)
    got = {r["event_id"]: r for r in B.score_events(s, e).collect()}
    assert (got["cost"]["first_fire"], got["cost"]["lead_days"], got["cost"]["cursors_fired"]) == (D(2024, 2, 1), -9, 2)
    assert got["d3"]["detected"] and not got["gap"]["detected"] and got["gap"]["cursors_fired"] == 0
    total = B.summary(s, e).collect()[0]
    assert (round(total["recall"], 4), total["matched"], total["fired"]) == (0.6667, 2, 4)


def test_traps(spark):
    s, e = frames(spark)
    t = spark.createDataFrame([("email", "email", "COMMERCIAL", None, None, False, None), ("any", None, "COMMERCIAL", D(2024, 1, 1), None, True, None), ("budget", None, "COMMERCIAL", None, None, False, 2)], TRAPS)
    got = {r["trap_id"]: (r["violations"], r["clean"]) for r in B.score_traps(s, e, t).collect()}
    assert got == {"email": (1, False), "any": (1, False), "budget": (0, True)}


RAISED = "signal_id string, detector string, entity_id string, classification string, confidence double, as_of_date date, attribution_tier string, evidence string"


def signals(spark):
    day, clicks = D(2024, 1, 1), '{"auction_share": 0.5, "ctr_change_pct": -20.0}'
    return spark.createDataFrame([
        ("1", "cac_trend", "meta", "COMMERCIAL", 0.6, day, "B", "{}"), ("2", "cac_ltv_breach", "meta", "COMMERCIAL", 0.9, day, "B", "{}"), ("3", "cac_trend", "google", "DATA_QUALITY", 0.2, day, "C", "{}"),
        ("4", "inventory_cover", "7", "COMMERCIAL", 0.9, day, "A", "{}"), ("5", "cpc_decomposition", "meta", "COMMERCIAL", 0.9, day, "A", clicks), ("6", "cac_trend", "blended", "COMMERCIAL", 0.5, day, "B", "{}"),
    ], RAISED)


def test_recommendations_by_kind(spark):
    """Spend is moved from the signal's channel (or meta) and sized by the auction's share; what isn't commercial is only looked into."""
    r = {(x["signal_id"], x["action_type"]): x for x in R.recommend(warehouse(spark, SMALL), signals(spark)).collect()}
    assert set(r) == {("1", "REALLOCATE_SPEND"), ("2", "PAUSE_CAMPAIGN"), ("3", "INVESTIGATE_DATA"), ("4", "REORDER_INVENTORY"), ("5", "REALLOCATE_SPEND"), ("5", "REFRESH_CREATIVE"), ("6", "REALLOCATE_SPEND")}
    assert r["1", "REALLOCATE_SPEND"]["entity_id"] == r["6", "REALLOCATE_SPEND"]["entity_id"] == "meta -> google"
    assert r["2", "PAUSE_CAMPAIGN"]["autonomy"] == "AUTO-EXECUTE" and r["3", "INVESTIGATE_DATA"]["autonomy"] == "MONITOR"
    assert r["4", "REORDER_INVENTORY"]["autonomy"] == "FLAG FOR REVIEW" and r["4", "REORDER_INVENTORY"]["p_positive"] is None and not r["4", "REORDER_INVENTORY"]["is_reversible"]
    assert r["5", "REFRESH_CREATIVE"]["magnitude"] == 0.2 and r["5", "REALLOCATE_SPEND"]["magnitude"] == 0.1
    assert r["1", "REALLOCATE_SPEND"]["magnitude"] == (0.1 if "capped" in r["1", "REALLOCATE_SPEND"]["autonomy"] else 0.2)


def test_one_recommendation_for_an_action_and_entity(spark):
    got = {(r["action_type"], r["entity_id"]): r for r in R.dedupe(R.plain(R.actions(signals(spark).where("detector like 'cac%'")))).collect()}
    assert got["REALLOCATE_SPEND", "meta"]["signal_id"] == "1" and got["REALLOCATE_SPEND", "blended"]["notes"] == []
    twice = signals(spark).where("signal_id in ('1', '2')").withColumn("detector", F.lit("cac_trend"))
    kept = R.dedupe(R.plain(R.actions(twice))).collect()
    assert [(k["signal_id"], k["notes"]) for k in kept] == [("2", ["also raised by cac_trend at confidence 0.60"])]
    assert ("INVESTIGATE_DATA", "google") in got


def test_the_cheapest_other_channel(spark):
    c = spark.createDataFrame([("meta", 90, 10), ("google", 70, 10), ("tiktok", None, 5), ("free", 0, 5), ("also", 70, 10)], "channel string, ad_spend int, new_customers int")
    assert {r["donor"]: r["receiver"] for r in R.cheapest_other(c).collect()} == {"meta": "also", "google": "also"}
