"""The replay says at each cursor what the detectors say of the marts as that cursor sees them; its parts against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from quaymark.operators import backtest as B, pit, replay as R, signals as S, stats as I
from quaymark.plans.warehouse import Warehouse
from quaymark.replays import long_warehouse
from quaymark.sources.binding import LongTables

D = dt.date
SAID = ["signal_id", "detector", "entity_type", "fired_date", "direction", "classification", "passed_fdr", "confidence", "is_actionable"]


@pytest.fixture(scope="module")
def long(spark):
    w = long_warehouse(spark, SMALL)
    w.persist(*R.SHARED)
    return w


def test_replay_is_detection_at_each_cursor(spark, long):
    t = S.Thresholds(cover_warning=400.0, cohort_size=5, cohort_decline_pct=1.0, velocity_z=2.0, aov_pct=2.0, cpc_pct=1.0, cvr_clicks=500, cvr_pct=1.0, breach_days=2, breach_customers=1, breach_ratio=0.001, max_p=0.5, cac_pct_per_day=0.001, open_decline_pct=1.0)
    replayed = R.replay(long, step=83, t=t).cache()
    by = replayed.groupBy("as_of_date").agg(F.collect_set("detector").alias("d")).collect()
    # The first and the last cursor, and two more at which most detectors have something to say.
    cursors = sorted(r["as_of_date"] for r in by)
    busiest = max(by, key=lambda r: len(r["d"]))
    other = max(by, key=lambda r: len(set(r["d"]) | set(busiest["d"])))
    sampled = {cursors[0], cursors[-1], busiest["as_of_date"], other["as_of_date"], cursors[len(cursors) // 2]}
    seen = set()
    for cursor in sampled:
        at = {tuple(r) for r in S.detect(pit.AsOfWarehouse(long, cursor), t).select(SAID).collect()}
        assert at == {tuple(r) for r in replayed.where(F.col("as_of_date") == F.lit(cursor)).select(SAID).collect()} and at
        seen |= {x[1] for x in at}
    assert seen >= {"data_completeness", "product_velocity", "aov_decomposition", "cohort_retention_shift", "email_engagement_decay"} and len(seen) >= 6


def test_signals_of_variants_are_kept_nowhere(spark, long):
    """They are judged as they are made: runs are exchanged once by variant, no day and no signal is, and a reader of other detectors doesn't make them."""
    replayed = R.replay(long, step=400)
    physical = lambda df: df._jdf.queryExecution().executedPlan().toString()
    velocity = physical(replayed.where("detector = 'product_velocity'"))
    assert "MapInPandas" in velocity and "hashpartitioning(date_day" not in velocity and "Generate explode" in velocity.split("Exchange hashpartitioning(variant_id")[0]
    assert "MapInPandas" not in physical(replayed.where(F.col("detector").isin(*B.DERIVED)))


def test_both_ways_of_velocity_say_the_same(spark, long):
    """All variants with their lists of days, or the sparse ones by running sums."""
    t = S.Thresholds(velocity_units=1, velocity_z=2.0)
    times = pit.clock(long, step=29)
    a, b = ({(r["as_of_date"], r["entity_id"], r["direction"], round(r["severity"], 9)) for r in R.product_velocity(long, times, t, sorted_all=x).collect()} for x in (False, True))
    assert a == b and a


def test_a_disabled_detector_says_nothing(spark, long):
    t = S.Thresholds(disabled=("data_completeness", "product_velocity"))
    got = {r[0] for r in R.replay(long, step=400, t=t, only=("data_completeness", "product_velocity", "cpc_decomposition")).select("detector").distinct().collect()}
    assert got <= {"cpc_decomposition"}


def test_clock(spark, long):
    days = [r for r in pit.clock(long, 120, 1).orderBy("cursor").collect()]
    first, last = long.dim_date.agg(F.min("date_day"), F.max("date_day")).first()
    assert days[0]["cursor"] == first + dt.timedelta(days=120) and days[-1]["cursor"] == last + dt.timedelta(days=1) == pit.latest_cursor(long.last_day).first()[0]
    assert days[-1]["window_end"] == last and days[-1]["is_latest"] and days[-2]["is_latest"] and not days[-3]["is_latest"]
    assert len(days) == (last - first).days + 2 - 120 and pit.clock(long, 5000).count() == 0


def test_lagged_sources_equal_a_rebuild(spark, long):
    lags = pit.lag_table(spark)
    for cursor in (D(2000, 11, 15), D(2001, 3, 18), D(2001, 8, 1)):
        limits = pit.cutoffs(spark.createDataFrame([(cursor, cursor)], "cursor date, window_end date"), lags)
        rebuilt = Warehouse(LongTables(spark, SMALL), type(long.cfg)(as_of=cursor))
        for mart, day, source in (("fct_ad_spend_daily", "ad_date", "ads"), ("mart_email_flow_weekly", "week_start", "email")):
            fast = pit.seen_at(getattr(long, mart), day, limits, source).drop("cursor")
            a, b = ({tuple(r) for r in x.select(fast.columns).collect()} for x in (fast, getattr(rebuilt, mart)))
            assert a == b and a


def test_a_lag_changes_with_time(spark):
    lags = spark.createDataFrame([("ads", D(1900, 1, 1), 1), ("ads", D(2001, 2, 1), 3)], "source string, valid_from date, lag_days int")
    times = spark.createDataFrame([(D(2001, 1, 31), D(2001, 1, 31)), (D(2001, 2, 1), D(2001, 2, 1)), (D(2001, 3, 1), D(2001, 2, 10))], "cursor date, window_end date")
    got = {r["cursor"]: r["cutoff"] for r in pit.cutoffs(times, lags).collect()}
    assert got == {D(2001, 1, 31): D(2001, 1, 30), D(2001, 2, 1): D(2001, 1, 29), D(2001, 3, 1): D(2001, 2, 10)}


def test_equivalence_counts_what_differs(spark):
    schema = "k int, s string, x double, d decimal(12,2)"
    a = spark.createDataFrame([(1, "a", 1.0, None), (2, "b", None, None), (None, "c", 3.0, None), (4, "d", 1.0, None)], schema)
    b = spark.createDataFrame([(1, "a", 1.004, None), (2, "x", 2.0, None), (None, "c", 3.1, None), (5, "d", 1.0, None)], schema)
    got = {r["column"]: tuple(r)[1:] for r in pit.equivalence(a, b, ["k"], ["s", "x", "d"]).collect()}
    assert got == {"s": (5, 1, 1, 0, 1), "x": (5, 1, 1, 1, 1), "d": (5, 1, 1, 0, 0)}


def test_proof_of_small_marts(spark, long):
    marts = {m: pit.PROVEN[m] for m in ("mart_daily_trading", "mart_ltv", "mart_data_quality", "mart_cohort_retention")}
    rows = pit.proof(long, pit.order_days(long, (130,)), marts).collect()
    assert len(rows) == sum(len(v) for _, v, _ in marts.values()) and all(r["rows"] > 0 and not any((r["only_left"], r["only_right"], r["null_mismatches"], r["differences"])) for r in rows)


def test_days_are_compared_by_their_runs(spark, long):
    """Runs that both sides hold are counted; a product with any other run is compared day by day: the same counts as of all days, with less made."""
    runs = long.variant_runs
    keys, values = pit.PROVEN["mart_variant_daily"][:2]
    off = runs.withColumns({
        "units": F.when((F.col("variant_id") == 3) & F.col("units").isNotNull(), F.col("units") + 1).otherwise(F.col("units")), "units_7d": F.when(F.col("variant_id") == 5, F.col("units_7d") + 70).otherwise(F.col("units_7d")),
        "inventory_quantity": F.when(F.col("variant_id") == 7, F.lit(None)).otherwise(F.col("inventory_quantity"))}).where("variant_id <> 9 and not (variant_id = 11 and since > date'1998-01-01')")
    twice = off.unionByName(runs.where("variant_id = 13"))
    days = lambda r: Warehouse.spread(r, "variant_id", "product_title", "sku", "product_type")
    for right in (runs, twice):
        got = {tuple(r) for r in pit.equivalence_of_runs(runs, right, "variant_id", values).collect()}
        assert got == {tuple(r) for r in pit.equivalence(days(runs), days(right), keys, values).collect()} and len(got) == len(values)
    assert any(r[2] and r[5] for r in got) and any(r[4] for r in got)


def kept_by_hand(ps, alpha):
    tested = sorted(p for p in ps if p is not None and p == p)
    passed = [p for r, p in enumerate(tested, 1) if p <= alpha * r / len(tested)]
    cut = passed[-1] if passed else -1
    return [p is not None and p == p and p <= cut for p in ps]


def test_false_discoveries_by_chunks(spark):
    rng = random.Random(6)
    rows = []
    for g in range(12):
        for _ in range(rng.randrange(1, 60)):
            rows.append((g, rng.choice([None, float("nan"), 0.0, 1.0, 1e-12, 0.02, 0.02, rng.random() ** 4, rng.random() / 50])))
    want = sorted((g, repr(p), k) for g in {g for g, _ in rows} for (_, p), k in zip([r for r in rows if r[0] == g], kept_by_hand([p for h, p in rows if h == g], 0.1)))
    got = I.benjamini_hochberg(spark.createDataFrame(rows, "g int, p double"), "p", 0.1, ["g"]).collect()
    assert sorted((r["g"], repr(r["p"]), r["kept"]) for r in got) == want


SCHEMA = "signal_id string, detector string, entity_type string, entity_id string, as_of_date date, fired_date date, severity double, direction string, classification string, attribution_tier string, data_quality_score double, p_value double, evidence string, window_from date, window_to date"


def test_suppression_by_buckets(spark):
    rng = random.Random(9)
    day = lambda n: D(2000, 1, 1) + dt.timedelta(days=n)
    rows = []
    for i in range(300):
        at, fired = day(rng.randrange(6)), day(rng.randrange(400))
        if i % 5 == 0:
            a = rng.randrange(400)
            rows.append((f"s{i}", "data_completeness", "source", f"src{i % 3}", at, fired, 1.0, "degrading", "DATA_QUALITY", "A", 1.0, None, "{}", day(a), day(a + rng.randrange(80))))
        else:
            rows.append((f"s{i}", "x", "account", "all", at, fired, 0.5, "degrading", "COMMERCIAL", "B", 1.0, None, "{}", None, None))
    outages = [(r[4], r[13], r[14], r[3]) for r in rows if r[1] == "data_completeness"]
    want = {r[0]: sorted({s for at, a, b, s in outages if at == r[4] and r[5] - dt.timedelta(days=28) <= b and r[5] >= a}) for r in rows if r[1] == "x"}
    got = {r["signal_id"]: r for r in S.suppress_over_outages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 300 and all((got[k]["suppressed_by"] or []) == v and (got[k]["classification"] == "DATA_QUALITY") == bool(v) and got[k]["data_quality_score"] == (0.3 if v else 1.0) for k, v in want.items())
    assert any(want.values()) and not all(want.values())


def test_events_and_traps_come_from_the_tables(spark, long):
    times = pit.clock(long)
    events = {r["event_id"]: r for r in B.derived_events(long, times).collect()}
    assert "price:meta:1999-04-01" in events and "price:google:2000-10-01" in events and "outage:meta_ads_daily:2001-03-15" in events
    assert events["price:meta:1999-04-01"]["until"] == D(1999, 5, 28) and all(e["onset"] >= D(1995, 5, 1) for e in events.values())
    traps = {r["trap_id"]: r for r in B.derived_traps(long, times).collect()}
    assert traps["january:1997"]["per_cursor"] == 4 and traps["gap:meta_ads_daily:2001-03-15"]["to_day"] == D(2001, 3, 31) and traps["opens"]["from_day"] is None


def test_an_event_is_not_answered_after_its_end(spark):
    s = spark.createDataFrame([("a", "d", "e", "COMMERCIAL", True, D(2024, 2, 1)), ("b", "d", "e", "COMMERCIAL", True, D(2024, 4, 1))], "signal_id string, detector string, entity_id string, classification string, passed_fdr boolean, cursor date")
    e = spark.createDataFrame([("x", "d", "e", None, D(2024, 1, 20), D(2024, 3, 1), "COMMERCIAL")], "event_id string, detector string, entity_id string, entity_contains string, onset date, until date, must_classify string")
    assert [r["signal_id"] for r in B.matches(s, e).collect()] == ["a"]


def test_what_is_settled_is_kept_by_columns(spark):
    """A mart that several read is a compressed table, from which each reads its columns; rows, types and nulls are the same."""
    from quaymark.session import settled

    df = spark.sql("select cast(1.5 as decimal(12,2)) as d, timestamp_ntz'2001-01-01 10:00:00' as t, cast(null as array<string>) as a union all select null, null, array('x')")
    kept = settled(df)
    assert kept.schema == df.schema and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert all(f.endswith(".parquet") for f in kept.inputFiles()) and kept.inputFiles()
