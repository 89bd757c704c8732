"""Settings, expectations, digests, footers, pushed filters and measures to date against plain versions."""

import datetime as dt
from collections import defaultdict
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from quaymark.config import EngineConfig, load_settings
from quaymark.operators import measures as M
from quaymark.operators.recommend import ACTIONS
from quaymark.queries import warehouse
from quaymark.sources import files
from quaymark.sources.expectations import Rule, compiled

D = dt.date


def settings(tmp_path, text):
    (tmp_path / "s.toml").write_text(text)
    return load_settings(tmp_path / "s.toml")


def test_settings(tmp_path):
    s = settings(tmp_path, """
        [engine]
        as_of = 2001-05-01
        vat_rate = 0
        horizons = [30, 60]
        [fdr]
        alpha = 0.2
        [trend]
        window_days = 14
        [detectors.cac_trend]
        enabled = false
        min_pct_per_day = 1
        [detectors.inventory_cover]
        warning_days = 40.0
        [actions.cac_trend]
        type = "PAUSE_CAMPAIGN"
        """)
    assert s.engine == EngineConfig(as_of=D(2001, 5, 1), vat_rate=0.0, horizons=(30, 60), fdr_alpha=0.2)
    assert (s.thresholds.evidence_days, s.thresholds.disabled, s.thresholds.cac_pct_per_day, s.thresholds.cover_warning) == (14, ("cac_trend",), 1.0, 40.0)
    assert dict((d, (a, r)) for d, a, r in s.actions)["cac_trend"] == ("PAUSE_CAMPAIGN", True) and len(s.actions) == len(ACTIONS)
    assert settings(tmp_path, "").engine == EngineConfig()


@pytest.mark.parametrize("text", [
    "[engine]\nasof = 2001-05-01", "[fdr]\nbeta = 1", "[detectors.cac_trendy]\nenabled = true", "[detectors.cac_trend]\nmax_p = 0.1", "[other]\nx = 1", '[engine]\nvat_rate = "20"', "[trend]\nwindow_days = 1.5",
    "[detectors.cac_trend]\nmax_p_value = 0.1\n[detectors.aov_decomposition]\nmax_p_value = 0.2", "[actions.nothing]\ntype = 'X'", "[actions.cac_trend]\nkind = 'X'"])
def test_unknown_settings_are_errors(tmp_path, text):
    with pytest.raises(ValueError):
        settings(tmp_path, text)


def test_expectations_find_what_is_broken(spark):
    m = spark.createDataFrame([(1, "a", 5, 1), (1, None, 50, 9), (2, "z", None, None), (None, "a", -1, 1)], "k int, s string, n int, r int")
    other = spark.createDataFrame([(1,), (None,)], "id int")
    rules = (Rule("m", "unique", ("k",)), Rule("m", "unique", ("k", "s")), Rule("m", "not_null", ("s",)), Rule("m", "accepted", ("s",), ("a",)), Rule("m", "range", ("n",), (0, 10)), Rule("m", "range", ("n",), (0, None)), Rule("m", "range", ("n",), (None, 10)), Rule("m", "reference", ("r",), ("other", "id")))
    parts = compiled(SimpleNamespace(m=m, other=other), rules)
    got = [(r["rule"], r["violations"]) for p in parts for r in p.collect()]
    assert len(parts) == 4 and sorted(got) == sorted([("unique: k", 1), ("unique: k, s", 0), ("not_null: s", 1), ("accepted: s", 1), ("range: n", 2), ("range: n", 1), ("range: n", 1), ("reference: r", 1)])


def test_rules_on_days_are_looked_up_in_runs(spark):
    """A day that stands in several runs of a product is a key found twice, however many hold it; no day is made for that, nor for a reference."""
    rows = [(1, D(2001, 1, 1), D(2001, 1, 10)), (1, D(2001, 1, 8), D(2001, 1, 12)), (1, D(2001, 1, 9), D(2001, 1, 9)), (2, D(2001, 1, 1), D(2001, 1, 3)), (2, D(2001, 1, 4), D(2001, 1, 9)), (2, D(2001, 1, 4), D(2001, 1, 5)), (None, D(2001, 1, 2), D(2001, 1, 2)), (None, D(2001, 1, 2), D(2001, 1, 3))]
    runs = spark.createDataFrame(rows, "variant_id long, since date, until date")
    days = runs.select("variant_id", F.explode(F.sequence("since", "until")).alias("date_day"))
    rules = (Rule("mart_variant_daily", "unique", ("date_day", "variant_id")), Rule("mart_variant_daily", "reference", ("variant_id",), ("dim_product", "variant_id")))
    known = spark.createDataFrame([(2,)], "variant_id long")
    by_runs, by_days = (compiled(SimpleNamespace(mart_variant_daily=days, dim_product=known, **more), rules) for more in ({"variant_runs": runs}, {}))
    assert [[tuple(r) for r in p.collect()] for p in by_runs] == [[tuple(r) for r in p.collect()] for p in by_days] and by_runs[0].first()["violations"] == 6
    assert not any("sequence(" in plan(p) for p in by_runs)


def test_a_digest_is_of_the_content(spark, duck):
    rows = [(1, "a", 1.25, D(2001, 1, 1), True), (2, None, None, None, None), (2, None, None, None, None), (3, "ü|", -0.00005, D(2001, 1, 2), False)]
    schema = "i long, s string, x double, d date, b boolean"
    one = files.digest(spark.createDataFrame(rows, schema).coalesce(1)).first()
    many = files.digest(spark.createDataFrame(rows[::-1], schema).repartition(4)).first()
    assert one == many and one["rows"] == 4
    assert files.digest(spark.createDataFrame(rows[:3], schema)).first()["digest"] != one["digest"] != files.digest(spark.createDataFrame([*rows[:3], (3, "ü", -0.00005, D(2001, 1, 2), False)], schema)).first()["digest"]
    values = ", ".join("({}, {}, {}, {}, {})".format(*("null" if v is None else f"date '{v}'" if isinstance(v, D) else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r)) for r in rows)
    sql = files.digest_sql(f"(select * from (values {values}) as v(i, s, x, d, b))", {"i": False, "s": False, "x": True, "d": False, "b": False})
    assert duck.execute(sql).fetchone() == tuple(one)


def test_an_export_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "i int, s string")
    got = files.export(df, str(tmp_path), "m").first()
    assert (got["model"], got["rows"], got["digest"]) == ("m", 2, files.digest(df).first()["digest"])
    with pytest.raises(ValueError, match="empty"):
        files.export(df.limit(0), str(tmp_path), "none")


def test_halves_of_a_digest_go_away_from_zero(spark):
    """A value is rounded without a decimal for each, to the same whole number."""
    xs = [0.5, 1.5, 2.5, -0.5, -2.5, 0.49999999999999994, 1e15 + 0.5, -3.2, 0.0, -0.0, 2.0**52 + 1, 7.5e-9, None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", files._whole(F.col("x")).alias("n"), F.round("x", 0).cast("long").alias("want"))
    assert "round(" not in plan(got.select("n")).split("== Physical Plan ==")[1] and all(r["n"] == r["want"] for r in got.collect())


def test_days_in_order_are_the_mart_sorted(spark, tmp_path):
    """Stretches of days are sorted where they are made: files follow one another in the order of day and variant, and no row's day is exchanged."""
    w = warehouse(spark, SMALL)
    w.persist("variant_runs")
    w.variant_days_in_order(9000).write.parquet(str(tmp_path / "m"))
    parts = sorted((tmp_path / "m").glob("part-*.parquet"))
    rows = [tuple(r) for p in parts for r in spark.read.parquet(str(p)).coalesce(1).collect()]
    want = [tuple(r) for r in w.variant_days.orderBy("date_day", "variant_id").collect()]
    assert len(parts) > 5 and rows == want and len(rows) == w.mart_variant_daily.count()
    assert "rangepartitioning" not in plan(w.variant_days_in_order(9000)).split("== Physical Plan ==")[1]


def test_money_of_days_is_cast_on_their_runs(spark):
    """The query on the dense mart casts decimals once a run: above the days that are made of it there is none."""
    from quaymark.queries import MODELS, QUERIES, shaped

    w = warehouse(spark, SMALL)
    made = QUERIES["h22_mart_variant_daily"](spark, SMALL)
    above = lambda df: plan(df).split("== Physical Plan ==")[1].split("Generate explode(sequence")[0]
    assert "cast(net_revenue" not in above(made) and "cast(net_revenue" in above(shaped(w.mart_variant_daily, MODELS["h22_mart_variant_daily"][1]))
    money = [F.sum(c).cast("double").alias(c) for c in ("net_revenue", "contribution_margin")]
    a, b = (x.agg(F.count("*"), *money).first() for x in (made, w.mart_variant_daily))
    assert a[0] == b[0] and all(abs(a[i] - b[i]) < 0.01 for i in (1, 2))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_counts_come_from_footers(spark):
    t = files.footer_counts(spark, {"orders": f"{SMALL}/orders.parquet"})
    assert "PushedAggregation: [COUNT(*)]" in plan(t) and t.first()["rows"] == 1500
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


def test_the_cursor_reaches_the_scan(spark):
    p = plan(warehouse(spark, SMALL, EngineConfig(as_of=D(1998, 1, 1))).stg_orders)
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate,1998-01-02" in p


def test_lines_meet_orders_once(spark):
    executed = plan(warehouse(spark, SMALL).fct_order_line).split("== Physical Plan ==")[1]
    assert executed.count("FileScan parquet [o_") == 1 and executed.count("FileScan parquet [l_") == 1


def test_views_to_date(spark):
    rows = [(D(2001, 1, 30), "a", 10, 2, "x", True), (D(2001, 1, 31), "a", 5, 1, "y", True), (D(2001, 1, 31), "a", 7, 0, "x", False), (D(2001, 2, 1), "a", 1, 4, "x", True), (D(2001, 2, 1), "b", 8, None, None, True), (D(2001, 4, 2), "a", 3, 3, "z", True), (D(2002, 1, 1), "a", 9, 1, "y", True)]
    mart = spark.createDataFrame(rows, "date_day date, channel string, v int, n int, who string, ok boolean")
    states = {"v": M.State(F.col("v")), "r": M.State(F.when(F.col("ok"), F.col("v")), F.when(F.col("ok"), F.col("n")), 10.0), "people": M.State(key=F.col("who"))}
    period = {"current": lambda d: d, "mtd": lambda d: (d.year, d.month), "qtd": lambda d: (d.year, (d.month - 1) // 3), "ytd": lambda d: d.year}
    want = {}
    for view, of in period.items():
        for day, ch in {(r[0], r[1]) for r in rows}:
            held = [r for r in rows if r[1] == ch and of(r[0]) == of(day) and r[0] <= day]
            top, bottom = sum(r[2] for r in held if r[5]), sum(r[3] or 0 for r in held if r[5])
            want[day, ch, view] = (sum(r[2] for r in held), 10.0 * top / bottom if bottom else None, len({r[4] for r in held if r[4]}))
    got = {(r["date_day"], r["channel"], r["view"]): (r["v"], r["r"], r["people"]) for r in M.to_date_views(mart, states, "channel").collect()}
    assert got == want


def test_states_say_what_measures_say(spark):
    daily = warehouse(spark, SMALL).mart_daily_trading.where("date_day >= date '2001-07-01' and date_day <= date '2001-07-31'").cache()
    whole = M.measured(daily, M.trading(), "channel")
    to_date = M.to_date_views(daily, M.trading_states(), "channel").where("view = 'mtd' and date_day = date '2001-07-31'")
    a, b = ({r["channel"]: r.asDict() for r in x.collect()} for x in (whole, to_date))
    near = defaultdict(int)
    for ch, row in a.items():
        for name in M.trading_states():
            x, y = row[name], b[ch][name]
            assert (x is None) == (y is None) and (x is None or abs(float(x) - float(y)) < 1e-9 * max(1, abs(float(x)))), (ch, name)
            near[name] += x is not None
    assert near["blended_cac"] and near["complete_spend_days"]
