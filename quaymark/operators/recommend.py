"""From signals to recommendations: an action for each detector, sized by simulation, one recommendation for an action and entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import ratio
from ..plans.warehouse import Warehouse
from . import simulate as K

# What each detector's signal suggests, and whether it can be undone.
ACTIONS = (
    ("cac_trend", "REALLOCATE_SPEND", True), ("cpc_decomposition", "REFRESH_CREATIVE", True), ("cac_ltv_breach", "PAUSE_CAMPAIGN", True), ("inventory_cover", "REORDER_INVENTORY", False),
    ("cohort_retention_shift", "INVESTIGATE_DATA", True), ("email_engagement_decay", "ADJUST_FLOW", True), ("data_completeness", "INVESTIGATE_DATA", True),
    ("channel_cvr_shift", "INVESTIGATE_DATA", True), ("product_velocity", "INVESTIGATE_DATA", True), ("aov_decomposition", "INVESTIGATE_DATA", True),
)
# Share of a donor's spend to move, at most, and the lead time of a reorder in days.
SHIFT, MOST, LEAD_DAYS = 0.20, 0.30, 21.0
DONORS = ("meta", "google")
KEYS = ("as_of_date", "signal_id", "detector", "action_type", "entity_id", "magnitude", "magnitude_unit", "confidence", "is_reversible", "attribution_tier")
RESULTS = {"p_positive": "double", "advice": "string", "median": "double", "p10": "double", "p90": "double", "revenue_median": "double"}


def actions(signals: DataFrame, known: tuple[tuple[str, str, bool], ...] = ACTIONS) -> DataFrame:
    """Signals with the action of their detector (ten rows), whether it can be undone and whether they are commercial."""
    table = signals.sparkSession.createDataFrame(list(known), "detector string, action_type string, is_reversible boolean").coalesce(1)
    return signals.join(F.broadcast(table), "detector").withColumn("commercial", F.col("classification") == "COMMERCIAL")


def plain(acted: DataFrame) -> DataFrame:
    """Recommendations without a size. What isn't commercial is only looked into."""
    commercial = F.col("commercial")
    return acted.withColumns({
        "action_type": F.when(commercial, F.col("action_type")).otherwise("INVESTIGATE_DATA"), "is_reversible": F.col("is_reversible") | ~commercial,
        "magnitude": F.lit(0.0), "magnitude_unit": F.lit("n/a")}).select(*KEYS, "commercial", *[F.lit(None).cast(t).alias(c) for c, t in RESULTS.items()])


def cheapest_other(daily: DataFrame) -> DataFrame:
    """donor, receiver: for each channel that may give, the other one at which a new customer costs least; of equals the first by name."""
    costs = daily.where("ad_spend is not null").groupBy("channel").agg(F.sum("ad_spend").alias("spend"), F.sum("new_customers").alias("customers")).where("spend > 0 and customers > 0")
    costs = costs.select(F.col("channel").alias("receiver"), ratio("spend", "customers").alias("cac"))
    donors = daily.sparkSession.createDataFrame([(d,) for d in DONORS], "donor string").coalesce(1)
    return costs.join(F.broadcast(donors), F.col("donor") != F.col("receiver")).groupBy("donor").agg(F.min_by("receiver", F.struct("cac", "receiver")).alias("receiver"))


def with_channels(cases: DataFrame, daily: DataFrame) -> DataFrame:
    """Cases with a `donor`: its receiver and both channels' state. A channel without recent spend gives no case."""
    state = K.channel_state(daily)
    side = lambda name: state.select(F.col("channel").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("spend_per_day", "cac", "beta", "beta_se")])
    return cases.join(F.broadcast(cheapest_other(daily)), "donor").join(F.broadcast(side("donor")), "donor").join(F.broadcast(side("receiver")), "receiver")


def _settle(outcome: DataFrame, directional: bool = True) -> DataFrame:
    s = K.worth_waiting(K.summary(outcome, *KEYS, directional=directional))
    have = set(s.columns)
    return s.withColumns({c: F.lit(None).cast(t) for c, t in RESULTS.items() if c not in have}).withColumn("commercial", F.lit(True))


def spend(w: Warehouse, acted: DataFrame) -> DataFrame:
    """Moves of spend, and a refresh of creative for the part of a dearer click that the click rate explains.

    A move for a dearer click is as large as the auction's share of it. acted has ltv_margin and ltv_revenue.
    """
    e = lambda name: F.get_json_object("evidence", f"$.{name}").cast("double")
    click = F.col("detector") == "cpc_decomposition"
    shift = F.least(SHIFT * F.when(click, F.coalesce(e("auction_share"), F.lit(1.0))).otherwise(1.0), F.lit(MOST))
    cases = with_channels(acted.withColumn("donor", F.when(F.col("entity_id").isin(*DONORS), F.col("entity_id")).otherwise(DONORS[0])), w.mart_daily_trading)
    moves = cases.withColumns({
        "shift": shift, "action_type": F.lit("REALLOCATE_SPEND"), "entity_id": F.concat_ws(" -> ", "donor", "receiver"), "magnitude": F.round(shift, 4), "magnitude_unit": F.lit("share of donor budget")})
    fall = F.abs(e("ctr_change_pct")) / 100
    fresh = cases.where(click & (fall > 0)).withColumns({
        "uplift": fall, "spend_per_day": F.col("donor_spend_per_day"), "cac": F.col("donor_cac"), "action_type": F.lit("REFRESH_CREATIVE"), "entity_id": F.col("donor"),
        "magnitude": fall, "magnitude_unit": F.lit("CTR decline to recover")})
    columns = [*KEYS, "commercial", *RESULTS]
    return _settle(K.reallocation(moves)).select(*columns).unionByName(_settle(K.creative_refresh(fresh)).select(*columns))


def stock(w: Warehouse, acted: DataFrame) -> DataFrame:
    """Reorders of variants: units that nine draws of ten fall short by at most."""
    runs = w.variant_runs.withColumn("entity_id", F.col("variant_id").cast("string")).join(acted.select("entity_id").distinct(), "entity_id", "left_semi")
    variants = w.spread(runs, "variant_id")
    cases = acted.withColumns({"magnitude": F.lit(0.0), "magnitude_unit": F.lit("units short at P90")}).join(K.stock_cases(variants, w.last_day).withColumn("entity_id", F.col("variant_id").cast("string")), "entity_id")
    return _settle(K.reorder(cases, LEAD_DAYS), directional=False).withColumn("magnitude", F.round("short_p90", 1)).select(*KEYS, "commercial", *RESULTS)


def recommend(w: Warehouse, signals: DataFrame) -> DataFrame:
    """Recommendations of all signals, sized and gated. A signal of spend without any cohort's value has no size."""
    acted = actions(signals).crossJoin(F.broadcast(K.cohort_value(w.mart_ltv)))  # one row
    moves = F.col("commercial") & F.col("detector").isin("cac_trend", "cpc_decomposition") & F.coalesce(F.col("ltv_margin") != 0, F.lit(False))
    goods = F.col("commercial") & (F.col("detector") == "inventory_cover")
    out = plain(acted.where(~moves & ~goods)).unionByName(spend(w, acted.where(moves))).unionByName(stock(w, acted.where(goods)))
    return gated(out)


def gated(recommendations: DataFrame) -> DataFrame:
    r = K.autonomy(recommendations).withColumn("autonomy", F.when(F.col("commercial"), F.col("autonomy")).otherwise("MONITOR"))
    capped = F.when((F.col("action_type") == "REALLOCATE_SPEND") & F.col("commercial"), F.least("magnitude", F.coalesce("cap", "magnitude"))).otherwise(F.col("magnitude"))
    return r.withColumn("magnitude", capped).drop("cap", "commercial")


def dedupe(recommendations: DataFrame) -> DataFrame:
    """The most confident recommendation of each cursor, action and entity, with the others in notes."""
    key = ["as_of_date", "action_type", "entity_id"]
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("confidence"), "detector", "signal_id"))
    r = recommendations.withColumn("_place", place)
    also = F.concat(F.lit("also raised by "), F.col("detector"), F.lit(" at confidence "), F.format_number("confidence", 2))
    others = r.where("_place > 1").groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", also.alias("note")))), lambda x: x["note"]).alias("notes"))
    return r.where("_place = 1").drop("_place").join(others, key, "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))
