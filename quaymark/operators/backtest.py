"""Scores of a replay (operators.replay) against events and traps, and the replay of a trend statistic alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import month_start, ratio
from ..plans.warehouse import Warehouse
from ..session import settled
from .stats import mann_kendall, theil_sen


def replay_trend(daily: DataFrame, cursors: DataFrame, keys: list[str], day: str, value: str, days: int = 28) -> DataFrame:
    """cursor, keys, n, slope, z, p of a series' last `days` days before each cursor.

    A day is dealt to the cursors that see it and met by equality, so a replay costs cursors x window, whatever the history; all
    statistics are grouped by cursor as one more key.
    """
    seen_by = F.explode(F.sequence(F.date_add(day, 1), F.date_add(day, days)))
    rows = daily.select(*keys, day, value, seen_by.alias("cursor")).join(cursors, "cursor")
    at = ["cursor", *keys]
    return theil_sen(rows, at, day, value).join(mann_kendall(rows, at, day, value).drop("n"), at)


def matches(signals: DataFrame, events: DataFrame, grace_days: int = 14) -> DataFrame:
    """(event_id, signal_id, cursor) of signals that answer a labelled event: same detector, entity and class, tested, and
    not before the onset less the grace. Null entities of an event match any; `entity_contains` matches part of a name."""
    ours = signals.where("passed_fdr")
    end = F.col("e.until") if "until" in events.columns else F.lit(None).cast("date")
    since = (F.col("s.cursor") >= F.date_sub("e.onset", grace_days)) & (end.isNull() | (F.col("s.cursor") <= end))
    same = (F.col("s.detector") == F.col("e.detector")) & (F.col("s.classification") == F.col("e.must_classify"))
    part = F.col("e.entity_contains").isNull() | F.lower("s.entity_id").contains(F.lower("e.entity_contains"))
    # Events of one entity meet by it, too: what is left over for each event of any entity is its detector's and class's signals.
    of_one, of_any = events.where("entity_id is not null"), events.where("entity_id is null")
    met = [ours.alias("s").join(of_one.alias("e"), same & (F.col("s.entity_id") == F.col("e.entity_id")) & part & since), ours.alias("s").join(of_any.alias("e"), same & part & since)]
    return met[0].select("e.event_id", "s.signal_id", "s.cursor").unionByName(met[1].select("e.event_id", "s.signal_id", "s.cursor"))


EVENT = ("event_id", "detector", "entity_id", "entity_contains", "onset", "until", "must_classify")
TRAP = ("trap_id", "detector", "must_not_classify", "from_day", "to_day", "exclude_labelled", "per_cursor")


def _outages(w: Warehouse) -> DataFrame:
    bad = w.mart_data_quality.where("issue_type <> 'ok'")
    run = F.date_sub("date_day", F.row_number().over(W.partitionBy("source_name").orderBy("date_day")))
    return bad.withColumn("run", run).groupBy("source_name", "run").agg(F.min("date_day").alias("first"), F.max("date_day").alias("last"))


#: Detectors that derived events name.
DERIVED = ("data_completeness", "cpc_decomposition", "aov_decomposition")


def derived_events(w: Warehouse, times: DataFrame, pct: float = 10.0, evidence_days: int = 28) -> DataFrame:
    """What the tables themselves say a replay should find, as EVENT rows: runs of missing or partial days of a source, months in which
    a click's price or the average order moved by `pct` per cent or more against the month before.

    A break may be answered until the window that first holds the whole month has passed. Events from before the replay are left out.
    """
    none = F.lit(None).cast("string")
    outages = _outages(w).select(F.concat_ws(":", F.lit("outage"), "source_name", F.col("first").cast("string")), F.lit("data_completeness"), "source_name", none, "first", F.lit(None).cast("date"), F.lit("DATA_QUALITY"))

    def breaks(daily: DataFrame, kind: str, detector: str, top: str, bottom: str) -> DataFrame:
        """daily(entity, day, top, bottom)"""
        m = daily.groupBy("entity", month_start("day").alias("month")).agg(F.sum(top).alias("a"), F.sum(bottom).alias("b")).withColumn("x", ratio("a", "b"))
        m = m.withColumn("before", F.lag("x").over(W.partitionBy("entity").orderBy("month"))).where(F.abs(100 * (F.col("x") / F.col("before") - 1)) >= pct)
        until = F.date_add(F.last_day("month"), evidence_days)
        return m.select(F.concat_ws(":", F.lit(kind), "entity", F.col("month").cast("string")), F.lit(detector), "entity", none, "month", until, F.lit("COMMERCIAL"))

    ads = w.fct_ad_spend_daily.select(F.col("platform").alias("entity"), F.col("ad_date").alias("day"), "spend", "clicks")
    orders = w.mart_daily_trading.select(F.lit("blended").alias("entity"), F.col("date_day").alias("day"), "net_revenue", "orders")
    found = outages.union(breaks(ads, "price", "cpc_decomposition", "spend", "clicks")).union(breaks(orders, "basket", "aov_decomposition", "net_revenue", "orders"))
    since = times.agg(F.min("cursor").alias("_since"))
    return found.toDF(*EVENT).crossJoin(since).where(F.col("onset") >= F.col("_since")).drop("_since")


def derived_traps(w: Warehouse, times: DataFrame, budget: int = 4) -> DataFrame:
    """What a replay must not say, as TRAP rows: a commercial fall of opens, a commercial trend of cost while a source of ads is out, and
    more than `budget` commercial signals a cursor that answer no event in a January."""
    commercial, none = F.lit("COMMERCIAL"), F.lit(None).cast("date")
    opens = w.last_day.select(F.lit("opens"), F.lit("email_engagement_decay"), commercial, none, none, F.lit(False), F.lit(None).cast("int"))
    gaps = _outages(w).where("source_name <> 'orders'").select(F.concat_ws(":", F.lit("gap"), "source_name", F.col("first").cast("string")), F.lit("cac_trend"), commercial, "first", F.date_add("last", 15), F.lit(False), F.lit(None).cast("int"))
    years = times.where(F.month("cursor") == 1).select(F.trunc("cursor", "YEAR").alias("from")).distinct()
    january = years.select(F.concat_ws(":", F.lit("january"), F.year("from").cast("string")), F.lit(None).cast("string"), commercial, "from", F.last_day("from"), F.lit(True), F.lit(budget))
    return opens.union(gaps).union(january).toDF(*TRAP)


def score_events(signals: DataFrame, events: DataFrame, grace_days: int = 14) -> DataFrame:
    """event_id, detected, first_fire, lead_days, cursors_fired for every event."""
    hits = matches(signals, events, grace_days).groupBy("event_id").agg(F.min("cursor").alias("first_fire"), F.count_distinct("cursor").alias("cursors_fired"))
    return events.join(hits, "event_id", "left").select(
        "event_id", F.col("first_fire").isNotNull().alias("detected"), "first_fire", F.datediff("first_fire", "onset").alias("lead_days"), F.coalesce("cursors_fired", F.lit(0)).alias("cursors_fired"))


def score_traps(signals: DataFrame, events: DataFrame, traps: DataFrame, grace_days: int = 14, answering: DataFrame | None = None) -> DataFrame:
    """trap_id, violations, cursors_violated, clean. A trap forbids a class for a detector (null: any) between two cursors;
    it may leave out signals of labelled events, and allow a number a cursor before any counts. Signals are counted a trap and cursor where they are.
    `answering`: the signals of the events' detectors, where the caller has them apart."""
    s, t = signals.alias("s"), traps.alias("t")
    bad = (
        (F.col("s.classification") == F.col("t.must_not_classify")) & F.col("s.passed_fdr") & (F.col("t.detector").isNull() | (F.col("s.detector") == F.col("t.detector")))
        & (F.col("t.from_day").isNull() | (F.col("s.cursor") >= F.col("t.from_day"))) & (F.col("t.to_day").isNull() | (F.col("s.cursor") <= F.col("t.to_day")))
    )
    labelled = settled(matches(signals if answering is None else answering, events, grace_days).select("signal_id").distinct().withColumn("labelled", F.lit(True)))
    hit = s.join(t, bad).select("t.trap_id", "t.exclude_labelled", "t.per_cursor", "s.signal_id", "s.cursor").join(labelled, "signal_id", "left")
    hit = hit.where(~(F.col("exclude_labelled") & F.coalesce("labelled", F.lit(False)))).groupBy("trap_id", "per_cursor", "cursor").agg(F.count("*").alias("here"))
    hit = hit.where(F.col("per_cursor").isNull() | (F.col("here") > F.col("per_cursor")))
    g = hit.groupBy("trap_id").agg(F.sum("here").alias("violations"), F.count_distinct("cursor").alias("cursors_violated"))
    return traps.select("trap_id").join(g, "trap_id", "left").select("trap_id", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("cursors_violated", F.lit(0)).alias("cursors_violated"), F.col("violations").isNull().alias("clean"))


def summary(signals: DataFrame, events: DataFrame, grace_days: int = 14, answering: DataFrame | None = None) -> DataFrame:
    """recall over events, precision over the ids of commercial signals that passed. `answering` as in `score_traps`."""
    answering = signals if answering is None else answering
    recall = score_events(answering, events, grace_days).agg(F.avg(F.col("detected").cast("double")).alias("recall"))
    good = matches(answering, events, grace_days).agg(F.count_distinct("signal_id").alias("matched"))
    fired = signals.where("classification = 'COMMERCIAL' and passed_fdr").agg(F.count_distinct("signal_id").alias("fired"))
    return recall.crossJoin(good).crossJoin(fired).select("recall", (F.col("matched") / F.nullif(F.col("fired"), F.lit(0))).alias("precision"), "matched", "fired")
