"""Advertising in the two platforms' own shapes, and their union: one grain, what a platform doesn't report as a typed null."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import micros_to_money, ratio
from .binding import CAMPAIGNS, DriverTables

# Columns of the two exports. Google's cost is in micros and split by device.
META = "date string, campaign_id bigint, campaign_name string, account_name string, impressions bigint, clicks bigint, spend decimal(12,2), reach bigint, frequency double, _synced string"
GOOGLE = "date string, campaign_id bigint, campaign_name string, account_descriptive_name string, device string, impressions bigint, clicks bigint, cost_micros bigint, conversions double, conversions_value decimal(12,2), _synced string"


def _named(events: DataFrame) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(c) for c in CAMPAIGNS]), F.col("campaign_id").cast("int") + 1)
    return events.withColumn("campaign_name", name)


def _count(kind: str):
    return F.count_if(F.col("event_type") == kind)


def meta_raw(tables: DriverTables) -> DataFrame:
    """Meta's export from the events of its users: reach is the people who saw a campaign on a day. No conversions."""
    e = tables._events().where(F.col("user_id") % 2 == 0).withColumn("campaign_id", (F.col("user_id") / 2 % 3).cast("bigint"))
    g = _named(e).groupBy(F.col("day").cast("string").alias("date"), "campaign_id", "campaign_name").agg(
        _count("view").alias("impressions"), _count("click").alias("clicks"), F.coalesce(F.sum(F.when(F.col("event_type") == "click", F.col("value"))), F.lit(0)).cast("decimal(12,2)").alias("spend"),
        F.count_distinct(F.when(F.col("event_type") == "view", F.col("user_id"))).alias("reach"))
    g = g.withColumns({"account_name": F.lit("Meta account"), "frequency": ratio("impressions", "reach"), "_synced": F.date_add(F.col("date").cast("date"), 1).cast("string")})
    return _as(g, META)


def google_raw(tables: DriverTables) -> DataFrame:
    """Google's export: a row a day, campaign and device, cost in micros, conversions and their value."""
    e = tables._events().where(F.col("user_id") % 2 == 1).withColumns({"campaign_id": (F.floor(F.col("user_id") / 2) % 3 + 3).cast("bigint"), "device": F.when(F.col("user_id") % 3 == 0, "mobile").otherwise("desktop")})
    bought = F.col("event_type") == "purchase"
    g = _named(e).groupBy(F.col("day").cast("string").alias("date"), "campaign_id", "campaign_name", "device").agg(
        _count("view").alias("impressions"), _count("click").alias("clicks"), F.coalesce(F.sum(F.when(F.col("event_type") == "click", (F.col("value") * 1000000).cast("bigint") + 300)), F.lit(0)).cast("bigint").alias("cost_micros"),
        _count("purchase").cast("double").alias("conversions"), F.coalesce(F.sum(F.when(bought, F.col("value"))), F.lit(0)).cast("decimal(12,2)").alias("conversions_value"))
    g = g.withColumns({"account_descriptive_name": F.lit("Google account"), "_synced": F.date_add(F.col("date").cast("date"), 1).cast("string")})
    return _as(g, GOOGLE)


def _as(df: DataFrame, schema: str) -> DataFrame:
    fields = [f.strip().rpartition(" ")[::2] if "(" not in f else f.strip().split(" ", 1) for f in schema.replace("(12,2)", "(12;2)").split(",")]
    return df.select(*[F.col(n.strip()).cast(t.replace(";", ",")).alias(n.strip()) for n, t in fields])


def ads_union(meta: DataFrame, google: DataFrame, as_of) -> DataFrame:
    """Both exports at one grain (platform, campaign, day), as synced by the cursor. Absent metrics are typed nulls, not zeros; a platform's finer
    rows are summed, its frequencies averaged."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    seen = F.coalesce(F.col("_synced").try_cast("date"), F.col("date").cast("date")) <= F.lit(as_of)
    common = ("campaign_id", "campaign_name")
    m = meta.where(seen).select(
        F.lit("meta").alias("platform"), *common, "account_name", F.col("date").cast("date").alias("ad_date"), "impressions", "clicks", "spend", "reach", "frequency",
        null("double", "platform_conversions"), null("decimal(12,2)", "platform_conversion_value"), F.col("_synced").try_cast("date").alias("synced_on"))
    g = google.where(seen).select(
        F.lit("google").alias("platform"), *common, F.col("account_descriptive_name").alias("account_name"), F.col("date").cast("date").alias("ad_date"), "impressions", "clicks", micros_to_money("cost_micros").alias("spend"),
        null("bigint", "reach"), null("double", "frequency"), F.col("conversions").alias("platform_conversions"), F.col("conversions_value").alias("platform_conversion_value"), F.col("_synced").try_cast("date").alias("synced_on"))
    sums = ("impressions", "clicks", "spend", "reach", "platform_conversions", "platform_conversion_value")
    return m.unionByName(g).groupBy("platform", "campaign_id", "ad_date").agg(
        F.max("campaign_name").alias("campaign_name"), F.max("account_name").alias("account_name"), *[F.sum(c).alias(c) for c in sums], F.avg("frequency").alias("frequency"), F.max("synced_on").alias("synced_on"))
