"""The raw inputs, bound to the tables at hand.

Orders, lines, customers and products come from the order tables. Ad days and email weeks come from `events`, moved so that
their thirty days are the last before the orders end. Finance inputs are a few literal rows. Nothing is random.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import decimal

EVENT_ORIGIN, AD_ORIGIN = dt.date(2024, 1, 1), dt.date(2001, 7, 2)
#: From this day on an order whose key is a multiple of three is placed with its customer's second account, so that there are new customers while ads run.
SECOND_ACCOUNTS = dt.date(2001, 1, 1)
#: Days without any rows of meta, and a day without one of its campaigns.
META_GAP, META_PARTIAL = (dt.date(2001, 7, 16), dt.date(2001, 7, 17)), dt.date(2001, 7, 21)
CAMPAIGNS = ("Prospecting - broad", "Retargeting - 30d", "DPA - catalogue", "Brand - exact", "Non-brand - generic", "PMax - all")
REFERRERS = {"1": "https://m.facebook.com/", "2": "https://www.google.com/", "3": "https://youtube.com/", "4": "https://www.tiktok.com/", "5": "direct"}
BUDGETS = (
    ("2001-06-01", "meta", "original", 4000.00, "linear", "2001-05-20"), ("2001-06-01", "google", "original", 3500.00, "front_loaded", "2001-05-20"),
    ("2001-06-01", "tiktok", "original", 900.00, "linear", "2001-05-20"), ("2001-07-01", "meta", "original", 4200.55, "linear", "2001-06-20"),
    ("2001-07-01", "meta", "revised", 5100.10, "front_loaded", "2001-07-12"), ("2001-07-01", "google", "original", 3700.01, "front_loaded", "2001-06-20"),
    ("2001-07-01", "tiktok", "original", 950.00, "linear", "2001-06-20"), ("2001-08-01", "google", "original", 3900.00, "linear", "2001-07-25"),
    ("2001-08-01", "meta", "original", 5200.00, "linear", "2001-08-10"),
)
INVOICES = (
    (1, "V1", "Meta", "meta", "2001-07-01", "2001-07-31", "2001-08-01", "2001-08-01", 2410.37),
    (2, "V2", "Google", "google", "2001-07-01", "2001-07-15", "2001-07-20", "2001-07-22", 1100.11),
    (3, "V3", "Agency", "agency", "2001-07-01", "2001-07-31", "2001-07-31", "2001-08-01", 333.33),
    (4, "V4", "Creator", "creator", "2001-07-01", "2001-07-31", "2001-07-28", "2001-07-30", 120.00),
    (5, "V5", "Google", "google", "2001-07-16", "2001-07-31", "2001-08-03", "2001-08-05", 1200.00),
    (6, "V6", "Meta", "meta", "2001-06-01", "2001-06-30", "2001-07-02", "2001-07-04", 990.01),
    (7, "V7", "Agency", "agency", "2001-06-01", "2001-06-30", "2001-06-30", "2001-07-02", 100.01),
)
ALLOCATIONS = ((1, "meta", 1.0), (2, "google", 1.0), (3, "meta", 0.6), (3, "google", 0.4), (6, "meta", 1.0), (7, "google", 0.3333), (7, "meta", 0.3333), (7, "tiktok", 0.3334))

#: LongTables: platform, campaign, price of a click in cents before its steps, by the cell (order key mod 4) whose orders make its clicks.
LONG_CELLS = (("meta", 0, 260000), ("google", 3, 220000), ("meta", 1, 260000), ("google", 5, 220000))
#: Days without any rows of a platform, and (platform, campaign, day) that is missing alone.
LONG_GAPS = (("google", dt.date(1998, 6, 10)), ("google", dt.date(1998, 6, 11)), ("google", dt.date(1998, 6, 12)), ("meta", dt.date(2001, 3, 15)), ("meta", dt.date(2001, 3, 16)))
LONG_PARTIAL = ("meta", 1, dt.date(2000, 5, 21))
#: From these days on meta's clicks cost more (per cent) at the same rate, and google's impressions grow (per cent) with a dearer click.
META_STEP, GOOGLE_STEP = (dt.date(1999, 4, 1), 140), (dt.date(2000, 10, 1), 150, 130)
#: Email: weeks before the last one of the orders, over which events are dealt; opens halve over them, and orders do in the flows from 3 on.
LONG_WEEKS = 60


class DriverTables:
    """Raw frames by name, read lazily from `{sf_dir}/{table}.parquet`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def orders(self) -> DataFrame:
        site = F.create_map(*[F.lit(x) for pair in REFERRERS.items() for x in pair])[F.substring("o_orderpriority", 1, 1)]
        second = (F.col("o_orderdate") >= F.lit(SECOND_ACCOUNTS)) & (F.col("o_orderkey") % 3 == 0)
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"), F.when(second, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("customer_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
            (F.col("o_orderstatus") == "P").alias("is_cancelled"), site.alias("referring_site"), F.col("o_orderdate").cast("string").alias("synced_at"),
            decimal("o_totalprice").alias("total_price"),
        )

    def order_lines(self) -> DataFrame:
        gross = decimal("l_extendedprice")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("variant_id"), F.col("l_quantity").cast("long").alias("quantity"),
            gross.alias("gross"), decimal(F.col("l_extendedprice") * F.col("l_discount")).alias("discount"),
        )

    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("variant_id"), F.col("p_name").alias("product_title"), F.col("p_brand").alias("sku"), F.col("p_type").alias("product_type"),
            decimal("p_retailprice").alias("price"), decimal(F.col("p_retailprice") * 0.3).alias("unit_cost"), (F.col("p_size") * 10).cast("long").alias("inventory_quantity"),
        )

    def customers(self) -> DataFrame:
        email = F.when(F.col("c_acctbal") >= 0, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))).otherwise("")
        both = F.explode(F.array(F.col("c_custkey"), -1 - F.col("c_custkey")))
        return self.table("customer").select(
            both.alias("customer_id"), email.alias("email"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "subscribed").otherwise("not_subscribed").alias("email_consent_state"),
        )

    def _events(self) -> DataFrame:
        day = F.date_add(F.lit(AD_ORIGIN), F.datediff(F.col("ts").cast("date"), F.lit(EVENT_ORIGIN)))
        return self.table("events").select(day.alias("day"), "user_id", "event_type", decimal("value").alias("value"))

    def ads_daily(self) -> DataFrame:
        """Grain platform, campaign, day. Conversions are unknown, not zero, for meta."""
        meta = F.col("user_id") % 2 == 0
        campaign = F.when(meta, F.col("user_id") % 6).otherwise(F.col("user_id") % 5)
        e = self._events().select("day", F.when(meta, "meta").otherwise("google").alias("platform"), campaign.alias("campaign_id"), "event_type", "value")
        e = e.where(~((F.col("platform") == "meta") & (F.col("day").isin(*META_GAP) | ((F.col("day") == F.lit(META_PARTIAL)) & (F.col("campaign_id") == 0)))))
        kind = lambda name, what=F.lit(1): F.sum(F.when(F.col("event_type") == name, what))
        google = F.col("platform") == "google"
        return e.groupBy("platform", "campaign_id", F.col("day").alias("ad_date")).agg(
            F.coalesce(kind("view"), F.lit(0)).cast("long").alias("impressions"), F.coalesce(kind("click"), F.lit(0)).cast("long").alias("clicks"),
            F.coalesce(kind("click", F.col("value")), F.lit(0)).cast("decimal(12,2)").alias("spend"), kind("purchase").alias("bought"),
        ).select(
            "platform", F.col("campaign_id").cast("long").alias("campaign_id"), "ad_date", "impressions", "clicks", "spend",
            F.when(google, F.coalesce("bought", F.lit(0)).cast("long")).alias("conversions"), F.date_add("ad_date", 1).alias("available_on"),
            F.element_at(F.array(*[F.lit(c) for c in CAMPAIGNS]), F.col("campaign_id").cast("int") + 1).alias("campaign_name"),
        )

    def email_flows(self) -> DataFrame:
        kind = lambda name: F.count_if(F.col("event_type") == name)
        return self._events().groupBy((F.col("user_id") % 6).cast("long").alias("flow_id"), (F.col("user_id") % 12).cast("long").alias("message_id"), F.date_trunc("week", "day").cast("date").alias("week_start")).agg(
            (F.count("*") * 10).alias("recipients"), (kind("view") * 4).alias("unique_opens"), kind("click").alias("unique_clicks"), kind("error").alias("unique_unsubscribes"),
            kind("purchase").alias("unique_orders"), F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0)).cast("decimal(12,2)").alias("order_value"),
        )

    def _literal(self, rows, schema: str) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema).coalesce(1)

    def budgets(self) -> DataFrame:
        return self._literal(BUDGETS, "budget_month string, channel string, budget_version string, approved_amount double, pacing_profile string, approved_on string").select(
            F.col("budget_month").cast("date").alias("month_start"), "channel", "budget_version", decimal("approved_amount").alias("approved_amount"), "pacing_profile", F.col("approved_on").cast("date").alias("approved_on"))

    def invoice_lines(self) -> DataFrame:
        days = ["service_period_start", "service_period_end", "invoice_date", "received_date"]
        raw = self._literal(INVOICES, "invoice_line_id long, invoice_id string, vendor string, billed_channel string, " + ", ".join(f"{d} string" for d in days) + ", amount double")
        return raw.select("invoice_line_id", "invoice_id", "vendor", "billed_channel", *[F.col(d).cast("date").alias(d) for d in days], decimal("amount").alias("amount"))

    def allocations(self) -> DataFrame:
        return self._literal(ALLOCATIONS, "invoice_line_id long, channel string, allocation_pct double").select("invoice_line_id", "channel", decimal("allocation_pct", 6, 4).alias("allocation_pct"))


class LongTables(DriverTables):
    """The same orders, lines, products and customers, with advertising on every day of the orders and 60 weeks of email, so that
    trends, breaks and outages have a history. Clicks follow the day's orders; email events are dealt to weeks by their ids."""

    def ads_daily(self) -> DataFrame:
        orders = self.table("orders").select(F.col("o_orderdate").cast("date").alias("ad_date"), (F.col("o_orderkey") % 4).cast("int").alias("cell"))
        bounds = orders.agg(F.min("ad_date").alias("a"), F.max("ad_date").alias("b"))
        cells = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(p).alias("platform"), F.lit(c).cast("long").alias("campaign_id"), F.lit(cents).alias("cents"), F.lit(CAMPAIGNS[c]).alias("campaign_name")) for i, (p, c, cents) in enumerate(LONG_CELLS)])
        grid = bounds.select(F.explode(F.sequence("a", "b")).alias("ad_date")).select("ad_date", F.explode(cells).alias("c")).select("ad_date", "c.*")
        g = grid.join(orders.groupBy("ad_date", "cell").agg(F.count("*").alias("n")), ["ad_date", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        gap = [(F.col("platform") == p) & (F.col("ad_date") == F.lit(d)) for p, d in LONG_GAPS]
        p, c, d = LONG_PARTIAL
        gap.append((F.col("platform") == p) & (F.col("campaign_id") == c) & (F.col("ad_date") == F.lit(d)))
        for g_ in gap:
            g = g.where(~g_)
        meta, google = (F.col("platform") == "meta") & (F.col("ad_date") >= F.lit(META_STEP[0])), (F.col("platform") == "google") & (F.col("ad_date") >= F.lit(GOOGLE_STEP[0]))
        clicks = 60 + 25 * F.col("n")
        cents = F.expr("cents * pct div 100")
        g = g.withColumns({"clicks": clicks, "pct": F.when(meta, META_STEP[1]).when(google, GOOGLE_STEP[2]).otherwise(100), "wider": F.when(google, GOOGLE_STEP[1]).otherwise(100)}).withColumn("price", cents)
        return g.select(
            "platform", "campaign_id", "ad_date", F.expr("clicks * 40 * wider div 100").alias("impressions"), "clicks", (F.col("clicks") * F.col("price") / 100.0).cast("decimal(12,2)").alias("spend"),
            F.when(F.col("platform") == "google", F.col("n")).alias("conversions"), F.date_add("ad_date", 1).alias("available_on"), "campaign_name",
        )

    def email_flows(self) -> DataFrame:
        last = self.table("orders").agg(F.date_trunc("week", F.max("o_orderdate")).cast("date").alias("last"))
        e = self.table("events").select((F.col("event_id") % LONG_WEEKS).cast("int").alias("w"), (F.col("user_id") % 6).alias("flow_id"), (F.col("user_id") % 12).alias("message_id"), "event_type", decimal("value").alias("value"))
        kind = lambda name: F.count_if(F.col("event_type") == name)
        g = e.groupBy("w", "flow_id", "message_id").agg(
            ((F.count("*") + 100) * 10).alias("recipients"), kind("view").alias("v"), (kind("click") + 10).alias("unique_clicks"), kind("error").alias("unique_unsubscribes"), kind("purchase").alias("p"),
            F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0)).cast("decimal(12,2)").alias("order_value"))
        falling = lambda c: F.expr(f"({c}) * ({2 * LONG_WEEKS} - w) div {2 * LONG_WEEKS}")
        return g.crossJoin(F.broadcast(last)).select(  # one row
            "flow_id", "message_id", F.date_add("last", (F.col("w") - LONG_WEEKS) * 7).alias("week_start"), "recipients", falling("4 * v + 400").alias("unique_opens"), "unique_clicks", "unique_unsubscribes",
            F.when(F.col("flow_id") >= 3, falling("p + 60")).otherwise(F.col("p") + 60).alias("unique_orders"), "order_value",
        )
