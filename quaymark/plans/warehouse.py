"""Staging, core and mart models as DataFrames of one cursor. A model is built once for each warehouse object."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import EngineConfig
from ..session import settled
from ..functions.columns import cents, channel, decimal, funnel_stage, iso_dow, month_start, months_apart, of_cents, planned_share, ratio, visible, week_start


#: What a variant's rows carry of its product.
VARIANT = ("product_title", "sku", "product_type")
#: What a product's days are worth.
MONEY = ("net_revenue", "contribution_margin")


def _zero(c: str):
    return F.coalesce(F.col(c), F.lit(0)).alias(c)


class Warehouse:
    """Models over raw inputs (see sources.binding), as visible at cfg.as_of.

    Dense grids and calendars are as large as days times channels or products; facts are joined to them after aggregation.
    No model collects rows: bounds of the calendar are a one-row frame.
    """

    #: Whether this build stands at the newest day there is.
    is_latest = True

    def __init__(self, raw, cfg: EngineConfig = EngineConfig()):
        self.raw, self.cfg = raw, cfg

    def persist(self, *models: str) -> None:
        """Compute models that several consumers of this warehouse read once, in files that outlive executors."""
        for name in models:
            self.__dict__[name] = settled(getattr(self, name))

    # -- staging: what each source says, as far as it was available

    @cached_property
    def stg_orders(self) -> DataFrame:
        # No order is synced before it is made: the cursor on the typed event day reaches the scan, the exact filter on the synced text doesn't.
        made = F.col("created_at") < F.lit(dt.datetime.combine(self.cfg.as_of + dt.timedelta(days=1), dt.time())).cast("timestamp_ntz")
        o = self.raw.orders().where(made).where(visible("synced_at", "created_at", self.cfg.as_of))
        return o.withColumns({"order_date": F.col("created_at").cast("date"), "channel": channel("referring_site")})

    @cached_property
    def stg_order_lines(self) -> DataFrame:
        """Lines have no sync day of their own: they are visible with their order."""
        return self.raw.order_lines().join(self.stg_orders.select("order_id"), "order_id")

    @cached_property
    def stg_customers(self) -> DataFrame:
        email = F.nullif(F.lower(F.trim("email")), F.lit(""))
        return self.raw.customers().select("customer_id", email.alias("customer_email"), email.isNotNull().alias("has_valid_email"), "email_consent_state")

    @cached_property
    def stg_products(self) -> DataFrame:
        net = F.col("price").cast("double") / (1 + self.cfg.vat_rate)
        return self.raw.products().withColumns({"price_ex_vat": decimal(net), "margin_pct": decimal(ratio(net - F.col("unit_cost").cast("double"), net), 6, 4)})

    @cached_property
    def stg_ads_daily(self) -> DataFrame:
        return self.raw.ads_daily().where(F.col("available_on") <= F.lit(self.cfg.as_of))

    @cached_property
    def stg_email_flows(self) -> DataFrame:
        return self.raw.email_flows().where(F.date_add("week_start", 7) <= F.lit(self.cfg.as_of))

    @cached_property
    def stg_marketing_budget(self) -> DataFrame:
        return self.raw.budgets().where(F.col("approved_on") <= F.lit(self.cfg.as_of))

    @cached_property
    def stg_vendor_invoice_lines(self) -> DataFrame:
        lines = self.raw.invoice_lines().where(F.col("received_date") <= F.lit(self.cfg.as_of))
        return lines.withColumns({"cost_type": F.when(F.col("billed_channel") == "agency", "fee").otherwise("media"), "service_month": month_start("service_period_start")})

    # -- core

    @cached_property
    def dim_date(self) -> DataFrame:
        """Every day from the first order to the last, or the cursor if that is earlier."""
        b = self.stg_orders.agg(F.min("order_date").alias("a"), F.least(F.lit(self.cfg.as_of), F.max("order_date")).alias("b"))
        d = b.select(F.explode(F.sequence("a", "b")).alias("date_day"))
        return d.select(
            "date_day", F.year("date_day").cast("long").alias("year"), F.month("date_day").cast("long").alias("month"), F.date_format("date_day", "yyyy-MM").alias("year_month"),
            iso_dow("date_day").alias("iso_dow"), F.weekofyear("date_day").cast("long").alias("iso_week"), week_start("date_day").alias("week_start"),
            month_start("date_day").alias("month_start"), (iso_dow("date_day") >= 6).alias("is_weekend"), F.month("date_day").isin(11, 12).alias("is_peak_season"),
        )

    @cached_property
    def last_day(self) -> DataFrame:
        return self.dim_date.agg(F.max("date_day").alias("last_day"))

    @cached_property
    def dim_customer(self) -> DataFrame:
        first = self.stg_orders.where("not is_cancelled").groupBy("customer_id").agg(
            F.min("order_date").alias("first_order_date"), F.min_by("channel", F.struct("created_at", "order_id")).alias("first_channel"))
        return self.stg_customers.join(first, "customer_id", "left").select(
            "customer_id", "customer_email", "has_valid_email", (F.col("has_valid_email") & (F.col("email_consent_state") == "subscribed")).alias("is_marketable"),
            "email_consent_state", "first_order_date", month_start("first_order_date").alias("first_order_month"), F.coalesce("first_channel", F.lit("unattributed")).alias("acquisition_channel"),
        )

    @cached_property
    def dim_product(self) -> DataFrame:
        return self.stg_products.drop("price_ex_vat")

    @cached_property
    def dim_campaign(self) -> DataFrame:
        key = F.concat_ws(":", "platform", F.col("campaign_id").cast("string"))
        return self.stg_ads_daily.select(key.alias("campaign_key"), "platform", "campaign_id", "campaign_name", funnel_stage("campaign_name").alias("funnel_stage")).distinct()

    @cached_property
    def fct_order(self) -> DataFrame:
        """is_first_order holds for every order at a customer's first moment, so ties mark several."""
        first = self.stg_orders.where("not is_cancelled").groupBy("customer_id").agg(F.min("created_at").alias("first_at"))
        return self.stg_orders.join(first, "customer_id", "left").select(
            "order_id", "customer_id", "order_date", "created_at", "channel", "is_cancelled", "total_price",
            (~F.col("is_cancelled") & F.coalesce(F.col("created_at") == F.col("first_at"), F.lit(False))).alias("is_first_order"),
        )

    @cached_property
    def fct_order_line(self) -> DataFrame:
        """Revenue without tax is rounded once, on the line; cost is exact. Lines meet the visible orders once, in their fact.

        What is paid is made before the joins, so that whoever reads only revenue has one amount exchanged and not the two that it is made of.
        """
        lines = self.raw.order_lines().withColumn("paid", F.col("gross") - F.col("discount"))
        lines = lines.join(self.fct_order.select("order_id", "customer_id", "order_date", "channel", "is_cancelled"), "order_id")
        lines = lines.join(self.dim_product.select("variant_id", "unit_cost"), "variant_id")
        paid = F.col("paid")
        out = lines.select(
            "order_id", "customer_id", "variant_id", "order_date", "channel", "is_cancelled", "quantity", F.col("gross").alias("gross_revenue_incl_vat"),
            F.col("discount").alias("line_discount"), paid.cast("decimal(12,2)").alias("net_revenue_incl_vat"),
            decimal(paid.cast("double") / (1 + self.cfg.vat_rate)).alias("net_revenue"), (F.col("unit_cost") * F.col("quantity").cast("decimal(10,0)")).cast("decimal(12,2)").alias("cogs"),
        )
        return out.withColumn("contribution_margin", (F.col("net_revenue") - F.col("cogs")).cast("decimal(12,2)"))

    @cached_property
    def sold_lines(self) -> DataFrame:
        """What the marts read of the lines that weren't cancelled."""
        return self.fct_order_line.where("not is_cancelled").select("order_date", "channel", "customer_id", "variant_id", "quantity", "line_discount", "net_revenue", "contribution_margin")

    @cached_property
    def fct_ad_spend_daily(self) -> DataFrame:
        key = F.concat_ws(":", "platform", F.col("campaign_id").cast("string"))
        a = self.stg_ads_daily.withColumn("campaign_key", key).join(self.dim_campaign.select("campaign_key", "funnel_stage"), "campaign_key")
        return a.select(
            "campaign_key", "platform", "campaign_id", "funnel_stage", "ad_date", "impressions", "clicks", "spend", "conversions", "available_on",
            decimal(ratio("spend", "clicks"), 12, 4).alias("cpc"), decimal(ratio(F.col("spend").cast("double") * 1000, "impressions"), 12, 4).alias("cpm"),
            decimal(ratio("clicks", "impressions"), 8, 6).alias("ctr"),
        )

    @cached_property
    def fct_email_flow_weekly(self) -> DataFrame:
        rate = lambda c, s=6, p=8: decimal(ratio(c, "recipients"), p, s)
        return self.stg_email_flows.withColumns({
            "flow_name": F.concat(F.lit("Flow "), F.col("flow_id").cast("string")), "open_rate": rate("unique_opens"), "click_rate": rate("unique_clicks"),
            "conversion_rate": rate("unique_orders"), "unsubscribe_rate": rate("unique_unsubscribes"), "revenue_per_recipient": rate("order_value", 4, 12),
        })

    @cached_property
    def fct_invoice_allocated(self) -> DataFrame:
        """Penny-exact shares: each row rounded, the line's last channel takes what the rounded total leaves."""
        lines, shares = self.stg_vendor_invoice_lines, self.raw.allocations()
        of_line = W.partitionBy("invoice_line_id")
        part = F.round(F.col("amount") * F.col("allocation_pct"), 2).cast("decimal(12,2)")
        cut = lines.select("invoice_line_id", "amount").join(shares, "invoice_line_id").withColumn("part", part).select(
            "invoice_line_id", "channel", "allocation_pct", "part", "amount",
            F.row_number().over(of_line.orderBy(F.desc("channel"))).alias("place"), F.sum("part").over(of_line).alias("parts"), F.sum("allocation_pct").over(of_line).alias("pct"),
        )
        rest = F.round(F.col("amount") * F.col("pct"), 2) - (F.col("parts") - F.col("part"))
        shared = cut.select("invoice_line_id", "channel", "allocation_pct", F.when(F.col("place") == 1, rest).otherwise(F.col("part")).cast("decimal(12,2)").alias("allocated_amount"), F.lit("allocated").alias("allocation_status"))
        loose = lines.join(shares, "invoice_line_id", "left_anti").select(
            "invoice_line_id", F.lit("unallocated").alias("channel"), F.lit(None).cast("decimal(6,4)").alias("allocation_pct"), F.col("amount").alias("allocated_amount"), F.lit("unallocated").alias("allocation_status"))
        return shared.unionByName(loose).join(lines.withColumnRenamed("amount", "line_amount"), "invoice_line_id")

    @cached_property
    def fct_marketing_cost_monthly(self) -> DataFrame:
        """Delivered, invoiced and recognised cost of a month and channel; see the order of the rules in each `when`."""
        months = self.dim_date.select("month_start").distinct()
        grid = months.select("month_start", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(has).alias("has")) for c, has in (("meta", True), ("google", True), ("tiktok", False))])).alias("c"))
        grid = grid.select("month_start", "c.channel", F.col("c.has").alias("has_cost_source"))
        media, fee = F.col("cost_type") == "media", F.col("cost_type") == "fee"
        whole = (F.col("service_period_start") == F.col("service_month")) & (F.col("service_period_end") == F.last_day("service_month"))
        billed = self.fct_invoice_allocated.groupBy(F.col("service_month").alias("month_start"), "channel").agg(
            F.sum(F.when(media, F.col("allocated_amount"))).alias("media"), F.sum(F.when(fee, F.col("allocated_amount"))).alias("fee"), F.count("*").alias("invoice_rows"),
            F.count_if(media).alias("media_rows"), F.count_if(media & whole).alias("final_rows"))
        spent = self.fct_ad_spend_daily.groupBy(month_start("ad_date").alias("month_start"), F.col("platform").alias("channel")).agg(F.sum("spend").alias("spent"), F.count_distinct("ad_date").alias("delivered_days"))
        grid = grid.unionByName(billed.where("channel = 'unallocated'").select("month_start", "channel", F.lit(False).alias("has_cost_source")))
        at = ["month_start", "channel"]
        b = grid.join(spent, at, "left").join(billed, at, "left").select(
            *at, "has_cost_source", F.when(F.col("has_cost_source"), F.col("spent")).cast("decimal(12,2)").alias("delivered_spend"), _zero("delivered_days"),
            F.coalesce("media", F.lit(0)).cast("decimal(12,2)").alias("media_invoiced"), F.coalesce("fee", F.lit(0)).cast("decimal(12,2)").alias("fee_invoiced"),
            _zero("invoice_rows"), _zero("media_rows"), (F.col("has_cost_source") & (F.coalesce("final_rows", F.lit(0)) > 0)).alias("is_media_final"),
            F.day(F.last_day("month_start")).cast("long").alias("days_in_month"),
        )
        m, f, d = F.col("media_invoiced"), F.col("fee_invoiced"), F.col("delivered_spend")
        recognised = F.when(F.col("is_media_final"), m).when(d.isNotNull(), F.greatest(d, m))
        money = lambda c: c.cast("decimal(12,2)")
        return b.select(
            *at, "has_cost_source", "delivered_spend", "media_invoiced", "fee_invoiced", money(m + f).alias("invoiced_amount"), "is_media_final",
            money(F.when(d.isNull(), None).when(F.col("is_media_final"), 0).otherwise(F.greatest(d - m, F.lit(0).cast("decimal(12,2)")))).alias("estimated_unbilled_accrual"),
            money(F.coalesce(recognised + f, F.when(F.col("invoice_rows") > 0, m + f))).alias("recognised_expense"),
            money(F.coalesce(recognised, F.when(F.col("media_rows") > 0, m))).alias("recognised_media_expense"), "delivered_days", "days_in_month", "invoice_rows",
            F.when(F.col("channel") == "unallocated", "unallocated").when(~F.col("has_cost_source"), "no_cost_source")
            .when(F.last_day("month_start") >= F.lit(self.cfg.as_of), "partial_month").when(F.col("delivered_days") < F.col("days_in_month"), "source_gap").otherwise("complete").alias("data_status"),
        )

    # -- marts

    @cached_property
    def mart_data_quality(self) -> DataFrame:
        """Per source and day: what is missing, against the usual number of rows (the most common; of equals the larger)."""
        days, ads = self.dim_date.select("date_day"), self.fct_ad_spend_daily
        counted = ads.groupBy("platform", F.col("ad_date").alias("date_day")).agg(F.count("*").alias("row_count"))
        usual = counted.groupBy("platform", "row_count").agg(F.count("*").alias("n")).groupBy("platform").agg(F.max_by("row_count", F.struct("n", "row_count")).alias("expected_count"))
        ad_days = days.crossJoin(F.broadcast(usual)).join(counted, ["platform", "date_day"], "left").select(F.concat("platform", F.lit("_ads_daily")).alias("source_name"), "date_day", "row_count", "expected_count")
        orders = days.join(self.fct_order.groupBy(F.col("order_date").alias("date_day")).agg(F.count("*").alias("row_count")), "date_day", "left")
        all_ = orders.select(F.lit("orders").alias("source_name"), "date_day", "row_count", F.lit(None).cast("long").alias("expected_count")).unionByName(ad_days)
        n = F.col("row_count")
        return all_.select(
            "source_name", "date_day", n.isNotNull().alias("observed"), n.isNull().alias("is_gap"), _zero("row_count"), "expected_count",
            F.when(n.isNull(), "missing_day").when(n < F.col("expected_count"), "partial_day").otherwise("ok").alias("issue_type"),
        )

    @cached_property
    def mart_daily_trading(self) -> DataFrame:
        """Days x channels. Counts and revenue are zero where nothing happened, ratios and spend are null."""
        at = ["date_day", "channel"]
        kept = self.fct_order.where("not is_cancelled")
        first = F.col("is_first_order")
        orders = kept.groupBy(F.col("order_date").alias("date_day"), "channel").agg(
            F.count("*").alias("orders"), F.count_distinct(F.when(first, F.col("customer_id"))).alias("new_customers"), F.count_distinct(F.when(~first, F.col("customer_id"))).alias("returning_customers"))
        lines = self.sold_lines.groupBy(F.col("order_date").alias("date_day"), "channel").agg(
            F.sum("net_revenue").alias("net_revenue"), F.sum("contribution_margin").alias("contribution_margin"), F.sum("quantity").alias("units"), F.sum("line_discount").alias("discounts"))
        spend = self.fct_ad_spend_daily.groupBy(F.col("ad_date").alias("date_day"), F.col("platform").alias("channel")).agg(
            F.sum("spend").alias("ad_spend"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.max("available_on").alias("spend_available_on"))
        whole = self.mart_data_quality.where("source_name <> 'orders'").groupBy("date_day").agg(F.bool_and(F.col("issue_type") == "ok").alias("complete"))
        grid = self.dim_date.select("date_day", "is_peak_season", "iso_dow", "week_start", F.explode(F.array(*map(F.lit, self.cfg.channels))).alias("channel"))
        g = grid.join(orders, at, "left").join(lines, at, "left").join(spend, at, "left").join(whole, "date_day", "left")
        day = W.partitionBy("date_day")
        g = g.withColumns({
            "ad_spend_is_complete": F.coalesce("complete", F.lit(False)), "day_new": F.sum("new_customers").over(day), "day_spend": F.sum("ad_spend").over(day),
        })
        return g.select(
            *at, *map(_zero, ("orders", "new_customers", "returning_customers", "net_revenue", "contribution_margin")), decimal(ratio("net_revenue", "orders")).alias("aov"),
            _zero("units"), _zero("discounts"), decimal(ratio("units", "orders"), 12, 4).alias("units_per_order"), decimal(ratio("net_revenue", "units"), 12, 4).alias("revenue_per_unit"),
            # The discount counts tax, the revenue doesn't: kept as published.
            decimal(ratio("discounts", F.col("net_revenue") + F.col("discounts")), 12, 6).alias("discount_rate"), "ad_spend", "clicks", "impressions", "spend_available_on",
            decimal(ratio("ad_spend", "new_customers")).alias("channel_cac"), decimal(ratio("net_revenue", "ad_spend"), 12, 4).alias("channel_roas"),
            decimal(ratio("contribution_margin", "ad_spend"), 12, 4).alias("channel_margin_roas"), "ad_spend_is_complete",
            F.when(F.col("ad_spend_is_complete"), decimal(ratio("day_spend", "day_new"))).alias("blended_cac"), "is_peak_season", "iso_dow", "week_start",
        )

    def _sold(self, key: str) -> DataFrame:
        """Units, and revenue and margin in cents, by day and product (or another product attribute)."""
        sold = self.sold_lines
        if key != "variant_id":
            sold = sold.join(self.dim_product.select("variant_id", key), "variant_id")
        sold = sold.where(F.col(key).isNotNull()).groupBy(F.col("order_date").alias("date_day"), key)
        return sold.agg(F.sum("quantity").alias("units"), *[F.sum(cents(c)).alias(c) for c in MONEY])

    def _product_runs(self, key: str, *carried: str) -> DataFrame:
        """A product's days as runs from `since` to `until`, in which the sums of the last 7 and 28 days (units_7d, units_28d) do not change: a sale
        begins one, and its leaving either sum does. Units and money are those of the run's first day; on its others nothing was sold.

        Runs are as many as sales, not days times products; all of a product's are in one partition, so whatever is grouped by it needs no exchange.
        Money is summed and exchanged as cents.
        """
        stock = self.dim_product.groupBy(key).agg(F.sum("inventory_quantity").alias("inventory_quantity"), *[F.first(c).alias(c) for c in carried])
        sold = self._sold(key)
        about = F.struct("inventory_quantity", *carried)
        money = ("units", *MONEY)
        kinds = dict(sold.dtypes)
        none = [F.lit(None).cast(kinds[c]).alias(c) for c in money]
        rows = sold.select(key, "date_day", *money, F.lit(None).cast(stock.select(about.alias("x")).schema["x"].dataType).alias("about"))
        rows = rows.unionByName(stock.select(key, F.lit(None).cast("date").alias("date_day"), *none, about.alias("about"))).repartition(key)
        bounds = self.dim_date.agg(F.min("date_day").alias("start"), F.max("date_day").alias("end"))
        day, units = F.col("date_day"), F.col("units")
        at = lambda since, d7, d28, own: F.struct(since.alias("since"), d7.cast("long").alias("d7"), d28.cast("long").alias("d28"), *[(F.col(c) if own else F.lit(None).cast(kinds[c])).alias(c) for c in money])
        turns = F.when(day.isNull(), F.array(at(F.col("start"), F.lit(0), F.lit(0), False))).otherwise(
            F.array(at(day, units, units, True), at(F.date_add(day, 7), -units, F.lit(0), False), at(F.date_add(day, 28), F.lit(0), -units, False)))
        turned = rows.crossJoin(F.broadcast(bounds)).select(key, "start", "end", "about", F.explode(turns).alias("t")).select(key, "start", "end", "about", "t.*").where("since between start and `end`")
        days = turned.groupBy(key, "since").agg(
            F.first("start").alias("start"), F.first("end").alias("end"), F.first("about", ignorenulls=True).alias("about"), F.sum("d7").alias("d7"), F.sum("d28").alias("d28"), *[F.max(c).alias(c) for c in money])
        of = W.partitionBy(key).orderBy("since")
        run = of.rowsBetween(W.unboundedPreceding, 0)
        runs = days.select(
            key, "start", "since", F.coalesce(F.date_sub(F.lead("since").over(of), 1), "end").alias("until"), F.first("about").over(run).alias("about"),
            F.sum("d7").over(run).alias("units_7d"), F.sum("d28").over(run).alias("units_28d"), *money)
        return runs.select(key, "start", "since", "until", "about.*", "units_7d", "units_28d", "units", *[of_cents(c).alias(c) for c in MONEY])

    @staticmethod
    def spread(runs: DataFrame, key: str, *carried: str) -> DataFrame:
        """Days x products, dense, of runs, with trailing means over 7 and 28 days: made where the runs are, without an exchange."""
        d = runs.withColumn("date_day", F.explode(F.sequence(F.coalesce("shown", "since") if "shown" in runs.columns else F.col("since"), F.col("until"))))
        own = lambda c: F.when(F.col("date_day") == F.col("since"), F.coalesce(c, F.lit(0).cast(runs.schema[c].dataType))).otherwise(F.lit(0).cast(runs.schema[c].dataType)).alias(c)
        mean = lambda n: F.col(f"units_{n}d").cast("double") / F.least(F.datediff("date_day", "start") + 1, F.lit(n))
        d = d.select("date_day", key, *carried, "inventory_quantity", *map(own, ("units", "net_revenue", "contribution_margin")), mean(7).alias("velocity_7d"), mean(28).alias("velocity_28d"))
        return d.withColumns({"velocity_ratio": ratio("velocity_7d", "velocity_28d"), "days_of_cover": ratio("inventory_quantity", "velocity_28d")})

    @cached_property
    def _variant_money(self) -> DataFrame:
        """variant_runs with money as doubles: cast once a run, not once a day."""
        return self.variant_runs.withColumns({c: F.col(c).cast("double") for c in ("net_revenue", "contribution_margin")})

    @property
    def variant_days(self) -> DataFrame:
        """mart_variant_daily with money as doubles."""
        return self.spread(self._variant_money, "variant_id", *VARIANT)

    def variant_days_in_order(self, rows: int = 1_500_000) -> DataFrame:
        """variant_days in the order of day and variant, which are its key, across partitions of about so many rows and a day at least.

        Runs are cut at the ends of stretches of days and dealt by them, so what is exchanged is cuts of runs, not days times variants; a stretch is sorted where it is made.
        """
        runs = self._variant_money
        whole = runs.agg(F.min("since").alias("a"), F.max("until").alias("b"), F.sum(F.datediff("until", "since") + 1).alias("n")).first()  # one row: bounds and a count
        if whole["n"] is None:
            return self.variant_days
        days = (whole["b"] - whole["a"]).days + 1
        width = -(-days // min(days, -(-whole["n"] // rows)))
        place = lambda c: F.expr(f"datediff({c}, date'{whole['a']}') div {width}")
        cut = runs.withColumn("stretch", F.explode(F.sequence(place("since"), place("until")))).withColumn("stretch", F.col("stretch").cast("int"))
        begun = F.date_add(F.lit(whole["a"]), F.col("stretch") * width)
        cut = cut.withColumns({"shown": F.greatest("since", begun), "until": F.least("until", F.date_add(begun, width - 1))}).repartitionById(-(-days // width), F.col("stretch"))
        return self.spread(cut, "variant_id", *VARIANT).sortWithinPartitions("date_day", "variant_id")

    @staticmethod
    def overlaps(runs: DataFrame, key: str) -> DataFrame:
        """key, days: how many days of a product stand in more than one of its runs, for products that have such days. Counted where runs begin and end, so the days aren't made."""
        ends = F.array(F.struct(F.least("since", "until").alias("day"), F.lit(1).alias("by")), F.struct(F.date_add(F.greatest("since", "until"), 1).alias("day"), F.lit(-1).alias("by")))
        turns = runs.select(key, F.explode(ends).alias("t")).groupBy(key, "t.day").agg(F.sum("t.by").alias("by"))
        of = W.partitionBy(key).orderBy("day")
        held = turns.select(key, F.datediff(F.lead("day").over(of), "day").alias("days"), F.sum("by").over(of.rowsBetween(W.unboundedPreceding, 0)).alias("deep"))
        return held.where("deep > 1").groupBy(key).agg(F.sum("days").alias("days"))

    def product_last(self, key: str, days: int = 1) -> DataFrame:
        """The rows of a product mart on the last so many days."""
        runs, carried = (self.variant_runs, VARIANT) if key == "variant_id" else (self.product_runs, ())
        runs = runs.crossJoin(F.broadcast(self.last_day)).where(F.col("until") > F.date_sub("last_day", days))
        return self.spread(runs.withColumn("shown", F.greatest("since", F.date_sub("last_day", days - 1))), key, *carried)

    def catalogue(self, key: str) -> DataFrame:
        """date_day, total: the sum over the catalogue of velocity_7d, from the units of all products together."""
        daily = self.dim_date.select("date_day").join(self._sold(key).groupBy("date_day").agg(F.sum("units").alias("units")), "date_day", "left")
        week = W.orderBy("date_day").rowsBetween(-6, 0)  # one row a day
        return daily.select("date_day", (F.coalesce(F.sum("units").over(week), F.lit(0)).cast("double") / F.count(F.lit(1)).over(week)).alias("total"))

    @cached_property
    def product_runs(self) -> DataFrame:
        return self._product_runs("sku")

    @cached_property
    def variant_runs(self) -> DataFrame:
        return self._product_runs("variant_id", *VARIANT)

    @cached_property
    def mart_product_daily(self) -> DataFrame:
        """The roll-up per brand, which stands in for a stock keeping unit here."""
        return self.spread(self.product_runs, "sku")

    @cached_property
    def mart_variant_daily(self) -> DataFrame:
        """Per variant, the reference's grain."""
        return self.spread(self.variant_runs, "variant_id", *VARIANT)

    @cached_property
    def _cohorts(self) -> DataFrame:
        return self.dim_customer.where("first_order_date is not null").select("customer_id", "first_order_date", F.col("first_order_month").alias("cohort_month"), "acquisition_channel")

    @cached_property
    def mart_cohort_retention(self) -> DataFrame:
        """Retention by calendar month and the rolling 90-day repeat rate, each null until its window has wholly passed."""
        c = self._cohorts
        orders = c.join(self.fct_order.where("not is_cancelled").select("customer_id", "order_date"), "customer_id")
        later = (F.col("order_date") > F.col("first_order_date")) & (F.col("order_date") <= F.date_add("first_order_date", 90))
        active = orders.groupBy("cohort_month", months_apart("cohort_month", "order_date").alias("months_since")).agg(F.count_distinct("customer_id").alias("active"))
        again = orders.where(later).groupBy("cohort_month").agg(F.count_distinct("customer_id").alias("again"))
        sizes = c.groupBy("cohort_month").agg(F.count("*").alias("cohort_size"), F.date_add(F.max("first_order_date"), 90).alias("exposure_90d_end"))
        bounds = sizes.agg(F.min("cohort_month").alias("oldest")).crossJoin(self.last_day).select("last_day", months_apart("oldest", "last_day").alias("ages"))
        grid = sizes.crossJoin(F.broadcast(bounds)).withColumn("months_since", F.explode(F.sequence(F.lit(0).cast("long"), "ages"))).where("months_since > 0")
        g = grid.join(active, ["cohort_month", "months_since"], "left").join(again, "cohort_month", "left")
        end = F.date_sub(F.add_months("cohort_month", F.col("months_since").cast("int") + 1), 1)
        g = g.withColumns({"window_end": end, "repeat_customers": F.coalesce("active", F.lit(0)), "repeat_within_90d": F.coalesce("again", F.lit(0)), "seen": end <= F.col("last_day"), "seen_90d": F.col("exposure_90d_end") <= F.col("last_day")})
        rate = ratio("repeat_customers", "cohort_size")
        return g.select(
            "cohort_month", "months_since", "cohort_size", "repeat_customers", "window_end", F.col("seen").alias("has_full_exposure"), F.when(F.col("seen"), rate).alias("retention_rate"), rate.alias("raw_retention_rate"),
            "repeat_within_90d", "exposure_90d_end", F.col("seen_90d").alias("has_full_90d_exposure"), F.when(F.col("seen_90d"), ratio("repeat_within_90d", "cohort_size")).alias("repeat_rate_90d"),
        )

    @cached_property
    def mart_ltv(self) -> DataFrame:
        """Revenue and margin of a cohort within 30, 60 and 90 days of each customer's first order; null per head until all had the time."""
        at = ["cohort_month", "acquisition_channel"]
        hs = F.array(*map(F.lit, self.cfg.horizons))
        bought = self._cohorts.join(self.sold_lines.select("customer_id", "order_date", "net_revenue", "contribution_margin"), "customer_id")
        # The join on the customer comes first; horizons multiply only what lies within the longest.
        age = F.datediff("order_date", "first_order_date")
        within = bought.where((age >= 0) & (age < max(self.cfg.horizons))).withColumn("horizon_days", F.explode(F.filter(hs, lambda h: h > age)))
        sums = within.groupBy(*at, "horizon_days").agg(F.sum("net_revenue").alias("cum_net_revenue"), F.sum("contribution_margin").alias("cum_contribution_margin"))
        sizes = self._cohorts.groupBy(*at).agg(F.count("*").alias("cohort_size"), F.max("first_order_date").alias("last_first")).withColumn("horizon_days", F.explode(hs))
        g = sizes.join(sums, [*at, "horizon_days"], "left").crossJoin(F.broadcast(self.last_day)).withColumn("exposure_end", F.date_add("last_first", F.col("horizon_days")))
        seen = F.col("exposure_end") <= F.col("last_day")
        head = lambda c: F.when(seen, ratio(F.coalesce(c, F.lit(0)), "cohort_size"))
        return g.select(*at, "horizon_days", "cohort_size", "exposure_end", seen.alias("has_full_exposure"), _zero("cum_net_revenue"), _zero("cum_contribution_margin"), head("cum_net_revenue").alias("ltv_revenue"), head("cum_contribution_margin").alias("ltv_margin"))

    @cached_property
    def mart_email_flow_weekly(self) -> DataFrame:
        sums = ("recipients", "unique_opens", "unique_clicks", "unique_unsubscribes", "unique_orders", "order_value")
        r = self.fct_email_flow_weekly.groupBy("flow_name", "week_start").agg(*[F.sum(c).alias(c) for c in sums])
        r = r.withColumns({n: ratio(c, "recipients") for n, c in (("open_rate", "unique_opens"), ("click_rate", "unique_clicks"), ("conversion_rate", "unique_orders"), ("unsubscribe_rate", "unique_unsubscribes"), ("revenue_per_recipient", "order_value"))})
        eight = W.partitionBy("flow_name").orderBy("week_start").rowsBetween(-7, 0)
        return r.withColumns({f"{c}_8w": F.avg(c).over(eight) for c in ("open_rate", "click_rate", "conversion_rate")})

    @cached_property
    def _budget(self) -> DataFrame:
        """The latest version visible; on one day the revised one."""
        latest = W.partitionBy("month_start", "channel").orderBy(F.desc("approved_on"), F.when(F.col("budget_version") == "revised", 0).otherwise(1))
        return self.stg_marketing_budget.withColumn("place", F.row_number().over(latest)).where("place = 1").select("month_start", "channel", F.col("approved_amount").alias("approved_budget"), F.col("budget_version").alias("budget_version_used"), "pacing_profile")

    @cached_property
    def mart_marketing_budget_vs_actual(self) -> DataFrame:
        """Positive variance: spent over the budget. Null where either side is unknown."""
        c = self.fct_marketing_cost_monthly.join(self._budget, ["month_start", "channel"], "left")
        over = F.col("recognised_media_expense") - F.col("approved_budget")
        return c.withColumns({"remaining_budget": (-over).cast("decimal(12,2)"), "budget_variance": over.cast("decimal(12,2)"), "budget_variance_pct": decimal(ratio(over, "approved_budget"), 12, 6)}).drop("has_cost_source", "delivered_days", "days_in_month", "invoice_rows")

    @cached_property
    def mart_marketing_pacing_daily(self) -> DataFrame:
        """Every day of every month on the calendar, past the cursor too. Plans are rounded as running totals, then differenced."""
        days = self.dim_date.select("month_start").distinct().select("month_start", F.explode(F.sequence("month_start", F.last_day("month_start"))).alias("date_day"))
        days = days.select("month_start", "date_day", F.explode(F.array(*map(F.lit, ("meta", "google", "tiktok")))).alias("channel")).withColumns({
            "has": F.col("channel") != "tiktok", "day_of_month": F.day("date_day").cast("long"), "days_in_month": F.day(F.last_day("month_start")).cast("long")})
        spend = self.fct_ad_spend_daily.groupBy(F.col("ad_date").alias("date_day"), F.col("platform").alias("channel")).agg(F.sum("spend").alias("spend"))
        b = days.join(self._budget, ["month_start", "channel"], "left").join(spend, ["date_day", "channel"], "left")
        status = F.when(~F.col("has"), "no_cost_source").when(F.col("spend").isNotNull(), "delivered").when(F.date_add("date_day", 1) > F.lit(self.cfg.as_of), "not_yet_visible").otherwise("missing")
        share = planned_share("pacing_profile", "day_of_month", "days_in_month")
        b = b.withColumns({"spend_status": status, "planned_cumulative": decimal(F.col("approved_budget").cast("double") * share)})
        month = W.partitionBy("channel", "month_start").orderBy("date_day")
        week = W.partitionBy("channel").orderBy("date_day").rowsBetween(-6, 0)
        b = b.withColumns({
            "before": F.coalesce(F.lag("planned_cumulative").over(month), F.lit(0).cast("decimal(12,2)")), "running": F.sum("spend").over(month.rowsBetween(W.unboundedPreceding, 0)),
            "trailing": F.sum("spend").over(week).cast("double") / F.nullif(F.count("spend").over(week), F.lit(0)),
        })
        known = F.col("spend_status").isin("delivered", "missing")
        forecast = F.col("running").cast("double") + F.col("trailing") * (F.col("days_in_month") - F.col("day_of_month"))
        return b.select(
            "date_day", "month_start", "channel", "day_of_month", "days_in_month", "approved_budget", "budget_version_used", "pacing_profile", (F.col("planned_cumulative") - F.col("before")).cast("decimal(12,2)").alias("planned_spend"),
            "planned_cumulative", F.col("spend").cast("decimal(12,2)").alias("delivered_spend"), F.when(known, F.col("running")).cast("decimal(12,2)").alias("delivered_cumulative"), "spend_status",
            F.when(known, decimal(ratio("running", "planned_cumulative"), 12, 6)).alias("pacing_ratio"), F.when(known, decimal("trailing")).alias("run_rate_7d"),
            F.when(known, decimal(forecast)).alias("forecast_month_end"), F.when(known, decimal(forecast - F.col("approved_budget").cast("double"))).alias("forecast_overspend"),
        )

    @cached_property
    def mart_marketing_invoice_recon(self) -> DataFrame:
        """Media invoices against delivered spend; fees are shown, never compared."""
        d, m = F.col("delivered_spend"), F.col("media_invoiced")
        both, off = d.isNotNull() & (m > 0), m - d
        near = F.abs(off).cast("double") <= F.abs(d).cast("double") * self.cfg.recon_tolerance_pct / 100.0
        return self.fct_marketing_cost_monthly.select(
            "month_start", "channel", "delivered_spend", "media_invoiced", "fee_invoiced", "invoiced_amount", "estimated_unbilled_accrual", "is_media_final",
            F.when(both, off).cast("decimal(12,2)").alias("difference"), F.when(both, decimal(ratio(off, d), 12, 6)).alias("difference_pct"),
            F.when(F.col("channel") == "unallocated", F.col("invoiced_amount")).otherwise(F.lit(0).cast("decimal(12,2)")).alias("unallocated_invoiced_amount"),
            F.when(F.col("channel") == "unallocated", "unallocated_cost").when(~F.col("has_cost_source"), "no_cost_source").when(m == 0, "unbilled").when(near, "within_tolerance").otherwise("exception").alias("recon_status"), "data_status",
        )
