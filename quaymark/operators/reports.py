"""The month-end pack as columns: figures derived a second time from pasted inputs, ties to the marts, and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import ratio
from ..plans.warehouse import Warehouse


def pack(w: Warehouse) -> DataFrame:
    """Per month and channel: inputs as published, and what the pack's own rules make of them (prefix x_)."""
    recon = w.mart_marketing_invoice_recon.select("month_start", "channel", F.col("difference"), F.col("recon_status"))
    i = w.mart_marketing_budget_vs_actual.join(recon, ["month_start", "channel"])
    b, c, d, e, final = (F.col(n) for n in ("approved_budget", "delivered_spend", "media_invoiced", "fee_invoiced", "is_media_final"))
    money = lambda x: x.cast("decimal(12,2)")
    zero = F.lit(0).cast("decimal(12,2)")
    media = F.when(final, d).when(c.isNull(), F.when(d > 0, d)).otherwise(F.greatest(c, d))
    diff = F.when(c.isNotNull() & (d != 0), d - c)
    status = (
        F.when(F.col("channel") == "unallocated", "unallocated_cost").when(c.isNull(), "no_cost_source").when(d == 0, "unbilled")
        .when(F.abs(d - c).cast("double") <= F.abs(c).cast("double") * w.cfg.recon_tolerance_pct / 100.0, "within_tolerance").otherwise("exception")
    )
    return i.withColumns({
        "x_accrual": money(F.when(c.isNotNull(), F.when(final, zero).otherwise(F.greatest(c - d, zero)))), "x_media": money(media),
        "x_expense": money(F.coalesce(media + e, F.when(d + e > 0, d + e))), "x_difference": money(diff), "x_status": status,
    }).withColumn("x_variance", money(F.col("x_media") - b))


TIES = (("x_accrual", "estimated_unbilled_accrual"), ("x_media", "recognised_media_expense"), ("x_expense", "recognised_expense"), ("x_variance", "budget_variance"), ("x_difference", "difference"), ("x_status", "recon_status"))


def ties(p: DataFrame) -> DataFrame:
    """month_start, channel, tie, holds: a blank equals a blank and nothing else."""
    held = [F.struct(F.lit(mart).alias("tie"), F.col(own).eqNullSafe(F.col(mart)).alias("holds")) for own, mart in TIES]
    return p.select("month_start", "channel", F.explode(F.array(*held)).alias("t")).select("month_start", "channel", "t.tie", "t.holds")


def totals(p: DataFrame) -> DataFrame:
    """Month totals; the variance's share is a ratio of sums over channels where it is known."""
    known = F.when(F.col("budget_variance").isNotNull(), F.col("approved_budget"))
    g = p.groupBy("month_start").agg(*[F.sum(c).alias(c) for c in ("approved_budget", "delivered_spend", "media_invoiced", "fee_invoiced", "budget_variance")], F.sum(known).alias("known_budget"))
    return g.withColumn("variance_pct", ratio("budget_variance", "known_budget"))


def _gbp(c: Column) -> Column:
    return F.when(c.isNull(), "no data").otherwise(F.concat(F.when(c < 0, "-").otherwise(""), F.lit("GBP "), F.format_number(F.abs(c).cast("double"), 2)))


def commentary(p: DataFrame) -> DataFrame:
    """One sentence a month on the largest known variance."""
    size = F.abs("budget_variance")
    top = p.where("budget_variance is not null").groupBy("month_start").agg(F.max_by(F.struct("channel", "budget_variance"), F.struct(size, "channel")).alias("t"))
    way = F.when(F.col("t.budget_variance") > 0, " over").otherwise(" under")
    return top.select("month_start", F.concat(F.initcap("t.channel"), F.lit(" is "), _gbp(F.abs("t.budget_variance")), way, F.lit(" its budget.")).alias("sentence"))


def _name(channel: Column) -> Column:
    return F.replace(F.initcap(channel), F.lit("Tiktok"), F.lit("TikTok"))


def _whole(amount: Column) -> Column:
    return F.concat(F.lit("GBP "), F.format_number(F.round(F.abs(amount).cast("double"), 0).cast("long"), 0))


def _share(part: Column) -> Column:
    """A share as a percentage with one digit, from its rounded thousandths."""
    t = F.round(F.abs(part).cast("double") * 1000, 0).cast("long")
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit("%"))


def sentences(p: DataFrame, tolerance_pct: float) -> DataFrame:
    """Per month: variance, unknown, risk and action, four sentences from one pass over its channels.

    The largest known variance against budget; the first channel with a budget but no cost source (null if there is none); the first
    invoice outside the tolerance, or else what is delivered but not yet invoiced; and what to do about it. Where several channels
    have one status the first by name is told, and of equal variances the last.
    """
    c, status = F.col, F.col("recon_status")
    of = lambda name, *cols: F.min(F.when(status == name, F.struct("channel", *cols)))
    g = p.groupBy("month_start").agg(
        F.max(F.when(c("budget_variance").isNotNull(), F.struct(F.abs("budget_variance").alias("size"), "channel", "budget_variance", "budget_variance_pct"))).alias("top"),
        of("no_cost_source", "approved_budget").alias("blind"), of("exception", ratio("difference", "delivered_spend").alias("part"), "data_status").alias("off"),
        F.count_if(status == "unbilled").alias("unbilled"), F.sum("estimated_unbilled_accrual").alias("accrual"),
        F.count_if(status == "unallocated_cost").alias("loose"), F.sum(F.when(status == "unallocated_cost", c("recognised_expense"))).alias("loose_cost"))
    gap = F.coalesce(c("off.data_status") == "source_gap", F.lit(False))
    part = F.coalesce(F.concat(F.lit(" ("), _share(c("top.budget_variance_pct")), F.lit(")")), F.lit(""))
    variance = F.when(c("top").isNull(), "No channel has both a budget and known spend.").otherwise(F.concat(
        _name(c("top.channel")), F.lit(" has the largest variance: "), _whole(c("top.budget_variance")), part, F.when(c("top.budget_variance") > 0, " over budget.").otherwise(" under budget.")))
    unknown = F.when(c("blind").isNotNull(), F.concat(_name(c("blind.channel")), F.coalesce(F.concat(F.lit(" has a budget of "), _whole(c("blind.approved_budget"))), F.lit(" has no budget")), F.lit(" and no cost source; its spend is unknown, not zero.")))
    risk = (
        F.when(c("off").isNotNull(), F.concat(F.lit("Risk: "), _name(c("off.channel")), F.coalesce(F.concat(F.lit(" was invoiced "), _share(c("off.part")), F.lit(f" away from delivered spend, over the tolerance of {tolerance_pct:.1f}%.")), F.lit(" was invoiced without delivered spend.")), F.when(gap, " Days of spend are missing, which may be why.").otherwise("")))
        .when(c("unbilled") > 0, F.concat(F.lit("Risk: "), _whole(F.coalesce("accrual", F.lit(0))), F.lit(" of delivered media is not invoiced and is accrued by estimate.")))
        .otherwise("Risk: none; every invoice is within the tolerance."))
    action = (
        F.when(gap, "Action: get the missing days of spend and reconcile again before asking about the invoice.")
        .when(c("off").isNotNull(), F.concat(F.lit("Action: ask about the invoice of "), _name(c("off.channel")), F.lit(" before it is paid.")))
        .when(c("unbilled") > 0, F.concat(F.lit("Action: accrue "), _whole(F.coalesce("accrual", F.lit(0))), F.lit(" and replace it by the invoices.")))
        .otherwise("Action: none."))
    loose = F.when(c("loose") > 0, F.concat(F.lit(" Allocate "), _whole(F.coalesce("loose_cost", F.lit(0))), F.lit(" that has no channel."))).otherwise("")
    return g.select("month_start", variance.alias("variance"), unknown.alias("unknown"), risk.alias("risk"), F.concat(action, loose).alias("action"))
