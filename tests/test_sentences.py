from quaymark.operators.reports import sentences

SCHEMA = ("month_start string, channel string, approved_budget decimal(12,2), delivered_spend decimal(12,2), budget_variance decimal(12,2), budget_variance_pct double, difference decimal(12,2), "
          "estimated_unbilled_accrual decimal(12,2), recognised_expense decimal(12,2), recon_status string, data_status string")


def told(spark, *rows):
    from decimal import Decimal as D

    rows = [tuple(D(str(v)) if isinstance(v, int) else v for v in r) for r in rows]
    return {r["month_start"]: r for r in sentences(spark.createDataFrame(rows, SCHEMA), 2.0).collect()}


def test_each_kind_of_month_has_its_sentences(spark):
    got = told(
        spark,
        ("over", "meta", 1000, 1200, 200, 0.2, 100, 0, 1300, "exception", "source_gap"), ("over", "google", 1000, 900, -100, -0.1, 9, 0, 909, "exception", "complete"),
        ("over", "tiktok", 500, None, None, None, None, None, None, "no_cost_source", "no_cost_source"), ("over", "unallocated", None, None, None, None, None, None, 1234, "unallocated_cost", "unallocated"),
        ("unbilled", "meta", 1000, 1000, -200, -0.2, None, 700, 1000, "unbilled", "complete"), ("unbilled", "google", 1000, 800, 200, 0.2, None, 800, 800, "unbilled", "complete"),
        ("plain", "meta", None, 100, None, None, 1, 0, 101, "within_tolerance", "complete"),
        ("zero", "meta", None, 0, None, None, 50, 0, 50, "exception", "complete"),
    )
    over = got["over"]
    assert over["variance"] == "Meta has the largest variance: GBP 200 (20.0%) over budget."
    assert over["unknown"] == "TikTok has a budget of GBP 500 and no cost source; its spend is unknown, not zero."
    assert over["risk"] == "Risk: Google was invoiced 1.0% away from delivered spend, over the tolerance of 2.0%."  # the first by name
    assert over["action"] == "Action: ask about the invoice of Google before it is paid. Allocate GBP 1,234 that has no channel."
    assert got["unbilled"]["variance"].startswith("Meta") and got["unbilled"]["unknown"] is None
    assert got["unbilled"]["risk"] == "Risk: GBP 1,500 of delivered media is not invoiced and is accrued by estimate."
    assert got["unbilled"]["action"] == "Action: accrue GBP 1,500 and replace it by the invoices."
    assert tuple(got["plain"])[1:] == ("No channel has both a budget and known spend.", None, "Risk: none; every invoice is within the tolerance.", "Action: none.")
    assert got["zero"]["risk"] == "Risk: Meta was invoiced without delivered spend."


def test_missing_days_come_before_the_invoice(spark):
    got = told(spark, ("m", "meta", 1000, 1200, 200, 0.2, 100, 0, 1300, "exception", "source_gap"))["m"]
    assert got["risk"].endswith("Days of spend are missing, which may be why.") and got["action"].startswith("Action: get the missing days")


def test_no_rows_no_sentences(spark):
    assert told(spark) == {}
