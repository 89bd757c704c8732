from quaymark.operators.reconcile import reconcile

SCHEMA = "k string, x decimal(12,2), y double"


def found(spark, a, b, keys=("k",), tolerance=0.01):
    rows = reconcile("r", spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), list(keys), ["x", "y"], tolerance).collect()
    return {r["amount"]: (r["compared"], r["broken"], r["largest"]) for r in rows}


def test_what_one_side_lacks_is_broken_in_every_amount(spark):
    from decimal import Decimal as D

    got = found(spark, [("a", D("1.00"), 1.0), ("b", D("2.00"), None)], [("a", D("1.00"), 3.5), ("c", D("2.00"), None)])
    assert got == {"x": (3, 2, 0.0), "y": (3, 3, 2.5)}


def test_null_agrees_with_null_alone(spark):
    from decimal import Decimal as D

    assert found(spark, [("a", None, None), ("b", D("0.00"), 0.0)], [("a", None, 0.0), ("b", D("0.00"), 0.005)]) == {"x": (2, 0, 0.0), "y": (2, 1, 0.005)}


def test_tolerance_is_inclusive_and_zero_is_exact(spark):
    a, b = [("a", None, 1.0)], [("a", None, 1.5)]
    assert found(spark, a, b, tolerance=0.5)["y"] == (1, 0, 0.5) and found(spark, a, b, tolerance=0.0)["y"] == (1, 1, 0.5)


def test_repeated_keys_are_broken(spark):
    assert found(spark, [("a", None, 1.0)] * 2, [("a", None, 1.0)])["y"][:2] == (1, 1)
    assert found(spark, [("a", None, 1.0)] * 2, [])["y"][:2] == (1, 1)


def test_a_null_key_is_a_key(spark):
    assert found(spark, [(None, None, 1.0)], [(None, None, 1.0)])["y"] == (1, 0, 0.0)


def test_empty_frames_compare_nothing(spark):
    assert found(spark, [], []) == {}


def test_rules_catch_what_they_are_for(spark, duck):
    """Dropping a row on one side of a hop breaks that hop, by the amount dropped."""
    from conftest import SMALL
    from quaymark import reconciliations as R
    from quaymark.queries import warehouse

    w = warehouse(spark, SMALL)
    costs = w.mart_marketing_budget_vs_actual.persist()
    less = costs.where("channel <> 'tiktok'")
    got = {r["amount"]: r for r in reconcile("c", less, w.mart_marketing_invoice_recon, R.MONTH, R.COSTS, 0.0).collect()}
    lost = costs.where("channel = 'tiktok'").count()
    assert lost > 0 and {r["broken"] for r in got.values()} == {lost} and set(got) == set(R.COSTS)
    costs.unpersist()


def test_accrual_rule_sees_a_wrong_expense(spark):
    from conftest import SMALL
    from pyspark.sql import functions as F
    from quaymark import reconciliations as R
    from quaymark.queries import warehouse

    w = warehouse(spark, SMALL)
    own = w.fct_marketing_cost_monthly.withColumn("is_media_final", F.col("is_media_final").cast("int"))
    wrong = own.withColumn("recognised_expense", F.col("recognised_expense") + 1)
    got = {r["amount"]: r["broken"] for r in reconcile("c", R.accrual(w), wrong, R.MONTH, R.RULED, 0.0).collect()}
    assert got.pop("recognised_expense") == own.where("recognised_expense is not null").count() > 0 and set(got.values()) == {0}
