"""What plans read and exchange, and that rows stay the same on odd tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from quaymark import reconciliations as R
from quaymark.plans import warehouse as models
from quaymark.queries import warehouse

TABLES = ("customer", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of order tables in which some rows come twice, and some have null keys or null values."""
    at = tmp_path_factory.mktemp("odd")
    for name in TABLES:
        t = spark.read.parquet(f"{SMALL}/{name}.parquet")
        some = t.limit(6).localCheckpoint()
        nulls = [some.withColumn(c, F.lit(None).cast(t.schema[c].dataType)) for c in t.columns]
        for rows in (some, *nulls):
            t = t.unionByName(rows)
        t.write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_known_rules_read_each_fact_once(spark, monkeypatch):
    read, kept = [], models.settled
    monkeypatch.setattr(models, "settled", lambda df: (read.append(df.inputFiles()), kept(df))[1])
    read.append(R.check_known(spark, SMALL).inputFiles())
    readers = {name: sum(any(f"/{name}.parquet" in f for f in files) for files in read) for name in ("lineitem", "part", "events")}
    assert readers == {"lineitem": 1, "part": 1, "events": 1}


@pytest.mark.parametrize("tables", ["odd", "empty"])
def test_known_rules_count_the_same_rows_as_on_models_built_apart(spark, tables, request):
    folder = request.getfixturevalue(tables)
    got = {r["rule"]: r["broken"] for r in R.check_known(spark, folder).collect()}
    w = warehouse(spark, folder)
    assert got == {name: rows(w).count() for name, (rows, _) in R.KNOWN.items()}


def exchanged(df) -> list[list[str]]:
    """The types of the columns that each shuffle of df carries, by its plan before it runs."""
    found, todo = [], [df._jdf.queryExecution().executedPlan().initialPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            found.append([node.output().apply(i).dataType().simpleString() for i in range(node.output().size())])
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("sent", ["10m", "-1"])
def test_runs_exchange_one_amount_a_line_and_no_wide_sums(spark, sent):
    """With products and orders sent whole, sums of days are exchanged; with none sent, lines are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
    try:
        shuffles = exchanged(warehouse(spark, SMALL).variant_runs.select("variant_id", "since", "until", "units", "net_revenue"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    money = [[int(k[8:].split(",")[0]) for k in columns if k.startswith("decimal")] for columns in shuffles]
    assert len(money) > 1 and max(map(len, money)) == (1 if sent == "-1" else 0) and all(digits <= 18 for columns in money for digits in columns)


@pytest.mark.parametrize("tables", ["odd", "empty"])
def test_money_of_days_is_that_of_their_lines(spark, tables, request):
    w = warehouse(spark, request.getfixturevalue(tables))
    for key, mart in (("variant_id", w.mart_variant_daily), ("sku", w.mart_product_daily)):
        lines = w.sold_lines if key == "variant_id" else w.sold_lines.join(w.dim_product.select("variant_id", key), "variant_id")
        sums = [F.sum(c).alias(c) for c in ("net_revenue", "contribution_margin")]
        theirs = lines.where(f"{key} is not null").groupBy(F.col("order_date").alias("date_day"), key).agg(F.sum("quantity").alias("units"), *sums)
        assert [mart.schema[c].dataType for c in ("net_revenue", "contribution_margin")] == [theirs.schema[c].dataType for c in ("net_revenue", "contribution_margin")]
        whole = theirs.fillna(0).where("units <> 0 or net_revenue <> 0 or contribution_margin <> 0")
        days = mart.select(whole.columns).where("units <> 0 or net_revenue <> 0 or contribution_margin <> 0")
        assert days.exceptAll(whole).count() == whole.exceptAll(days).count() == 0
        assert (days.count() > 0) == (tables == "odd")


def test_sums_of_cents_are_sums_of_money(spark):
    from decimal import Decimal as D

    from quaymark.functions.columns import cents, of_cents

    rows = [("a", D("9999999999.99")), ("a", D("9999999999.99")), ("b", D("-0.01")), ("b", None), ("c", None), ("d", D("-9999999999.99"))]
    t = spark.createDataFrame(rows, "k string, x decimal(12,2)").groupBy("k").agg(F.sum("x").alias("x"), of_cents(F.sum(cents("x"))).alias("y"))
    assert t.schema["x"].dataType == t.schema["y"].dataType and t.where("x <=> y").count() == t.count() == 4
