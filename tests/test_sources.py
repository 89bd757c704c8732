import datetime as dt

import pytest

from conftest import SMALL
from quaymark.sources import files
from quaymark.streaming import rollup


def test_csv_needs_its_schema(spark, tmp_path):
    (tmp_path / "finance").mkdir()
    (tmp_path / "finance/invoice_line_allocations.csv").write_text("invoice_line_id,channel,allocation_pct,is_synthetic\nL1,meta,0.6,true\nL1,google,0.4,true\n")
    rows = files.read_csv(spark, str(tmp_path), "finance/invoice_line_allocations").collect()
    assert [str(r["allocation_pct"]) for r in rows] == ["0.6000", "0.4000"]


def test_publish_counts_what_it_wrote(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "i int, s string")
    assert files.publish({"m": df}, str(tmp_path)) == {"m": 2} and files.publish({"m": df}, "/nowhere", dry_run=True) == {"m": 2}
    assert [r["i"] for r in files.read_mart(spark, str(tmp_path), "m").collect()] == [1, 2]
    with pytest.raises(ValueError, match="empty"):
        files.publish({"m": df.limit(0)}, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        files.read_mart(spark, str(tmp_path), "other")


def test_violations(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, None, 50), (2, "z", None)], "k int, s string, n int")
    got = {r["rule"]: r["violations"] for r in files.violations(df, ["k"], ["s"], {"s": ["a"]}, {"n": (0, 10)}).collect()}
    assert got == {"not null: s": 1, "accepted: s": 1, "range: n": 1, "unique: k": 1}


def test_stream_gives_the_days_of_the_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.select(F.col("ts").cast("timestamp"), "event_type", "value").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    rollup.run(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r["day"], r["event_type"]): r["events"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["day"], r["event_type"]): r["events"] for r in rollup.daily_events(events).collect()}
    newest = max(d for d, _ in want)
    assert got and all(want[k] == n for k, n in got.items()) and {d for d, _ in got} >= {d for d, _ in want if d < newest - dt.timedelta(days=1)}
