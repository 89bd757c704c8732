"""What training exchanges, and that the rows sampled are those of the plain ranking."""

import pytest
from pyspark.sql import functions as F

from quaymark.llm import toxicity as T


@pytest.fixture(scope="module")
def rows(spark):
    """Rows of two classes: ids that repeat with the same text and with another one, and equal texts of different ids."""
    data = [(i % 40, f"text {i % 23}", i % 2) for i in range(200)] + [(7, "text 7", 1)] * 5 + [(8, "", 0)] * 3
    return spark.createDataFrame(data, "doc_id long, text string, label int").repartition(5).withColumn("digest", F.xxhash64("text")).localCheckpoint()


@pytest.mark.parametrize("n", [1, 4, 30, 1000])
def test_the_sample_is_the_first_rows_by_hash(rows, n):
    for label in (0, 1):
        plain = rows.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(n).select("text", "label")
        assert [tuple(r) for r in T._sample(rows, label, n).collect()] == [tuple(r) for r in plain.collect()]


def test_the_sample_of_no_rows_is_empty(rows):
    assert T._sample(rows, 2, 5).count() == 0


def test_counting_exchanges_no_texts(rows):
    counts = T._counts(rows.select("text", "label"), 3 * T.ROWS_PER_TASK)
    todo, kinds = [counts._jdf.queryExecution().executedPlan().initialPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            kinds += [node.output().apply(i).dataType().simpleString() for i in range(node.output().size())]
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert kinds and set(kinds) <= {"int", "bigint"}
    seen = [(T.presence(r["text"]), r["label"]) for r in rows.collect()]
    theirs = {}
    for buckets, label in seen:
        for b in buckets.tolist():
            pair = theirs.setdefault(b, [0, 0])
            pair[0 if label == 1 else 1] += 1
    assert {r["bucket"]: [r["pos"], r["neg"]] for r in counts.collect()} == theirs
