"""Reconciliation: the same amounts from two places, met by keys in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SIDES = ("a", "b")


def met(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys..., sides, a_<column>, b_<column>...) of two frames with one row a key, whichever of them has it.

    Both are stacked and brought together by one grouping, not by a join, so that frames of one row (no keys) and of many take the same
    way, and a key that only one side has is a row with one side. A frame with two rows of a key has more sides than two.
    """
    stacked = None
    for side, df in zip(SIDES, (a, b)):
        one = df.select(*keys, F.lit(side).alias("side"), *[F.col(c).cast("double").alias(c) for c in columns])
        stacked = one if stacked is None else stacked.unionByName(one)
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
    return stacked.groupBy(*keys).agg(F.count("side").alias("sides"), F.count_distinct("side").alias("kinds"), *[of(s, c) for s in SIDES for c in columns])


def apart(column: str, tolerance: float) -> Column:
    """Whether the sides differ in a column: by a null, or by more than the tolerance."""
    x, y = F.col(f"a_{column}"), F.col(f"b_{column}")
    return (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))


def reconcile(name: str, a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 0.01) -> DataFrame:
    """(reconciliation, amount, compared, broken, largest): per column how many keys were compared, how many are apart, and by how much at most.

    A key on one side only, or twice on a side, is broken in every column. Null against null agrees; null against a number doesn't.
    Two empty frames have no key to compare, so nothing is returned; a null key is a key.
    """
    whole = (F.col("sides") == 2) & (F.col("kinds") == 2)
    cells = F.array(*[F.struct(F.lit(c).alias("amount"), (~whole | apart(c, tolerance)).alias("off"), F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias("by")) for c in columns])
    long = met(a, b, keys, columns).select(F.explode(cells).alias("t")).select("t.*")
    return long.groupBy("amount").agg(F.count("*").alias("compared"), F.count_if("off").alias("broken"), F.max("by").alias("largest")).select(F.lit(name).alias("reconciliation"), "amount", "compared", "broken", "largest")
