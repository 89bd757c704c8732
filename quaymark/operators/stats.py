"""Robust statistics of many series at once.

A series is the rows of one key in the order of a column; places are counted after nulls are dropped. Every function takes
(df, keys, order, value) and gives one row a key, by grouping and joining within the key, so that a million short series are
one job. Pairs are made within a series only: callers cut series to their window (90 days at most here).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Coefficients of a Chebyshev fit of erfc with relative error below 1.2e-7 everywhere (Press et al., 1992).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_p(z: Column) -> Column:
    """2 (1 - Phi(|z|)) = erfc(|z| / sqrt 2)."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = 1.0 / (1.0 + x * 0.5)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def _placed(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    at = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return df.where(F.col(value).isNotNull()).select(*keys, at.alias("i"), F.col(value).cast("double").alias("y"))


def _pairs(placed: DataFrame, keys: list[str]) -> DataFrame:
    later = placed.select(*keys, F.col("i").alias("j"), F.col("y").alias("yj"))
    return placed.join(later, keys).where("i < j")


def theil_sen(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, n, slope: the median of all pairwise slopes; null for fewer than two values."""
    placed = _placed(df, keys, order, value)
    slope = (F.col("yj") - F.col("y")) / (F.col("j") - F.col("i"))
    return placed.groupBy(*keys).agg(F.count("*").alias("n")).join(_pairs(placed, keys).groupBy(*keys).agg(F.percentile(slope, 0.5).alias("slope")), keys, "left")


def mann_kendall(df: DataFrame, keys: list[str], order: str, value: str, least: int = 8) -> DataFrame:
    """keys, n, z, p: trend test with the variance corrected for ties and one unit of continuity; null below `least` values,
    (0, 1) where all values tie."""
    placed = _placed(df, keys, order, value)
    ties = placed.groupBy(*keys, "y").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias("tied"))
    s = _pairs(placed, keys).groupBy(*keys).agg(F.sum(F.signum(F.col("yj") - F.col("y"))).alias("s"))
    n = F.col("n")
    var = (n * (n - 1) * (2 * n + 5) - F.col("tied")) / F.lit(18.0)
    t = ties.join(s, keys, "left").withColumns({"var": var, "s": F.coalesce("s", F.lit(0.0))})
    z = F.when(F.col("var") <= 0, 0.0).when(F.col("s") == 0, 0.0).otherwise((F.col("s") - F.signum("s")) / F.sqrt("var"))
    p = F.when(F.col("var") <= 0, 1.0).otherwise(two_sided_p(z))
    return t.select(*keys, "n", F.when(n >= least, z).alias("z"), F.when(n >= least, p).alias("p"))


def mad_z(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, n, point, z: the last value against the ones before it, 0.6745 (x - median) / MAD; where the MAD is 0 the
    population's standard deviation takes its place, and a constant history gives 0. Null below three values."""
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("i")))
    p = _placed(df, keys, order, value).withColumn("back", last)
    past = p.where("back > 1")
    mid = past.groupBy(*keys).agg(F.percentile("y", 0.5).alias("med"), F.stddev_pop("y").alias("sd"), (F.count("*") + 1).alias("n"))
    mad = past.join(mid, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("y") - F.col("med")), 0.5).alias("mad"))
    d = F.col("y") - F.col("med")
    z = F.when(F.col("mad") > 0, 0.6745 * d / F.col("mad")).when(F.col("sd") > 0, d / F.col("sd")).otherwise(0.0)
    return p.where("back = 1").join(mid, keys).join(mad, keys).select(*keys, "n", F.col("y").alias("point"), F.when(F.col("n") >= 3, z).alias("z"))


#: Stretches of [0, 1] by the fourth root, in which p-values are ranked apart.
CHUNKS = 4096


def benjamini_hochberg(df: DataFrame, p: str, alpha: float, within: list[str]) -> DataFrame:
    """df with `kept`: true up to the last rank r of m with p <= alpha r / m. Null and NaN are no tests and never kept.

    Only tested rows are ranked, and of equal p-values, which share a verdict, one row with their number. The rank of a value is the
    number of tests in the chunks before its own and up to it in that one, so no group is a single window; the last value kept
    is joined back to the rows of the group.
    """
    tested = df.where(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(*within, F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    tested = tested.withColumn("_k", F.floor(F.sqrt(F.sqrt("_p")) * CHUNKS))
    upto = lambda keys, order, last: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, last)
    chunks = tested.groupBy(*within, "_k").agg(F.sum("_c").alias("_n"))
    chunks = chunks.select(*within, "_k", F.coalesce(F.sum("_n").over(upto(within, "_k", -1)), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*within)).alias("_m"))
    ranked = tested.withColumn("_in", F.sum("_c").over(upto([*within, "_k"], "_p", 0))).join(chunks, [*within, "_k"])
    last = ranked.where(F.col("_p") <= (F.col("_before") + F.col("_in")) * alpha / F.col("_m")).groupBy(*within).agg(F.max("_p").alias("_last"))
    return df.join(last, within, "left").withColumn("kept", F.coalesce((F.col(p) <= F.col("_last")) & ~F.isnan(p), F.lit(False))).select(*df.columns, "kept")


def dow_adjusted(df: DataFrame, keys: list[str], dow: str, value: str) -> DataFrame:
    """df with `factor` and `adjusted`: value over its weekday's median as a share of the overall one; a factor of 0 or less is 1."""
    day = df.groupBy(*keys, dow).agg(F.percentile(value, 0.5).alias("_day"))
    all_ = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("_all"))
    f = F.when((F.col("_day") > 0) & (F.col("_all") > 0), F.col("_day") / F.col("_all")).otherwise(1.0)
    return df.join(day, [*keys, dow]).join(all_, keys).withColumn("factor", f).withColumn("adjusted", F.col(value) / F.col("factor")).drop("_day", "_all")


def severity_from_z(z: Column, cap: float = 6.0) -> Column:
    return F.coalesce(F.least(F.abs(z), F.lit(cap)) / cap, F.lit(0.0))


def persistent(df: DataFrame, keys: list[str], order: str, flag: str, last: int) -> DataFrame:
    """keys, persistent: the last `last` flags are all true, and there are as many."""
    p = df.withColumn("_back", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_back") <= last)
    return p.groupBy(*keys).agg((F.bool_and(F.coalesce(F.col(flag), F.lit(False))) & (F.count("*") == last)).alias("persistent"))


def elasticity(df: DataFrame, keys: list[str], x: str, y: str, least: int = 20, prior: tuple[float, float] = (0.35, 0.20), floor: float = 0.05) -> DataFrame:
    """keys, beta, se of log y on log x; the prior for fewer than `least` points or a constant x. A falling slope has the prior's beta and the wider error."""
    logs = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(*keys, F.ln(F.col(x).cast("double")).alias("lx"), F.ln(F.col(y).cast("double")).alias("ly"))
    g = logs.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("ly", "lx").alias("b"), F.regr_sxx("ly", "lx").alias("sxx"), F.regr_syy("ly", "lx").alias("syy"), F.regr_sxy("ly", "lx").alias("sxy"))
    ok = (F.col("n") >= least) & (F.col("sxx") > 0)
    error = F.sqrt(F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx"))
    rising = F.col("b") >= 0
    se = F.when(ok & rising, F.greatest(error, F.lit(floor))).when(ok, F.greatest(error, F.lit(prior[1]))).otherwise(prior[1])
    return g.select(*keys, "n", F.when(ok & rising, F.col("b")).otherwise(prior[0]).alias("beta"), se.alias("se"))


def log_shares(a: Column, b: Column) -> tuple[Column, Column]:
    """Shares of two factors' logarithms in a product's change."""
    la, lb = F.abs(F.ln(a)), F.abs(F.ln(b))
    whole = F.nullif(la + lb, F.lit(0.0))
    return la / whole, lb / whole
