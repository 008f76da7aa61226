"""Summaries of metrics over conditions and over runs."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(c) -> F.Column:
    return F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))


def correlation(a, b) -> F.Column:
    """Pearson's correlation as an aggregate; null where either side hardly varies (a deviation of 1e-12 or less)."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sa > 1e-12) & (sb > 1e-12), F.covar_pop(a, b) / F.nullif(sa * sb, F.lit(0.0)))


def record_summary(records: DataFrame, metrics: list[str], keys=()) -> DataFrame:
    """keys, n_conditions and the mean of the finite values of each metric; null where there is none."""
    return records.groupBy(*keys).agg(F.count("*").alias("n_conditions"), *(F.avg(finite(m)).alias(m) for m in metrics))


def t_quantile(p: float, df: int) -> float:
    """The p-quantile of Student's t, by bisection of its distribution function's series in sin and cos (df is a whole number)."""

    def cdf(t):
        a = math.atan2(t, math.sqrt(df))
        s, c = math.sin(a), math.cos(a)
        term, total = (c, c) if df % 2 and df > 1 else (1.0, 1.0)
        for i in range(3 if df % 2 else 2, df - 1, 2):
            term *= c * c * (i - 1) / i
            total += term
        if df % 2:
            return 0.5 + (a + (s * total if df > 1 else 0.0)) / math.pi
        return 0.5 + s * total / 2

    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def seed_summary(runs: DataFrame, metrics: list[str], most_runs: int = 200) -> DataFrame:
    """metric, mean, std, n, ci95_half_width, lower, upper over runs (a row each), of finite values; null under two of them.

    The table of t quantiles has most_runs rows; the normal quantile stands in beyond it.
    """
    each = runs.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), finite(m).cast("double").alias("v")) for m in metrics))).alias("e")).select("e.*")
    stats = each.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("v").alias("n"))
    quantiles = F.array(*(F.lit(t_quantile(0.975, df)) for df in range(1, most_runs)))
    t = F.when(F.col("n") > 1, F.coalesce(F.get(quantiles, (F.col("n") - 2).cast("int")), F.lit(1.959963984540054)))
    half = t * F.col("std") / F.sqrt("n")
    std = F.when(F.col("n") > 1, F.col("std")).alias("std")
    return stats.select("metric", "mean", std, "n", half.alias("ci95_half_width"), (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))
