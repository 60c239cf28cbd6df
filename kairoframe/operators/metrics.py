"""Metrics, baselines, folds, calibration and intervals as aggregates and column expressions."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip
from . import ranks

EDGE = 1e-7


def log_loss(y: Column, p: Column) -> Column:
    q = clip(p, EDGE, 1 - EDGE)
    return F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(p - y))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((p - y) * (p - y)))


def poisson_deviance(y: Column, mu: Column) -> Column:
    m = F.greatest(mu, F.lit(1e-9))
    return F.avg(2 * (F.when(y > 0, y * F.ln(y / m)).otherwise(0.0) - (y - m)))


def poisson_nll(y: Column, mu: Column) -> Column:
    """Mean negative log-likelihood; log y! is exact up to 20 and Stirling's series (error under 1e-12) beyond."""
    m = F.greatest(mu, F.lit(1e-9))
    n = y.cast("double")
    series = n * F.ln(n) - n + 0.5 * F.ln(2 * F.lit(math.pi) * n) + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * F.pow(n, F.lit(5.0)))
    log_factorial = F.when(y <= 20, F.ln(F.factorial(y.cast("int")).cast("double"))).otherwise(series)
    return F.avg(m - y * F.ln(m) + log_factorial)


def pinball(y: Column, p: Column, q: float) -> Column:
    e = y - p
    return F.avg(F.greatest(q * e, (q - 1) * e))


def calibration_error(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """One row: the expected calibration error over equal bins of the probability."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    grouped = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(F.col(y).cast("double")).alias("my"))
    return grouped.agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: area under the precision-recall curve; equal scores count together.

    Scores are summed up first, so the running sums go over distinct scores.
    """
    per_score = df.groupBy(p).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("pos"))
    run = ranks.running(per_score, [], [F.desc(p)], {"tp": F.col("pos"), "k": F.col("n")})
    return run.agg((F.sum(F.col("pos") * F.col("tp") / F.col("k")) / F.sum("pos")).alias("average_precision"))


def laplace_prior(y: Column, strength: float = 1.0) -> Column:
    return (F.sum(y.cast("double")) + strength) / (F.count(y) + 2 * strength)


def shrunk_mean(y: Column, prior: Column, weight: float) -> Column:
    return (F.sum(y) + prior * weight) / (F.count(y) + weight)


def rolling_origin(df: DataFrame, period: str, minimum: int = 2) -> DataFrame:
    """Rows once for every fold they serve in: fit (before), calibrate (the period before the test), test."""
    periods = df.select(period).distinct().withColumn("_i", F.dense_rank().over(Window.orderBy(period)))
    folds = periods.filter(F.col("_i") > minimum).select(F.col(period).alias("fold"), F.col("_i").alias("_f"))
    roles = periods.join(F.broadcast(folds), F.col("_i") <= F.col("_f")).select(period, "fold", F.when(F.col("_i") == F.col("_f"), "test").when(F.col("_i") == F.col("_f") - 1, "calibrate").otherwise("fit").alias("role"))
    return df.join(F.broadcast(roles), period)  # periods squared: seasons, not rows


def conformal_radius(df: DataFrame, error: Column, coverage: float = 0.8, keys: Sequence[str] = ()) -> DataFrame:
    """Per key the order statistic of |error| at ceil(level * (n - 1)), level = min(1, ceil((n + 1) * coverage) / n)."""
    n = F.col("n")
    level = F.least(F.lit(1.0), F.ceil((n + 1) * coverage) / n)
    found = ranks.order_statistics(df, keys, F.abs(error), {"radius": F.ceil(F.round(level * (n - 1), 9))})
    return found.select(*keys, "radius", "n")


def subgroup(df: DataFrame, group: str, y: str, p: str, least: int = 20) -> DataFrame:
    """Log-loss and Brier score of each group that has at least `least` rows."""
    t, q = F.col(y).cast("double"), F.col(p)
    return df.groupBy(group).agg(F.count("*").alias("n"), log_loss(t, q).alias("log_loss"), brier(t, q).alias("brier")).filter(F.col("n") >= least)


def bootstrap_mean(df: DataFrame, cluster: str, value: str, resamples: int = 2000, seed: str = "bootstrap", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row: mean of the clusters' means and its interval by resampling clusters.

    Draw j of resample b takes the cluster whose number a digest of seed, b
    and j gives; there are as many draws as clusters.
    """
    means = df.groupBy(cluster).agg(F.avg(value).alias("m"))
    numbered = ranks.numbered(means, [F.col(cluster)], "i")
    n = max(numbered.count(), 1)
    told = F.concat_ws(":", F.lit(seed), F.floor(F.col("id") / n).cast("string"), F.pmod("id", F.lit(n)).cast("string"))
    share = F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))
    draws = df.sparkSession.range(resamples * n).select(F.floor(F.col("id") / n).alias("b"), F.floor(share * n).cast("bigint").alias("i"))
    sampled = draws.join(numbered.select("i", "m"), "i").groupBy("b").agg(F.avg("m").alias("m"))
    interval = sampled.agg(F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high"))  # of as many values as resamples
    return means.agg(F.avg("m").alias("mean"), F.count("*").alias("clusters")).crossJoin(F.broadcast(interval))


def coherent(df: DataFrame, bounds: dict[str, Sequence[str]]) -> DataFrame:
    """Wide predictions made consistent: each column at most the least of the columns that bound it."""
    return df.withColumns({c: F.least(c, *others) for c, others in bounds.items()})
