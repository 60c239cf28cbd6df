"""Scoring rules, risk objectives and rankings."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def points(base: Column, weights: dict[str, float], minutes: Column, least_minutes: float = 1.0) -> Column:
    """base + sum of counts by weight; a null count is 0; nothing below the least minutes."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) * F.lit(w) for c, w in weights.items()], base)
    return F.when((minutes >= least_minutes) & (minutes > 0), total).otherwise(0.0)


def sample_points(samples: dict[str, np.ndarray], base: float, weights: dict[str, float], least_minutes: float = 1.0) -> np.ndarray:
    """`points` of arrays of samples, which have the counts and the minutes by name."""
    total = sum((samples[c] * w for c, w in weights.items()), np.full(samples["minutes"].shape, base))
    return np.where((samples["minutes"] >= least_minutes) & (samples["minutes"] > 0), total, 0.0)


def bands(value: Column, steps: dict[float, float]) -> Column:
    """A step function: the points of the highest band that the value reaches, 0 under all."""
    out = F.lit(0.0)
    for band, gain in sorted(steps.items()):
        out = F.when(value >= band, gain).otherwise(out)
    return out


def risk(mean: Column, p10: Column, p90: Column, mode: str) -> Column:
    """balanced: the mean; floor: with the low tenth; upside: with the high tenth."""
    other = {"balanced": None, "floor": p10, "upside": p90}[mode]
    return mean if other is None else F.lit(0.6) * mean + F.lit(0.4) * other


def top_reasons(df: DataFrame, key: str, weight: str, confidence: str, reason: str, tiebreak: str, k: int) -> DataFrame:
    """Per key the k weightiest reasons; the last becomes a caveat if any of them is of low confidence."""
    order = Window.partitionBy(key).orderBy(F.desc(weight), tiebreak)
    top = df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    doubtful = F.bool_or(F.col(confidence) < 0.5).over(Window.partitionBy(key))
    return top.select(key, "rank", F.when((F.col("rank") == k) & doubtful, "caveat").otherwise(F.col(reason)).alias("reason"))


def rank_swaps(swaps: DataFrame, gain: str, over_replacement: str, price: str, target: str, k: int) -> DataFrame:
    """The best swap for each target, then the k best by gain, value over replacement, price (unknown last) and id."""
    order = [F.desc(gain), F.desc(over_replacement), F.asc_nulls_last(price), F.col(target)]
    best = swaps.withColumn("_n", F.row_number().over(Window.partitionBy(target).orderBy(*order))).filter("_n = 1").drop("_n")
    return best.orderBy(*order).limit(k)
