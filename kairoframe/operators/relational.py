"""Relational operators that Spark has no single call for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def where_all(df: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """Filters by those of the optional conditions that are given."""
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def not_in(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """NOT IN for keys that are never null: an anti join."""
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def semi_by_coverage(df: DataFrame, group: str, covered: Column, least: float) -> DataFrame:
    """Rows of the groups whose share of covered rows is at least `least`."""
    good = df.groupBy(group).agg(F.avg(covered.cast("double")).alias("_share")).filter(F.col("_share") >= least)
    return df.join(good, group, "left_semi")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page with the total number of rows of the whole result on each row."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def with_summary(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Each row with the one row of an ungrouped aggregate."""
    return df.crossJoin(F.broadcast(summary.limit(1)))  # an aggregate has one row


def either(a: Column, b: Column, value: object) -> Column:
    """Whether one of two columns has the value, e.g. a team at home or away."""
    return (a == value) | (b == value)


def both_sides(df: DataFrame, sides: dict[str, dict[str, str]], name: str = "side") -> DataFrame:
    """One row per side of each row, e.g. home and away; sides maps a side to {new column: column}."""
    made = [F.struct(F.lit(s).alias(name), *[F.col(c).alias(n) for n, c in columns.items()]) for s, columns in sides.items()]
    used = {c for columns in sides.values() for c in columns.values()}
    rest = [c for c in df.columns if c not in used]
    return df.select(*rest, F.inline(F.array(*made)))


def evenly_spaced(df: DataFrame, order: Sequence[Column], count: int) -> DataFrame:
    """About `count` rows at equal steps of the order, which must be total; the first and the last are among them."""
    n = df.count()
    if n <= count:
        return df
    wanted = sorted({round(i * (n - 1) / max(count - 1, 1)) for i in range(count)})
    return ranks.numbered(df, order, "_n").filter(F.col("_n").isin(wanted)).drop("_n")


def shuffled(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Rows with `draw`, a number that seed and key alone decide; ordering by it is a reproducible shuffle."""
    return df.withColumn("draw", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 13), 16, 10).cast("bigint"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionByName(b.exceptAll(a)).distinct()


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], guard: str | None = None) -> DataFrame:
    """Rows of both with incoming ones replacing current ones of the same key.

    With a guard column an incoming row replaces only a row whose guard is not
    greater.  Incoming rows of one key: the greatest by guard, then by all
    columns.
    """
    order = [F.desc(guard)] if guard else []
    one = top_per_group(incoming, keys, [*order, *[F.desc(c) for c in incoming.columns if c not in keys and c != guard]], 1).drop("rank")
    both = current.withColumn("_new", F.lit(0)).unionByName(one.withColumn("_new", F.lit(1)))
    best = [F.desc(guard), F.desc("_new")] if guard else [F.desc("_new")]
    return top_per_group(both, keys, best, 1).drop("rank", "_new")


def insert_if_absent(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new keys, of several of one key the first by all columns."""
    one = top_per_group(incoming, keys, [F.col(c) for c in incoming.columns if c not in keys] or [F.lit(1)], 1, "_first").drop("_first")
    fresh = one.join(current.select(*keys), list(keys), "left_anti")
    return current.unionByName(fresh)
