"""Operators on facts that have a time of happening and a time of becoming known.

Two times belong to a fact: `event_time` (when it happened) and `available_at`
(when it could be known).  What a decision at `cutoff` may use is
``event_time < cutoff AND available_at <= cutoff``: strict for the event, inclusive
for its availability.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of the k-th most recent event is exp(-DECAY * (k - 1)).
DECAY = 0.35


def visible(cutoff: Column, event_time: Column, available_at: Column | None = None) -> Column:
    """The as-of predicate."""
    known = event_time < cutoff
    return known if available_at is None else known & (available_at <= cutoff)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order (later versions first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def history_as_of(
    candidates: DataFrame,
    history: DataFrame,
    row: str,
    on: Sequence[tuple[str, str]],
    cutoff: str,
    event_time: str,
    available_at: str,
    version: Sequence[str],
    newest: Sequence[Column],
    recent: Sequence[Column],
    limit: int | None = None,
) -> DataFrame:
    """Each candidate's visible history, one version of each event, with `recency` 1 for the latest.

    An equi-join on `on` with the as-of predicate as its residual condition;
    of an event's visible versions (same `version` columns) the first in the
    order `newest` counts.  `recent` orders a candidate's events; with `limit`
    only that many are kept, which Spark turns into a group limit before the
    sort.
    """
    keys = [candidates[c] == history[h] for c, h in on]
    joined = candidates.join(history, reduce(lambda a, b: a & b, [*keys, visible(candidates[cutoff], history[event_time], history[available_at])]))
    ranked = latest(joined, [row, *version], newest)
    w = Window.partitionBy(row).orderBy(*recent)
    out = ranked.withColumn("recency", F.row_number().over(w))
    return out if limit is None else out.filter(F.col("recency") <= limit)


def recent_before(
    candidates: DataFrame,
    history: DataFrame,
    on: tuple[str, str],
    cutoff: str,
    event_time: str,
    tiebreak: str,
    fields: Sequence[str],
    limit: int,
    name: str = "recent",
) -> DataFrame:
    """Candidates with an array of their last `limit` events strictly before the cutoff, latest first.

    No join of candidates with their histories: the history is folded along
    time once (arrays of the last `limit` events per key and time), and each
    candidate takes the array of the last time before it.  Work is linear in
    both inputs, however long a key's history is.  A candidate without history
    gets an empty array.
    """
    ckey, hkey = on
    inside = Window.partitionBy(hkey, event_time).orderBy(F.desc(tiebreak))
    events = history.filter(F.col(hkey).isNotNull()).select(F.col(hkey).alias("_k"), F.col(event_time).alias("_t"), F.struct(F.col(event_time).alias("t"), F.col(tiebreak).alias("tb"), *fields).alias("_e"), F.row_number().over(inside).alias("_n")).filter(F.col("_n") <= limit)
    at_time = events.groupBy("_k", "_t").agg(F.sort_array(F.collect_list("_e"), asc=False).alias("_a"))
    back = Window.partitionBy("_k").orderBy("_t").rowsBetween(-(limit - 1), 0)
    folded = at_time.select("_k", "_t", F.slice(F.flatten(F.reverse(F.collect_list("_a").over(back))), 1, limit).alias(name))
    asked = candidates.select(F.col(ckey).alias("_k"), F.col(cutoff).alias("_t")).filter("_k IS NOT NULL").distinct()
    line = folded.withColumn("_asks", F.lit(False)).unionByName(asked.withColumn("_asks", F.lit(True)), allowMissingColumns=True)
    # A question sorts before the events of its own time: the cutoff is strict.
    so_far = Window.partitionBy("_k").orderBy("_t", F.desc("_asks")).rowsBetween(Window.unboundedPreceding, 0)
    answers = line.withColumn(name, F.last(name, ignorenulls=True).over(so_far)).filter("_asks").drop("_asks")
    joined = candidates.join(answers, (candidates[ckey] == answers["_k"]) & (candidates[cutoff] == answers["_t"]), "left").drop("_k", "_t")
    return joined.withColumn(name, F.coalesce(name, F.slice(name, 1, 0), F.filter(F.array(F.lit(None).cast(_element(folded, name))), lambda x: F.lit(False))))


def _element(df: DataFrame, name: str):
    return df.schema[name].dataType.elementType


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, take: Sequence[str], strict: bool = False) -> DataFrame:
    """Backward as-of join: each left row with the last right row of its key at or before (strict: before) its time.

    Both sides are laid on one line per key and the last right row is carried
    forward, so there is one shuffle and no range join.  Right rows of equal
    key and time: the one that is greatest by `take` counts.  Null keys or
    times match nothing.
    """
    packed = right.filter(F.col(right_time).isNotNull()).groupBy(*by, F.col(right_time).alias("_t")).agg(F.max(F.struct(F.col(right_time).alias("_rt"), *take)).alias("_r"))
    columns = [f for f in left.schema.fields]
    rows = left.select(*by, F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_l"))
    line = rows.unionByName(packed, allowMissingColumns=True)
    first = F.col("_l").isNull() if strict else F.col("_l").isNotNull()
    w = Window.partitionBy(*by).orderBy(F.col("_t").asc_nulls_first(), first.cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    valid = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by], F.col("_t").isNotNull())
    met = line.withColumn("_m", F.when(valid, F.last("_r", ignorenulls=True).over(w))).filter(F.col("_l").isNotNull())
    return met.select(*[F.col("_l")[f.name].alias(f.name) for f in columns], F.col("_m")["_rt"].alias(right_time), *[F.col("_m")[c].alias(c) for c in take])


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Each column's last non-null value so far; a null never erases what was known."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def merge_versions(updates: DataFrame, keys: Sequence[str], available_at: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Partial updates of a fact as a stream of full versions, one for each instant at which something became known.

    Updates of one instant merge in the given order, a later non-null value
    winning; then each instant's values are laid over those of before.
    """
    instant = Window.partitionBy(*keys, available_at).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = updates.select(*keys, available_at, *[F.last(c, ignorenulls=True).over(instant).alias(c) for c in columns]).distinct()
    return carry_forward(merged, keys, [F.col(available_at)], columns)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """Adds `island`: a number per key that grows whenever the value changes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def spans(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[Column], value: str) -> DataFrame:
    """Gaps and islands as validity spans (key, value, valid_from, valid_to, observations); the last span is open."""
    grouped = islands(df, keys, order, value).groupBy(*keys, "island").agg(F.first(value).alias(value), F.min(time).alias("valid_from"), F.count("*").alias("observations"))
    w = Window.partitionBy(*keys).orderBy("island")
    return grouped.withColumn("valid_to", F.lead("valid_from").over(w))


def within(time: Column, valid_from: Column, valid_to: Column) -> Column:
    """Membership of a half-open validity interval whose missing end means open."""
    return (valid_from <= time) & (valid_to.isNull() | (time < valid_to))


def overlay(evidence: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key from several sources of evidence; earlier sources win, then the order within."""
    ranked = [e.withColumn("precedence", F.lit(i)) for i, e in enumerate(evidence)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return latest(every, keys, [F.col("precedence"), *order])


def coalesce_by_source(df: DataFrame, keys: Sequence[str], order: Sequence[Column], fields: Sequence[str]) -> DataFrame:
    """Per key each field's first non-null value in the order of sources, and whether sources disagree."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = df.select(*keys, *[F.first(f, ignorenulls=True).over(w).alias(f"_{f}") for f in fields], *fields)
    return first.groupBy(*keys).agg(*[F.first(f"_{f}").alias(f) for f in fields], *[(F.count_distinct(f) > 1).alias(f"{f}_conflict") for f in fields])


def audit(snapshot: DataFrame, cutoff: str, lineage: Sequence[str]) -> DataFrame:
    """One row per lineage column: rows checked and rows that saw something after the cutoff."""
    checks = [F.struct(F.lit(c).alias("lineage"), F.col(c).isNotNull().alias("present"), (F.col(c) > F.col(cutoff)).alias("late")) for c in lineage]
    rows = snapshot.select(F.explode(F.array(*checks)).alias("c")).select("c.*")
    return rows.groupBy("lineage").agg(F.count_if("present").alias("rows_checked"), F.count_if(F.coalesce("late", F.lit(False))).alias("violations"))


def require_no_future(snapshot: DataFrame, cutoff: str, lineage: Sequence[str]) -> DataFrame:
    """The snapshot itself; reading a row that saw the future raises."""
    late = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > F.col(cutoff), F.lit(False)) for c in lineage])
    message = F.concat(F.lit("future information at cutoff "), F.col(cutoff).cast("string"))
    return snapshot.filter(F.when(late, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


# ------------------------------------------------ aggregates by recency


def ewma(value: Column, recency: Column, limit: int, decay: float = DECAY) -> Column:
    """Aggregate: recency-weighted mean of the last `limit` events; null values drop out of both sums."""
    weight = F.when(value.isNotNull() & (recency <= limit), F.exp(F.lit(-decay) * (recency - 1)))
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0.0))


def rate(value: Column, exposure: Column, recency: Column, limit: int, per: float = 90.0) -> Column:
    """Aggregate: per * sum(value) / sum(exposure) over the last `limit` events, where the value is known."""
    use = value.isNotNull() & (recency <= limit)
    return F.lit(per) * F.sum(F.when(use, value)) / F.nullif(F.sum(F.when(use, exposure)), F.lit(0.0))


def trend(value: Column, recency: Column, limit: int) -> Column:
    """Aggregate: slope against recency with the sign turned, so that positive is rising; null under two events."""
    near = recency <= limit
    return -F.when(F.count_if(near & value.isNotNull()) >= 2, F.regr_slope(F.when(near, value), F.when(near, recency.cast("double"))))


def smoothed(total: Column, count: Column, prior: float, strength: float) -> Column:
    """(total + strength * prior) / (count + strength); null where the total is."""
    return (total + F.lit(strength * prior)) / (count + F.lit(strength))


# ------------------------------------------------ the same over arrays


def array_sum(recent: str, field: str, limit: int) -> Column:
    """Sum of a field over the first `limit` elements; null without a non-null value."""
    near = F.filter(F.transform(F.slice(recent, 1, limit), lambda e: e[field].cast("double")), lambda v: v.isNotNull())
    return F.when(F.size(near) > 0, F.aggregate(near, F.lit(0.0), lambda a, v: a + v))


def array_ewma(recent: str, field: str, limit: int, decay: float = DECAY) -> Column:
    pairs = F.filter(F.transform(F.slice(recent, 1, limit), lambda e, i: F.struct(e[field].cast("double").alias("v"), F.exp(F.lit(-decay) * i).alias("w"))), lambda p: p["v"].isNotNull())
    total = F.aggregate(pairs, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d")), lambda a, p: F.struct((a["n"] + p["v"] * p["w"]).alias("n"), (a["d"] + p["w"]).alias("d")))
    return F.when(F.size(pairs) > 0, total["n"] / total["d"])


def array_rate(recent: str, value: str, exposure: str, limit: int, per: float = 90.0) -> Column:
    """per * sum(value) / sum(exposure) over the first `limit` elements whose value is known."""
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("e"))
    near = F.filter(F.slice(recent, 1, limit), lambda x: x[value].isNotNull())
    add = lambda a, x: F.struct((a["v"] + x[value].cast("double")).alias("v"), (a["e"] + F.coalesce(x[exposure].cast("double"), F.lit(0.0))).alias("e"))
    total = F.aggregate(near, zero, add)
    return F.when(F.size(near) > 0, F.lit(per) * total["v"] / F.nullif(total["e"], F.lit(0.0)))


def array_count(recent: str, limit: int, condition: Callable[[Column], Column] | None = None) -> Column:
    """How many of the first `limit` elements there are, or how many meet a condition."""
    near = F.slice(recent, 1, limit)
    return F.size(near if condition is None else F.filter(near, lambda x: F.coalesce(condition(x), F.lit(False)))).cast("bigint")


def array_moments(recent: str, field: str, limit: int) -> Column:
    """Count and sums about the first value (y) and of the recency (x) over the known values, in one pass."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("i", "n", "first", "y", "yy", "x", "xx", "xy")])

    def step(a, e):
        v, x = e[field].cast("double"), a["i"] + 1
        first = F.when(a["n"] == 0, v).otherwise(a["first"])
        d = v - first
        known = F.struct(x.alias("i"), (a["n"] + 1).alias("n"), first.alias("first"), (a["y"] + d).alias("y"), (a["yy"] + d * d).alias("yy"), (a["x"] + x).alias("x"), (a["xx"] + x * x).alias("xx"), (a["xy"] + x * d).alias("xy"))
        return F.when(v.isNull(), F.struct(x.alias("i"), *[a[k].alias(k) for k in ("n", "first", "y", "yy", "x", "xx", "xy")])).otherwise(known)

    return F.aggregate(F.slice(recent, 1, limit), zero, step)


def moments_stddev(m: Column) -> Column:
    """Sample standard deviation from array_moments; null under two values."""
    return F.when(m["n"] >= 2, F.sqrt(F.greatest(F.lit(0.0), (m["yy"] - m["y"] * m["y"] / m["n"]) / (m["n"] - 1))))


def moments_trend(m: Column) -> Column:
    """Slope against recency from array_moments, rising is positive; null under two values."""
    return F.when(m["n"] >= 2, -(m["xy"] - m["x"] * m["y"] / m["n"]) / (m["xx"] - m["x"] * m["x"] / m["n"]))
