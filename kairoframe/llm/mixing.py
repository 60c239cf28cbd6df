"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

A source's rate is the mean number of copies of each of its documents that
brings it to its share of the mixture.  Each document draws a uniform number
from a hash of (seed, id); the inverse of its source's Poisson distribution
turns that number into a count, the row is exploded by the count, and the
copies are dealt out and sorted by a second hash: a global shuffle.  The draw
depends on nothing but seed, id and rate, so a lost task repeats it exactly.

Without explicit weights the target shares are tempered sizes, size ** alpha:
alpha 1 keeps the corpus as it is, 0 makes all sources equal.

Defined cases: a null source is a source of its own; a null text has size
one, as every text counts its end; a row without an id draws from a hash of
its text; repeated rows draw alike; a source that explicit weights do not name
has weight zero; an empty table gives an empty result; other columns are kept
(columns named copy or shuffle_key are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Up to this many sources the table of rates is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 2_000


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, size_factor: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate): the mixture's expected size is size_factor times that of docs, in characters and ends."""
    size = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)) + 1).cast("double").alias("size"))
    if weights is None:
        weighed = size.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        named = docs.sparkSession.createDataFrame(list(weights.items()), "s string, weight double")
        weighed = size.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighed = common.staged(weighed, "source-sizes")
    total = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["weight"]:
        return weighed.select("source", F.lit(0.0).alias("rate"))
    return weighed.select("source", (F.lit(size_factor * total["size"]) * (F.col("weight") / F.lit(total["weight"])) / F.col("size")).alias("rate"))


def cumulative(rate: str) -> F.Column:
    """Array of P(X <= k) for k from 0 to far beyond the mean, in the order of one recurrence of logarithms."""
    return F.expr(
        f"""CASE WHEN {rate} <= 0 THEN array(1.0D) ELSE
            aggregate(
              sequence(1, cast(ceil({rate} + 12 * sqrt({rate}) + 40) AS int)),
              named_struct('lp', -{rate}, 'cdf', array(exp(-{rate}))),
              (s, k) -> named_struct(
                'lp', s.lp + ln({rate}) - ln(cast(k AS double)),
                'cdf', array_append(s.cdf, element_at(s.cdf, -1) + exp(s.lp + ln({rate}) - ln(cast(k AS double))))),
              s -> s.cdf) END"""
    )


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, size_factor: float = 1.0, seed: int = 1, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs' rows, each as often as drawn, with copy (int, from 1) and shuffle_key (double), in shuffled order."""
    table = common.staged(rates(docs, weights, alpha, size_factor, source, text).select(F.col("source").alias("_source"), cumulative("rate").alias("_cdf")), "rates")
    few = table.count() <= BROADCAST_SOURCES
    own = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    free = "_" * (1 + max(len(c) for c in docs.columns))  # longer than any name of docs, so that none clashes
    own_, of_, u_, n_, cdf_, source_ = (free + c for c in ("own", "of", "u", "n", "cdf", "source"))
    table = table.withColumnsRenamed({"_source": source_, "_cdf": cdf_})
    table = F.broadcast(table) if few else table
    columns = [F.col(f"`{c}`") for c in kept]
    rows = docs.select(*columns, own.alias(own_), F.col(source).alias(of_)).withColumn(u_, common.hash_share(F.col(own_), seed=f"count-{seed}"))
    drawn = rows.join(table, F.col(of_).eqNullSafe(F.col(source_)))
    counted = drawn.select(*columns, own_, F.expr(f"size(filter({cdf_}, c -> c < {u_}))").alias(n_)).filter(F.col(n_) > 0)
    copies = counted.select(*columns, own_, F.explode(F.sequence(F.lit(1), F.col(n_))).alias("copy"))
    mixed = copies.withColumn("shuffle_key", common.hash_share(F.col(own_), F.col("copy"), seed=f"place-{seed}"))
    return mixed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", own_, "copy").drop(own_)
