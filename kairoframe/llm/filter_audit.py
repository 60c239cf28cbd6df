"""Filter interaction audit: what each of five filters removes in each of the 120 orders they can be applied in.

A document's failures are five bits.  Applied in some order, the filter that
removes it is the first in that order whose bit is set, so a table of 32
failure sets by 120 orders, made once, holds every answer.  Tasks index it
with the failure sets they have counted (`np.bincount`), add up removals by
part, order, step and label, and emit one array for each part; the arrays
are summed by Spark.  Everything else follows from these sums: what fails a
filter is what it removes when it comes first, what fails it alone is what it
removes when it comes last.

Plan: texts are read once, in a scan that keeps the id, part, four bits and a
128-bit digest; these slim rows are a table in the shared folder.  Repeated
digests are found with partial aggregation and joined back in a merge join
that Spark can split where very many documents share a text.  A task emits
arrays for the parts it has met, early if they become many, so memory does
not depend on how many parts there are.

Defined cases: a null text is empty; a null part is the empty string; a null
id is never a repetition and makes none; rows with equal id and text do not
repeat each other; a document labelled more than once is good (toxic) if any
label says so, and labels without an id or document do not count; bytes that
are not UTF-8 are counted as they are (a continuation byte is no code point);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Parts that a task adds up at a time.
PARTS_HELD = 256


def first_failures() -> np.ndarray:
    """For each failure set and order, the step of the first filter that fails; 0 if none does."""
    table = np.zeros((1 << len(FILTERS), len(ORDERS)), dtype=np.int64)
    bits = np.arange(1 << len(FILTERS))
    for n, order in enumerate(ORDERS):
        for step in range(len(order), 0, -1):
            fails = bits >> FILTERS.index(order[step - 1]) & 1 == 1
            table[fails, n] = step
    return table


def failures(text: bytes) -> int:
    """The bits of the four filters that look at one text alone: A 1, B 2, C 4, D 8."""
    words = text.split()
    codes = np.frombuffer(text, dtype=np.uint8)
    points = len(text) - int(np.count_nonzero((codes & 0xC0) == 0x80))
    capitals = int(np.count_nonzero((codes >= 65) & (codes <= 90)))
    return (
        (len(words) < 100)
        | (100 * len(set(words)) < 80 * len(words)) << 1
        | (100 * capitals > 10 * points) << 2
        | any(c in text for c in b"#$%&*|") << 3
    )


def failing(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, fails): all five bits of every document."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.md5(body)).alias("digest"), body.cast("binary").alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    common.prepare(docs.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.fromiter((failures(x.as_py()) for x in b.column(3)), dtype=np.int32, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bits)], names=["id", "part", "digest", "bits"])

    slim = common.staged(rows.mapInArrow(look, f"id {kind}, part string, digest binary, bits int"), "filter-bits")
    repeated = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = common.staged(repeated, "repeated-texts")
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return slim.join(repeated.hint("merge"), "digest", "left").select("id", "part", (F.col("bits") + F.when(again, 16).otherwise(0)).alias("fails"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order and step with what the step's filter does there; `labels` has `key`, quality and toxic."""
    good, toxic = (F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)) for c in ("quality", "toxic"))
    judged = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg((good + 2 * toxic).alias("label"))
    rows = failing(docs, key, text, part).join(judged.hint("merge"), "id", "left").select("part", "fails", F.coalesce("label", F.lit(0)).alias("label"))
    sums = rows.mapInArrow(removals, "part string, counts array<bigint>")
    cell = sums.select("part", F.posexplode("counts").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n"))
    steps, orders = len(FILTERS) + 1, len(ORDERS)
    order, step, kind = (F.col("at") / steps).cast("int") % orders, F.col("at") % steps, (F.col("at") / (steps * orders)).cast("int")
    named = F.get(F.array(*map(F.lit, ORDERS)), order)
    of = lambda k: F.sum(F.when(kind == k, F.col("n")).otherwise(0))
    per_step = cell.groupBy("part", named.alias("filter_order"), step.alias("step")).agg(of(0).alias("removed"), of(1).alias("good_lost"), of(2).alias("toxic_lost"))
    within = Window.partitionBy("part", "filter_order")
    kept = F.sum("removed").over(within) - F.sum(F.when(F.col("step") > 0, F.col("removed")).otherwise(0)).over(within.orderBy("step"))
    by_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    alone = lambda s: F.max(F.when(F.col("step") == s, F.col("removed"))).over(by_filter)
    return (
        per_step.withColumn("kept", kept)
        .filter("step > 0")
        .select(
            "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed",
            (alone(1) - F.col("removed")).alias("redundant"), alone(len(FILTERS)).alias("unique_fails"),
            "good_lost", "toxic_lost", F.sum("removed").over(by_filter).alias("shapley"),
        )
    )


def removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up (part, fails, label) rows: for each part an array of documents by label (all, good, toxic), order and step."""
    table, steps = first_failures(), len(FILTERS) + 1
    place = np.arange(len(ORDERS)) * steps + table  # of a failure set, in an array of orders and steps
    size = len(ORDERS) * steps
    held: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        arrays = [place_counts(counts, place, size) for counts in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(arrays, pa.list_(pa.int64()))], names=["part", "counts"])

    for b in batches:
        parts = b.column(0).dictionary_encode()
        codes = np.asarray(parts.indices).astype(np.int64) * 128 + np.asarray(b.column(2)).astype(np.int64) * 32 + np.asarray(b.column(1))
        counts = np.bincount(codes, minlength=128 * len(parts.dictionary)).reshape(-1, 4, 32)
        for name, found in zip(parts.dictionary.to_pylist(), counts, strict=True):
            held[name] = held.get(name, 0) + found
        if len(held) >= PARTS_HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def place_counts(counts: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """counts: documents by label bits (good 1, toxic 2) and failure set."""
    chosen = (counts.sum(axis=0), counts[1] + counts[3], counts[2] + counts[3])
    exact = [np.bincount(place.ravel(), np.repeat(n, place.shape[1]), size).astype(np.int64) for n in chosen]
    return np.concatenate(exact)
