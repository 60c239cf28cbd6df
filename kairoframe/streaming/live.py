"""Structured Streaming forms of the batch operators: windows with watermarks, sessions, versions of facts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files at a path (a glob works), with the schema that they have."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def tumbling(stream: DataFrame, time: str, width: str, keys: Sequence[str], lateness: str) -> DataFrame:
    """Counts per window and key; rows later than the lateness are dropped once the window is final."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", lateness)
    return timed.groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sliding(stream: DataFrame, time: str, width: str, step: str, keys: Sequence[str], lateness: str) -> DataFrame:
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", lateness)
    return timed.groupBy(F.window("_t", width, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(stream: DataFrame, time: str, gap: str, keys: Sequence[str], lateness: str) -> DataFrame:
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", lateness)
    return timed.groupBy(F.session_window("_t", gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def first_of_each(stream: DataFrame, time: str, keys: Sequence[str], lateness: str) -> DataFrame:
    """Rows whose key has not been seen within the watermark."""
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", lateness).dropDuplicatesWithinWatermark(list(keys)).drop("_t")


def change_points(stream: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Rows at which a key's value changes, with state between batches: the last time and value of each key.

    Rows of a batch are taken in the order of time; a row older than the state
    is late and changes nothing.
    """
    kinds = dict(stream.select(key, time, value).dtypes)
    schema = f"{key} {kinds[key]}, changed_at timestamp, {value} {kinds[value]}"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values([time, value], kind="stable")
        out = []
        for t, v in zip(rows[time], rows[value], strict=True):
            stamp = int(pd.Timestamp(t).value // 1000)
            if at is not None and stamp < at:
                continue
            if v != last:
                out.append((k[0], pd.Timestamp(t), v))
            at, last = stamp, v
        state.update((at, last))
        yield pd.DataFrame(out, columns=[key, "changed_at", value])

    grouped = stream.select(key, F.col(time).cast("timestamp").alias(time), value).groupBy(key)
    return grouped.applyInPandasWithState(run, schema, f"at bigint, last {kinds[value]}", "append", GroupStateTimeout.NoTimeout)


def drain(result: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there now and gives the table that it leaves.

    In complete mode each batch's table replaces the last one; otherwise
    batches append, once each (a batch that runs again replaces itself).
    """
    spark = result.sparkSession
    base = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={batch}")

    result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    out = spark.read.schema(result.schema).parquet(f"{base}/out")
    return out.select(*result.columns)
