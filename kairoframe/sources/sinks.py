"""Sinks: content-addressed snapshots, raw payloads by partition, upserts by rewrite, runs, an archive of samples, and pointers to models."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import simulation
from ..operators.quality import content_digest
from . import versions


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that takes the place of the one before it; a reader sees one or the other."""
    versions.put(spark, path, text, replace=True)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def write_snapshot(df: DataFrame, folder: str, name: str, version: str) -> dict:
    """A snapshot under its content's digest, with a manifest; the same content is written once.

    The digest is of the rows, as Spark's files are not byte-stable.
    """
    spark = df.sparkSession
    row = content_digest(df).first()
    path = f"{folder}/{name}/{row['digest']}"
    manifest = {"name": name, "version": version, "rows": row["rows"], "digest": row["digest"], "schema": hashlib.sha256(df.schema.json().encode()).hexdigest(), "path": path}
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    write_text(spark, f"{folder}/{name}/{row['digest']}.json", json.dumps(manifest, sort_keys=True))
    return manifest


def read_snapshot(spark: SparkSession, manifest: dict) -> DataFrame:
    """A snapshot whose rows still have the manifest's digest."""
    df = spark.read.parquet(manifest["path"])
    row = content_digest(df).first()
    if (row["digest"], row["rows"]) != (manifest["digest"], manifest["rows"]):
        raise ValueError(f"{manifest['path']} is not what its manifest says")
    return df


def write_raw(payloads: DataFrame, folder: str, known: DataFrame | None = None) -> DataFrame:
    """Raw payloads (provider, season, content) by partition, each content of a provider once; gives what was new."""
    hashed = payloads.withColumn("sha256", F.sha2("content", 256))
    fresh = hashed.groupBy("provider", "sha256").agg(F.min_by(F.struct(*payloads.columns), F.struct("season", "content")).alias("row")).select("row.*", "sha256")
    if known is not None:
        fresh = fresh.join(known.select("provider", "sha256"), ["provider", "sha256"], "left_anti")
    fresh.write.mode("append").partitionBy("provider", "season").parquet(folder)
    return fresh


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Archived payloads whose content still has its digest; the check is in the plan and fails the read."""
    held = spark.read.parquet(folder)
    broken = F.raise_error(F.concat(F.lit("archived content is damaged: "), "sha256")).cast("string")
    return held.withColumn("content", F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(broken))


ROWS = "rows"


def merge_into(spark: SparkSession, folder: str, incoming: DataFrame, keys: list[str], guard: str | None = None) -> int:
    """Upserts into a versioned table and gives the new version's number; readers of the old one are not disturbed.

    If another writer is first, the upsert is done again over what it wrote.
    """
    return versions.Store(spark, folder).transact(lambda work: work.upsert(ROWS, incoming, keys, guard))


def current(spark: SparkSession, folder: str) -> DataFrame:
    return versions.Store(spark, folder).read(ROWS)


def delete_where(spark: SparkSession, folder: str, condition: F.Column) -> int:
    """The table without the rows that the condition holds for, as a new version."""
    return versions.Store(spark, folder).transact(lambda work: work.delete(ROWS, condition))


def update_where(spark: SparkSession, folder: str, condition: F.Column, values: dict[str, F.Column]) -> int:
    """The table with those columns set where the condition holds, as a new version."""
    return versions.Store(spark, folder).transact(lambda work: work.update(ROWS, condition, values))


def refresh_where(spark: SparkSession, folder: str, condition: F.Column, rows: DataFrame) -> int:
    """Deletes what the condition holds for and inserts rows, in one version."""
    return versions.Store(spark, folder).transact(lambda work: work.replace_where(ROWS, condition, rows))


def register_model(model, spark: SparkSession, folder: str, name: str, metrics: dict, champion: bool) -> str:
    """Saves a Spark ML model under a version of its own; a champion becomes the one that load_champion gives."""
    version = hashlib.sha256(json.dumps({"name": name, "metrics": metrics, "uid": model.uid}, sort_keys=True).encode()).hexdigest()[:16]
    model.write().overwrite().save(f"{folder}/{name}/{version}")
    write_text(spark, f"{folder}/{name}/{version}.json", json.dumps(metrics, sort_keys=True))
    if champion:
        write_text(spark, f"{folder}/{name}/champion", version)
    return version


def load_champion(spark: SparkSession, folder: str, name: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{folder}/{name}/{read_text(spark, f'{folder}/{name}/champion')}")


def append_run(rows: DataFrame, folder: str, run_id: str) -> None:
    """Rows of a run (predictions, recommendations, explanations) in a partition of their own; the same run again replaces it."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(folder)


def run_job(spark: SparkSession, folder: str, run_id: str, work: Callable[[], DataFrame | None]) -> bool:
    """Does a unit of work and appends its status; a failure is a row (run_id, status, error), not an exception."""
    try:
        work()
        status = ("succeeded", None)
    except Exception as e:  # noqa: BLE001  whatever it was, the run has failed
        status = ("failed", f"{type(e).__name__}: {e}"[:2000])
    spark.createDataFrame([(run_id, *status)], "run_id string, status string, error string").write.mode("append").parquet(folder)
    return status[0] == "succeeded"


SAMPLE_FORMAT = 1


def forecast_keys(fixtures: DataFrame, players: DataFrame, runs: int, block: int, seed: int) -> DataFrame:
    """(match_id, key, expected): the digest of all that a fixture's samples depend on, and how many rows they are."""
    names = [x.split()[0] for x in simulation.PLAYER.split(", ")]
    squads = players.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("squad"))
    told = F.to_json(F.struct(*[x.split()[0] for x in simulation.FIXTURE.split(", ")], "squad", *[F.lit(v).alias(k) for k, v in (("runs", runs), ("block", block), ("seed", seed), ("format", SAMPLE_FORMAT))]))
    return fixtures.join(squads, "match_id").select("match_id", F.sha2(told, 256).alias("key"), (F.size("squad") * F.lit(runs)).cast("bigint").alias("expected"))


def archived_samples(spark: SparkSession, folder: str, fixtures: DataFrame, players: DataFrame, runs: int = 10_000, block: int = 1000, seed: int = 0) -> tuple[DataFrame, int]:
    """Samples of all fixtures, of which only those are simulated that the archive does not hold; and how many were.

    Each call writes one batch and then, read back, its entries (key, batch,
    rows), so a batch that was not finished is never read; an entry whose
    number of rows is wrong counts as missing.
    """
    entry = "key string, batch string, rows bigint"
    listed = lambda: spark.read.schema(entry).parquet(f"{folder}/entries") if exists(spark, f"{folder}/entries") else spark.createDataFrame([], entry)
    wanted = forecast_keys(fixtures, players, runs, block, seed)
    good = lambda: wanted.join(listed(), "key").filter("rows = expected").groupBy("match_id", "key").agg(F.min("batch").alias("batch"))
    missing = wanted.join(good().select("match_id"), "match_id", "left_anti")
    n = missing.count()
    if n:
        batch = uuid.uuid4().hex
        some = lambda df: df.join(missing.select("match_id"), "match_id", "left_semi")
        fresh = simulation.simulate(some(fixtures), some(players), runs, block, seed).join(missing.select("match_id", "key"), "match_id")
        fresh.write.parquet(f"{folder}/samples/batch={batch}")
        counted = spark.read.parquet(f"{folder}/samples/batch={batch}").groupBy("key").agg(F.count("*").alias("rows"))
        counted.select("key", F.lit(batch).alias("batch"), "rows").write.mode("append").parquet(f"{folder}/entries")
    samples = spark.read.schema(f"{simulation.SAMPLE}, key string, batch string").parquet(f"{folder}/samples")
    return samples.join(good().select("key", "batch"), ["key", "batch"], "left_semi"), n
