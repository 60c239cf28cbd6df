"""A corpus pipeline: each stage is one operator of kairoframe.llm over all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoframe.llm import common, language_id, line_dedup, mixing, packing, simhash

#: A text with less than this share of its letters in familiar words is in no learned language.
LEAST_FAMILIAR = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that no learned language fits; a missing lang is filled in."""
    found = language_id.identify(docs, language_id.train(docs))
    kept = found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("familiar") >= LEAST_FAMILIAR))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of three lines and more; a document of which nothing is left goes."""
    found = line_dedup.dedup_lines(docs)
    gone = (F.col("lines_removed") > 0) & (F.trim("text") == "")
    length = F.when(F.col("lines_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return found.filter(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", length).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8)."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents so that sources come to tempered shares."""
    return mixing.mix(docs, alpha=0.7).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents' tokens into windows of 2048; a row for each piece, its ids included."""
    pieces = packing.pack(docs, window=2048, end_id=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language ID", identified),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language ID, SimHash and packing have no SQL form; tests/llm/test_pipeline.py holds every stage, one after the
#: other, against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
