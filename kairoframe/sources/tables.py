"""Readers of files: Parquet tables, CSV, JSON and delimited text, always with a stated schema or none to guess."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import decimal, role_token


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scoped_parquet(spark: SparkSession, path: str, required: Sequence[str], **scope: str) -> DataFrame:
    """Parquet with snake_case names, the required columns checked and equality predicates pushed to the scan.

    A name that another column already has after renaming gets the prefix
    ``provider_``.
    """
    df = spark.read.parquet(path)
    seen: set[str] = set()
    names = {}
    for c in df.columns:
        new = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c).lower()
        if new in seen:
            new = f"provider_{new}"
        seen.add(new)
        names[c] = new
    df = df.withColumnsRenamed(names)
    require(df, required)
    for c, value in scope.items():
        if c in df.columns:
            df = df.filter(F.col(c) == value)
    return df


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_defaults(df: DataFrame, defaults: dict[str, object], kinds: dict[str, str] | None = None) -> DataFrame:
    """Adds the columns that are missing, with typed constants."""
    kinds = kinds or {}
    new = {c: F.lit(v).cast(kinds.get(c, "double")) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(new) if new else df


def results_csv(spark: SparkSession, path: str, required: Sequence[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header as strings: byte-order mark stripped, required columns checked, rows without them dropped, columns renamed."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    require(df, required)
    for c in required:
        df = df.filter(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) != "")
    return df.withColumnsRenamed(rename or {})


def nested_json(spark: SparkSession, path: str, schema: StructType | str, path_to_rows: Sequence[str]) -> DataFrame:
    """JSON documents with a stated schema; each array on the way to the rows is exploded, empty ones kept as one row."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    current = F.col(path_to_rows[0])
    df = df.withColumn("_row", F.explode_outer(current))
    for step in path_to_rows[1:]:
        df = df.withColumn("_row", F.explode_outer(F.col(f"_row.{step}")))
    return df


def delimited_text(spark: SparkSession, path: str, names: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """Lines of tab, semicolon or comma separated fields; the separator is the one that a line has most of, in that order.

    Blank lines and a header line (whose first field is the first name) go;
    missing fields are null.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).filter(F.trim("line") != "")
    count = lambda s: F.length("line") - F.length(F.replace("line", F.lit(s)))
    cut = F.when((count("\t") >= count(";")) & (count("\t") >= count(",")) & (count("\t") > 0), F.split("line", "\t")).when((count(";") >= count(",")) & (count(";") > 0), F.split("line", ";")).otherwise(F.split("line", ","))
    fields = lines.select(F.transform(cut, lambda x: F.nullif(F.trim(x), F.lit(""))).alias("f"))
    rows = fields.select(*[F.get("f", i).alias(n) for i, n in enumerate(names)])
    rows = rows.filter(F.coalesce(F.lower(F.col(names[0])) != names[0].lower(), F.lit(True)))
    if max_rows is not None and rows.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows in {path}")
    return rows


def roster_csv(df: DataFrame) -> DataFrame:
    """Roster rows of string columns under headers of any case: name (or player), role, team, purchase_price (or price)."""
    by_name = {c.strip().casefold(): c for c in df.columns}
    unknown = sorted(set(by_name) - {"name", "player", "role", "team", "purchase_price", "price"})
    if unknown or not {"name", "player"} & set(by_name):
        raise ValueError(f"unknown columns {unknown}" if unknown else "no column name or player")

    def first(*names: str) -> Column:
        held = [F.nullif(F.trim(F.col(f"`{by_name[n]}`").cast("string")), F.lit("")) for n in names if n in by_name]
        return F.coalesce(*held[:1], F.lit(None).cast("string"))

    return df.select(first("name", "player").alias("name"), first("role").alias("role"), first("team").alias("team"), decimal(first("purchase_price", "price")).alias("price"))


def pasted_rosters(lines: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """Rows of pasted text, line by line: name, roles, team, price and whether a field was not understood.

    The separator is the tab, semicolon or comma that the line has most of;
    roles are split at slashes, semicolons, bars and spaces; a header line (its
    first field is name or nome) is left out.
    """
    count = lambda s: F.length(line) - F.length(F.replace(F.col(line), F.lit(s)))
    most = F.greatest(count("\t"), count(";"), count(","))
    cut = F.when(most == 0, F.array(line)).when(count("\t") == most, F.split(line, "\t")).when(count(";") == most, F.split(line, ";")).otherwise(F.split(line, ","))
    f = lines.select(*keys, F.transform(cut, lambda x: F.nullif(F.trim(x), F.lit(""))).alias("f"))
    tokens = F.filter(F.split(F.coalesce(F.get("f", 1), F.lit("")), r"[/;|\s]+"), lambda t: t != "")
    roles = F.transform(tokens, role_token)
    price = F.get("f", 3)
    value = decimal(F.regexp_replace(price, "[€ ]", ""))
    odd = F.exists(roles, lambda r: r.isNull()) | (price.isNotNull() & value.isNull())
    rows = f.select(*keys, F.get("f", 0).alias("name"), F.array_distinct(F.array_compact(roles)).alias("roles"), F.get("f", 2).alias("team"), value.alias("price"), odd.alias("issue"))
    return rows.filter(F.col("name").isNotNull() & ~F.lower("name").isin("name", "nome"))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a folder of this machine only where all runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master})")
        folder = f"file://{tempfile.mkdtemp(prefix='kairoframe-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders that this process has staged and not released, by application.
_staged: dict[str, set[str]] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends at a table that outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kairoframe/{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, set()).add(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame) -> None:
    """Deletes what `staged` wrote for df, when nothing reads it any more."""
    spark = df.sparkSession
    held = _staged.get(spark.sparkContext.applicationId, set())
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for mine in [p for p in held if path.split(":", 1)[-1].lstrip("/") == p.split(":", 1)[-1].lstrip("/")]:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mine)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            held.discard(mine)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go when it is done, not when the driver's memory is next collected; for results that are written.

    Spark takes this from the session only, so it is set there for the time.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def release_staged(spark: SparkSession) -> None:
    """Deletes what `staged` has written for this application; call it when the results that read it have been written."""
    for path in _staged.pop(spark.sparkContext.applicationId, ()):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
