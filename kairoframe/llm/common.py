"""What the operators of this subpackage share: tables, staging, shipping of code."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch: texts may be megabytes long, so batches stay short.
ROWS_PER_BATCH, BYTES_PER_BATCH = 512, 8 << 20

#: Characters that one vectorised step works on at a time.
CHARS_PER_STEP = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ships this subpackage by value and keeps Arrow batches of texts short.

    Executors of a cluster need not have the package installed.  Spark takes
    the batch bounds from the session only, so they are set there; bounds that
    somebody has set below the ones used here stay.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    for name, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        key = f"spark.sql.execution.arrow.{name}"
        held = spark.conf.get(key).removesuffix("b")
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where the session names none, a folder of this machine will do only if
    everything runs on it; with executors elsewhere that is an error, as each
    of them would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master})")
        folder = f"file://{tempfile.mkdtemp(prefix='kairoframe-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders that this process has staged and not released, by session application.
_staged: dict[str, set[str]] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which `release` or `release_all` deletes."""
    path = f"{shared_folder(spark)}/kairoframe/{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back.

    This cuts the lineage at a table that outlives any executor.  Results are
    lazy and read these tables, so they stay until `release_all`; a table that
    a later staged one has made unnecessary is released at once.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kairoframe_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_kairoframe_path", None)
        if path is not None:
            _delete(df.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Deletes all that this application has staged; call it when the results have been written."""
    for path in list(_staged.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _staged.get(spark.sparkContext.applicationId, set()).discard(path)


def process_cache() -> dict:
    """A dictionary that lives as long as the Python worker, not just a task."""
    module = sys.modules.setdefault("_kairoframe_process_cache", types.ModuleType("_kairoframe_process_cache"))
    return module.__dict__.setdefault("entries", {})


class Shipped:
    """A broadcast value of a bounded size, pickled by value, as a worker may not have this package."""

    def __init__(self, spark: SparkSession, value: object):
        prepare(spark)
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._name = uuid.uuid4().hex

    @property
    def value(self):
        held = process_cache().setdefault("shipped", {})
        if self._name not in held:
            if len(held) >= 4:
                held.clear()
            held[self._name] = cloudpickle.loads(self._bytes.value)
        return held[self._name]


def by_size(items: Iterable, size: Callable, limit: int = CHARS_PER_STEP) -> Iterator[list]:
    """Consecutive lists of items whose sizes add up to about the limit; no item is split."""
    group, total = [], 0
    for item in items:
        n = size(item)
        if group and total + n > limit:
            yield group
            group, total = [], 0
        group.append(item)
        total += n
    if group:
        yield group


def map_rows(df: DataFrame, function: Callable[[Iterator[list[tuple]]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with rows as tuples in and one dictionary of columns out for each output batch."""
    from pyspark.sql.types import StructType

    prepare(df.sparkSession)
    arrow = _arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (list(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in batches if b.num_rows)
        for out in function(rows):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def hash_share(*columns, seed: str = "") -> F.Column:
    """A number in [0, 1) that depends on the columns' values alone; DuckDB can compute it too."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("~")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))
