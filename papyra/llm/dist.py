"""What every operator here needs from the cluster: shared tables and importable workers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
_written: list[tuple[SparkSession, str, str]] = []


#: Rows and bytes that pass between the JVM and Python at once: long texts make the defaults of 10,000 and 64 MB too much memory.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 16 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package also when the driver runs from another folder, and take fewer rows at once unless the session says how many."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in ("67108864b", "64m", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_AT_ONCE))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


_held: dict[str, object] = {}


def held[T](key: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task: one object, until a task asks for another or lean() lets it go."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def _release() -> None:
    """Give freed memory back: a worker is used again by later stages, and idle ones count against the executor as well."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable, arguments: int = 0, keeps: bool = False) -> Callable:
    """run, for mapInArrow or, with the number of its arguments, applyInArrow; its memory is given back when it ends.

    keeps: it uses what the worker holds; all others let that go first.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _held.clear()
        try:
            yield from run(rows)
        finally:
            _release()

    def group(rows: pa.Table) -> pa.Table:
        _held.clear()
        try:
            return run(rows)
        finally:
            _release()

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        _held.clear()
        try:
            return run(left, right)
        finally:
            _release()

    return (batches, group, pair)[arguments]


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset (tests, a single machine) a temporary folder is set as the session's own; on a cluster that
    would be a folder no other machine sees, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="papyra-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Buckets for each shuffle partition: a few large rows fall less unevenly into more of them.
BUCKETS = 3
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write are deleted when it has ended, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    if before is None:  # another version
        yield
        return
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _place(spark: SparkSession, name: str, table: str = "") -> str:
    path = f"{shared_dir(spark)}/papyra-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path, table))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = _place(spark, name)
    with _shuffle_files_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As stage, in buckets of key: grouped by key, the rows are read where they lie and only what meets them is shuffled."""
    spark = df.sparkSession
    table = f"papyra_{name}_{uuid.uuid4().hex}"
    path = _place(spark, name, table)
    with _shuffle_files_go(spark):
        df.write.bucketBy(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def _clean() -> None:
    for spark, path, table in _written:
        try:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended: its folder goes with the cluster
            return


def named(column: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def apart(docs: DataFrame, keep: list[str] | None) -> tuple[list[str], Column, T.StructType, bool]:
    """For an operator that returns doc, a struct of all columns or those of keep, and reads the column text as a string.

    The names; doc without text, and its type; whether text belongs into doc: then it goes to Python and back once, beside doc.
    """
    names = keep or docs.columns
    back = "text" in names and dict(docs.dtypes)["text"] == "string"
    rest = [c for c in names if not (back and c == "text")]
    return names, F.struct(*map(named, rest)).alias("doc"), docs.select(*map(named, rest)).schema, back


def together(out: DataFrame, names: list[str], back: bool) -> DataFrame:
    """Put text back into doc."""
    if not back:
        return out
    return out.withColumn("doc", F.struct(*(F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in names))).drop("text")


def schema_of(rest: str, **first: T.DataType) -> T.StructType:
    """Columns of given types, then those of rest; names may hold any character."""
    return T.StructType([*(T.StructField(k, v) for k, v in first.items()), *T.StructType.fromDDL(rest).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
