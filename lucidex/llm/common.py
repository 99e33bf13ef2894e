"""What the operators of this subpackage share: word splitting, work tables, settings."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: While a step is written: its shuffle files go when it is done, and Arrow batches are bounded in
#: bytes, so a run of very long texts does not fill a worker.
STEP_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def whole_text(column: str | Column = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a step."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Where work tables go: the folder in ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) gets a temporary folder and a cluster the warehouse,
    which its machines share too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lucidex-work"
    if context.applicationId not in _own_folders:
        made = tempfile.mkdtemp(prefix="lucidex-work-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own_folders[context.applicationId] = made
    return _own_folders[context.applicationId]


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def step_settings(batch_bytes: int | None = None) -> dict[str, str]:
    """:data:`STEP_SETTINGS`, with another bound of an Arrow batch where one is given."""
    return STEP_SETTINGS | ({"spark.sql.execution.arrow.maxBytesPerBatch": str(batch_bytes)} if batch_bytes else {})


def saved(rows: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """The rows written to a work table and read again, which ends their lineage.

    A lost executor then costs its running tasks only, and a step that two others read runs once.
    """
    spark = rows.sparkSession
    path = work_path(spark, name)
    with settings(spark, step_settings(batch_bytes)):
        rows.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(rows.schema).parquet(path)
    again._work_path = path
    return again


def release(*tables: DataFrame) -> None:
    """Deletes work tables that :func:`saved` returned and nothing reads any more."""
    for rows in tables:
        spark = rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(rows._work_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """At the end of a task: memory that its worker holds and doesn't use, as the worker waits for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
