"""Work tables: rows written between two steps of a job and read again, which ends their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all machines of a cluster share.

    Where it is unset, a cluster gets the warehouse and a local master a temporary folder.
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


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a work table: computed once, and a lost executor costs its running tasks only."""
    path = work_path(rows.sparkSession, name)
    rows.write.parquet(path)
    again = rows.sparkSession.read.schema(rows.schema).parquet(path)
    again._work_path = path
    return again


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def release(*tables: DataFrame) -> None:
    """Deletes work tables that nothing reads any more."""
    for rows in tables:
        delete(rows.sparkSession, rows._work_path)


def files_in(spark: SparkSession, folder: str) -> dict[str, float]:
    """Names in a folder with their age in seconds; none where there is no folder."""
    place, files = _place(spark, folder)
    found = files.listStatus(place) if files.exists(place) else []
    return {f.getPath().getName(): time.time() - f.getModificationTime() / 1000 for f in found if not f.getPath().getName().startswith("_")}


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a small file in place as a whole; False where there is one already.

    The file is written beside and renamed, which fails where the target exists.
    """
    place, files = _place(spark, path)
    if files.exists(place):
        return False
    hadoop = spark._jvm.org.apache.hadoop.fs
    draft = hadoop.Path(place.getParent(), f"_draft-{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(draft, place, no_options)
        return True
    except Exception:  # whatever the file system says, a target that is there now means that another was first
        files.delete(draft, False)
        if not files.exists(place):
            raise
        return False
