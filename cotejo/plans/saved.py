"""Intermediate tables in the shared folder, to cut lineage so that lost executors cost little."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: The folder of the run that is going on, if it has one of its own.
_run: ContextVar[str | None] = ContextVar("run", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder below spark.checkpoint.dir.

    Where that is unset a local session, as in tests, gets a folder of its own; a cluster raises
    ValueError, since its executors share no local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cotejo-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/cotejo-{spark.sparkContext.applicationId}"


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder, once, and read back."""
    path = f"{_run.get() or shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """What is saved inside goes to a folder of its own, which is deleted in the end, whatever happens; results that aren't written by then can't be read."""
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)
        _delete(spark, folder)


def clean(spark: SparkSession) -> None:
    """Deletes all that the application saved; results that are read after it fail."""
    _delete(spark, shared_folder(spark))
