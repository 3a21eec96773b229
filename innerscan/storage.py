"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OPEN: ContextVar[list | None] = ContextVar("innerscan_tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='innerscan-')}")
    return jsc.getCheckpointDir().get().rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in :func:`shared_dir`."""
    return f"{shared_dir(spark)}/innerscan/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str = "t") -> str:
    return f"{session_dir(spark)}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: computed once, with a short plan, and safe if executors are lost."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    if (tables := _OPEN.get()) is not None:
        tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, for any scheme that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables of :func:`written` inside are deleted on leaving; results must be saved or collected before."""
    token = _OPEN.set([])
    try:
        yield
    finally:
        tables = _OPEN.get()
        _OPEN.reset(token)
        for path in tables:
            delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table that this application has written; results that still depend on one can't be read after."""
    delete(spark, session_dir(spark))
