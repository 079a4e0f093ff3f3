"""Tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: shuffle files go when the query that made them ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the session names none, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = getattr(context, "_tandem_shared", None)
        if named is None:
            named = context._tandem_shared = "file://" + tempfile.mkdtemp(prefix="tandem-shared-")
            context.setCheckpointDir(named)
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tandem-{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tandem_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` stored, once nothing that is still to run reads them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._tandem_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(run: Callable) -> Callable:
    """run, for mapInArrow, which gives the memory that it has freed back to the system once its batches end. Python workers
    are kept for later tasks, all those that a task with several such steps had, and would each hold their largest task's."""

    def trimming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim is not None:
            trim(0)

    return trimming
