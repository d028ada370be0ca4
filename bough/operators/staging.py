"""Written intermediate tables for results that several later plans read, and other small helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.errors import SetupError
from bough.names import col

SETTING = "spark.checkpoint.dir"
_SHUFFLES_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A handful of rows from the driver in one partition, whatever the cluster's parallelism."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def row_hash(df: DataFrame) -> Column:
    """A hash of the plain columns of a row, to tell rows apart that share a sort key."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    return F.xxhash64(*[col(f.name) for f in df.schema if not isinstance(f.dataType, nested)])


def staging_root(spark: SparkSession) -> str:
    """The shared folder that the session names.

    Only a session whose executors are threads of the driver may do without; it gets a temporary
    folder. Other executors could not see one.
    """
    context = spark.sparkContext
    root = spark.conf.get(SETTING, None) or context.getCheckpointDir() or _own_folder.get(context.applicationId)
    if root is None and re.fullmatch(r"local(\[[^\[\]]*\])?", context.master):
        root = _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="bough-")
    if root:
        return root.rstrip("/")
    raise SetupError(f"set {SETTING} to a folder that every executor can reach")


_own_folder: dict[str, str] = {}


def staging_path(spark: SparkSession, label: str) -> str:
    path = f"{staging_root(spark)}/bough/{label}-{uuid.uuid4().hex}"
    for kept in _watching.get():
        kept.append(path)
    return path


#: The blocks of :func:`staged_here` that this thread is in.
_watching: ContextVar[tuple[list[str], ...]] = ContextVar("watching", default=())


@contextmanager
def staged_here(spark: SparkSession):
    """Removes, at the end of the block, what was staged inside it. Results that read it have to
    be written or collected by then. What other threads stage meanwhile is theirs."""
    paths: list[str] = []
    outside = _watching.set((*_watching.get(), paths))
    try:
        yield
    finally:
        _watching.reset(outside)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        settings = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = hadoop(path)
            place.getFileSystem(settings).delete(place, True)


def shuffles_end_with_jobs(spark: SparkSession) -> None:
    """From here on Spark removes what a query of the session shuffled as soon as the query has ended.

    Otherwise such files stay until the driver's garbage collector meets the plan, so those of many
    jobs lie on disk together. Results are written later, so the setting stays; one that the session
    made is left alone. A result that is collected twice is shuffled twice.
    """
    if spark.conf.get(_SHUFFLES_SETTING, None) is None:
        spark.conf.set(_SHUFFLES_SETTING, "true")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage is cut, and a lost executor costs
    nothing that was already written. The schema is passed on, so reading infers nothing."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
