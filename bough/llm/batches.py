"""Walking Arrow batches inside tasks in pieces whose size is bounded by bytes, not by rows."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.names import col

SLICE_BYTES = 4 << 20
#: Bytes that go to Python at once where :func:`little_at_a_time` was called.
BATCH_BYTES = 1 << 20
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under names that no other column can clash with.

    A null text is the empty text.
    """
    return df.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` holds about ``most`` bytes in each."""
    for batch in batches:
        held = batch.column(batch.schema.get_field_index(column)).nbytes
        rows = batch.num_rows
        if held <= most or rows <= 1:
            if rows:
                yield batch
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin, size = 0, 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        yield batch.slice(begin)


def little_at_a_time(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From here on the session hands Python batches that end once they hold so many bytes.

    A batch is made outside the heap, in vectors and a stream that double as they fill, twice over while they grow.
    Once the C library has seen blocks of tens of MB come and go, it keeps as much free memory at the end of every
    thread's pool, so an executor grows long after the batch is gone. Batches are handed over when a result is
    written, so the setting stays; a lower one of the session's is left alone. Results do not depend on it.
    """
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", spark.conf.get(_BYTES_SETTING).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > most:
        spark.conf.set(_BYTES_SETTING, str(most))


@contextmanager
def rows_at_a_time(spark: SparkSession, most: int):
    """Jobs that run in the block hand Python at most so many rows at once.

    A batch is made outside the heap, in vectors that double as they fill, so long texts by the ten thousand cost
    an executor many times what :func:`slices` then holds.
    """
    before = spark.conf.get(_ROWS_SETTING, None)
    now = int(spark.conf.get(_ROWS_SETTING))
    spark.conf.set(_ROWS_SETTING, min(now, most) if now > 0 else most)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ROWS_SETTING)
        else:
            spark.conf.set(_ROWS_SETTING, before)


def map_arrow(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: T.StructType
) -> DataFrame:
    """``mapInArrow`` for work that yields a dict of columns for each piece of its input.

    Workers outlive their tasks, so a task that ends gives back the memory it no longer holds.
    """
    arrow = to_arrow(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays(
                [_array(columns[f.name], f.type) for f in arrow], schema=arrow
            )
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Returns the free memory of a Python worker to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # not glibc


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def id_type(df: DataFrame, name: str = "id") -> T.DataType:
    return df.schema[name].dataType


def text_key(text: Column | str) -> list[Column]:
    """128 bits that stand for a text: two hashes under different seeds."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
