"""Records of CSV files as rows, whatever line breaks their values hold, many tasks a file.

A file is read as lines, in splits. Whether a line break lies inside quotes follows from how many quotes
come before it in its file, so one cheap pass finds whether each split has an odd number; summed up over the
splits before, that tells a task how its split begins. A task then puts the lines of a record together;
records that lie across splits come out in pieces, which are few and are put together at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A whole record, the beginning of one, its middle, its end.
_WHOLE, _BEGIN, _MIDDLE, _END = range(4)
_PIECES = T.StructType(
    [
        T.StructField("record", T.StringType()),
        T.StructField("file", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("piece", T.IntegerType()),
    ]
)


def csv_records(spark: SparkSession, path: str, line_end: str) -> DataFrame:
    """``record``: the records of the CSV files at ``path``, without their line ends, in no order.

    Quotes inside quoted values are doubled. Only where some value holds a line end does text leave the JVM.
    """
    lines = spark.read.option("lineSep", line_end).text(path).select(
        F.col("value").alias("record"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    quotes = F.length("record") - F.length(F.translate("record", '"', ""))
    odd = F.count_if(quotes % 2 == 1)
    splits = lines.groupBy("file", "start").agg(odd.alias("odd"))
    if not splits.agg(F.max("odd")).first()[0]:
        return lines.where("record <> ''").select("record")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = splits.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("inside"))
    # A row of three numbers for each split that begins inside quotes.
    inside = inside.where("inside = 1").select("file", "start", F.col("inside").cast("int").alias("inside"))
    known = lines.join(F.broadcast(inside), ["file", "start"], "left").select(
        "record", "file", "start", F.coalesce("inside", F.lit(0)).alias("inside")
    )
    pieces = known.mapInArrow(lambda batches: _pieces(batches, line_end), _PIECES)
    whole = pieces.where((F.col("piece") == _WHOLE) & (F.col("record") != "")).select("record")
    # Within a split, the end of one record comes before the beginning of another.
    order = Window.partitionBy("file").orderBy("start", F.desc("piece"))
    cut = pieces.where(F.col("piece") != _WHOLE).withColumn("nth", F.count_if(F.col("piece") == _BEGIN).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", (-F.col("piece")).alias("back"), "record")))
    joined = cut.groupBy("file", "nth").agg(F.array_join(F.transform(parts, lambda p: p["record"]), line_end).alias("record"))
    return whole.union(joined.select("record"))


def _pieces(batches: Iterator[pa.RecordBatch], line_end: str) -> Iterator[pa.RecordBatch]:
    """Whole records, and the pieces of others, of the splits of a task; their lines come in order."""
    now, state = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start, inside = (batch.column(c).to_numpy() for c in ("file", "start", "inside"))
        new = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        edges = [0, *new.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = (int(file[a]), int(start[a]))
            if key != now:
                if state is not None:
                    yield from state.rest()
                now, state = key, _Split(*key, bool(inside[a]), line_end)
            yield from state.take(batch.column("record").slice(a, b - a))
    if state is not None:
        yield from state.rest()


class _Split:
    """The lines of one split so far: whether they end inside quotes, and the record that is not at its end."""

    def __init__(self, file: int, start: int, inside: bool, line_end: str):
        self.file, self.start, self.inside, self.line_end = file, start, inside, line_end
        self.held: list[str] = []
        self.began = not inside

    def take(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) % 2
        after = (int(self.inside) + np.cumsum(odd)) % 2 == 1
        before = np.concatenate([[self.inside], after[:-1]])
        alone = ~before & ~after
        if alone.any():
            yield self._rows(lines.filter(pa.array(alone)), _WHOLE)
        done: dict[int, list[str]] = {_WHOLE: [], _END: []}
        for i in np.flatnonzero(~alone):
            self.held.append(lines[i].as_py())
            if not before[i]:
                self.began = True
            if not after[i]:
                done[_WHOLE if self.began else _END].append(self.line_end.join(self.held))
                self.held, self.began = [], True
        self.inside = bool(after[-1])
        for piece, records in done.items():
            if records:
                yield self._rows(pa.array(records, pa.string()), piece)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            text = pa.array([self.line_end.join(self.held)], pa.string())
            yield self._rows(text, _BEGIN if self.began else _MIDDLE)

    def _rows(self, records: pa.Array, piece: int) -> pa.RecordBatch:
        n = len(records)
        columns = [records, np.full(n, self.file), np.full(n, self.start), np.full(n, piece, dtype=np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_PIECES.names)
