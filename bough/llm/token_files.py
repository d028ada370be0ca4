"""Token ids in flat binary files, with the offsets of the documents beside them.

A set of token files is a folder of shards and a table that names them. A shard has
``*.bin``: the ids of its documents, one after another, as little-endian unsigned integers of 2 or
4 bytes, and ``*.idx``: little-endian 64-bit words, first the number of documents and how many of
them have a null id, then one offset per document and the end (in ids, from the start of the
shard), then the documents' own ids. Documents lie in ascending order of their id over all
shards; nulls come first. The table of shards gives every shard the number of ids and documents
before it, so a global position is a prefix sum plus an offset.

Files are named by task attempt, and only the files of attempts that Spark committed are in the
table: a retried or speculative task leaves at most an unnamed file behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.llm.batches import id_and_text, map_arrow, slices
from bough.llm.encoding import encoder_of
from bough.operators.staging import stage

_SHARD = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
#: Bytes of ids that a reader turns into results at a time.
READ_BYTES = 8 << 20


def write_token_files(
    df: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int | None = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode all texts into token files under ``folder``, a place that every executor reaches.

    Returns the table of shards. ``end_id`` is appended to every document unless it is None. A
    null text is empty, rows that share an id stay apart (in an order by text), an empty table
    gives no shard. ``id_col`` holds integers.
    """
    source = id_and_text(df, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    ordered = source.orderBy(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    run = uuid.uuid4().hex[:12]

    def write(batches):
        files, encoder, offsets, docs, nulls, total = None, None, [0], [], 0, 0
        context = TaskContext.get()
        name = f"{run}-{context.partitionId():06d}-{context.taskAttemptId()}"
        for piece in slices(batches):
            if files is None:
                encoder = encoder_of(tokenizer)
                files = _Folder(folder)
                out = files.create(f"{name}.bin")
            ids = encoder.ids(piece.column("text"))
            end = np.array([] if end_id is None else [end_id], encoder.dtype)
            if end_id is not None and end[0] != end_id:
                raise ValueError(f"the end id {end_id} does not fit the vocabulary")
            for x in ids:
                out.write(x.tobytes() + end.tobytes())
                total += len(x) + len(end)
                offsets.append(total)
            own = piece.column("id")
            nulls += own.null_count
            docs.append(own.fill_null(0).to_numpy(zero_copy_only=False))
        if files is None:
            return
        out.close()
        with files.create(f"{name}.idx") as index:
            index.write(np.array([len(offsets) - 1, nulls], "<i8").tobytes())
            index.write(np.array(offsets, "<i8").tobytes())
            index.write(np.concatenate(docs).astype("<i8").tobytes())
        yield {
            "shard": [context.partitionId()],
            "file": [f"{folder}/{name}"],
            "width": [encoder.dtype.itemsize],
            "n_docs": [len(offsets) - 1],
            "n_tokens": [total],
        }

    shards = stage(map_arrow(ordered, write, _SHARD), "token-shards")
    # One row per task that wrote, so one task can sum them.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select(
        "*",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{x}_before")
          for n, x in (("n_docs", "docs"), ("n_tokens", "tokens"))],
    )


def read_token_files(
    spark: SparkSession,
    shards: DataFrame,
    digest: Callable[[np.ndarray], object] | None = None,
    digest_type: T.DataType | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """Documents of token files: id, ``start`` (ids before it), ``n_tokens`` and ``ids``.

    ``digest`` turns the ids of a document into something smaller than themselves, which then
    stands in ``ids``. Local shards are mapped into memory, others are read in parts.
    """
    kind = digest_type or T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            T.StructField(id_col, T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", kind),
        ]
    )
    digested = digest or (lambda ids: ids.astype(np.int64))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with _Folder.of(row["file"]) as (ids, index):
                    dtype = np.dtype(f"<u{row['width']}")
                    n, nulls = np.frombuffer(index(0, 16), "<i8")
                    words = np.frombuffer(index(16, 8 * (2 * n + 1)), "<i8")
                    offsets, docs = words[: n + 1], words[n + 1 :]
                    begin = 0
                    while begin < n:
                        most = offsets[begin] + READ_BYTES // row["width"]
                        end = max(begin + 1, int(np.searchsorted(offsets, most, "right")) - 1)
                        at, to = (int(offsets[i]) * row["width"] for i in (begin, end))
                        held = np.frombuffer(ids(at, to - at), dtype)
                        cuts = offsets[begin : end + 1] - offsets[begin]
                        yield {
                            id_col: [None if i < nulls else int(docs[i]) for i in range(begin, end)],
                            "start": offsets[begin:end] + row["tokens_before"],
                            "n_tokens": np.diff(cuts),
                            "ids": [digested(held[a:b]) for a, b in zip(cuts, cuts[1:])],
                        }
                        begin = end

    tasks = max(1, shards.count())
    return map_arrow(shards.repartition(tasks), read, schema)


class _Folder:
    """Files under a folder that a path or a URI names, on any file system that Arrow knows."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self._fs, self._path = fs.FileSystem.from_uri(folder)
        self._fs.create_dir(self._path, recursive=True)

    def create(self, name: str):
        return self._fs.open_output_stream(f"{self._path}/{name}")

    class of:
        """The two files of a shard, each as a function from a place and a length to bytes."""

        def __init__(self, name: str):
            from pyarrow import fs

            self._fs, self._path = fs.FileSystem.from_uri(name)
            self._local = isinstance(self._fs, fs.LocalFileSystem)

        def __enter__(self):
            import pyarrow as pa

            paths = [f"{self._path}.{x}" for x in ("bin", "idx")]
            self._open = [pa.memory_map(p) if self._local else self._fs.open_input_file(p) for p in paths]
            return [lambda at, n, f=f: (f.seek(at), f.read_buffer(n))[1] for f in self._open]

        def __exit__(self, *_):
            for f in self._open:
                f.close()
