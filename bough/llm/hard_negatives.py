"""Hard negatives: rows of another label that score almost as high as a positive.

Rows are put in the order of a Hilbert curve through their vectors and cut into blocks, written as Parquet
with the least and the greatest value of every dimension (zone maps). For an anchor, interval
arithmetic over a block's zones bounds every score in it. A block is read for an anchor only where these bounds
reach a window of scores the anchor still looks for, and only blocks that some anchor of a wave needs are read at all.

Anchors go through the blocks in waves of bounded size; a wave is all that is broadcast. Scores are inner
products of whole numbers, exact in doubles up to 2 ** 52.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.errors import SetupError
from bough.llm.batches import map_arrow
from bough.names import col
from bough.operators.staging import stage, staging_path

#: Rows of a block, bits of the curve for each dimension, and how many bytes of its place are kept.
BLOCK, BITS, PLACE = 1024, 2, 16
#: Anchors of a wave, and bytes of vectors that a wave may have.
WAVE, WAVE_BYTES = 4096, 8 << 20
#: Blocks that are named one by one to the reader.
NAMED = 2000
#: Scores stay within this, exact in doubles and with room for a place in the block; below it is no score.
_EXACT = 1 << 52
_NONE = -(1 << 52)

_BLOCKS = (
    "block long, n int, rows binary, ids binary, labels binary, cells binary, low array<long>, high array<long>, "
    "at array<int>, fifth array<long>"
)
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: int = 256,
    block: int = BLOCK,
    wave: int = WAVE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component x counts as floor(scale * x), and a score is the inner product with the anchor. Higher scores
    come first, then smaller ids. Positives of an anchor (rows for which ``is_anchor``, a condition on
    ``id_col``, holds) are its first ``positives`` other rows of the same label; for each, its first
    ``negatives`` rows of another label are returned whose score is within ``window`` percent of the
    positive's. Fewer are returned where there are fewer.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Missing components
    of shorter vectors count as zero. Rows that share an id stay apart. An empty table gives no rows.
    Scores that could pass 2 ** 52 are an error.
    """
    spark = df.sparkSession
    rows = stage(_whole(df, is_anchor, id_col, vector_col, label_col, scale), "negatives-rows")
    ends = rows.agg(
        F.max(F.size("vector")).alias("size"),
        F.min(F.array_min("vector")).alias("low"),
        F.max(F.array_max("vector")).alias("high"),
        F.count(F.lit(1)).alias("rows"),
    ).first()
    if not ends.rows:
        return spark.createDataFrame([], _RESULT)
    size, low, high = max(1, ends.size), ends.low or 0, ends.high or 0
    if max(abs(low), abs(high)) ** 2 * size >= _EXACT:
        raise SetupError(f"scores of '{vector_col}' could pass 2 ** 52")
    blocks = stage(_blocks(rows, size, (low, high), min(block, BLOCK), positives), "negatives-blocks")
    anchors = stage(_anchors(blocks, size), "negatives-anchors")
    path = staging_path(spark, "negatives")
    spark.createDataFrame([], _RESULT).write.parquet(path)
    for part in _waves(anchors, min(wave, max(1, WAVE_BYTES // (8 * size)))):
        asked = [(r.row, r.id, r.label, r.cells, r.fifth) for r in part.collect()]
        goals = _Goals.of_anchors(asked, size)
        best = _ranked(_scan(blocks, goals, positives, True, size), positives).collect()
        goals = goals.windows(best, window)
        found = _ranked(_scan(blocks, goals, negatives, False, size), negatives)
        found.select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(path)
    return spark.read.schema(_RESULT).parquet(path)


def _whole(df: DataFrame, is_anchor: Column, id_col, vector_col, label_col, scale: int) -> DataFrame:
    """``id, label, vector, anchor`` of the rows that take part, components as whole numbers."""
    named = df.select(
        col(id_col).cast("long").alias("id"),
        col(label_col).cast("long").alias("label"),
        col(vector_col).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    usable = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    cells = F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return named.where("id is not null and label is not null and vector is not null").where(usable).withColumn("vector", cells)


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Where on a Hilbert curve through all dimensions the rows of ``cells`` (from 0, below 2 ** bits) lie.

    A row of bytes each, most significant first. Rotations and reflections of the cells are undone from the
    coarsest bit down, then the Gray code, for all rows at once.
    """
    x = cells.astype(np.uint32).T.copy()
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        low = q - np.uint32(1)
        for row in x:
            turn = (row & q) != 0
            swap = np.where(turn, 0, (x[0] ^ row) & low).astype(np.uint32)
            x[0] ^= np.where(turn, low, swap)
            row ^= swap
        q >>= np.uint32(1)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    gray, q = np.zeros(x.shape[1], dtype=np.uint32), np.uint32(1 << (bits - 1))
    while q > 1:
        gray ^= np.where(x[-1] & q, q - np.uint32(1), 0).astype(np.uint32)
        q >>= np.uint32(1)
    x ^= gray
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows of one matrix, shorter ones filled with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.zeros((len(vectors), size), dtype=np.int64)
    found[np.arange(size)[None, :] < lengths[:, None]] = flat
    return found


def _blocks(rows: DataFrame, size: int, ends: tuple[int, int], block: int, positives: int) -> DataFrame:
    """Rows in the order of the curve, a block in each record.

    A block's anchors are known by their place, each with the score of its last positive if the block
    were all there is: no worse one is ever needed.
    """
    step = max(1, -(-(ends[1] - ends[0] + 1) // (1 << BITS)))
    fields = {"id": T.LongType(), "label": T.LongType(), "vector": T.ArrayType(T.LongType()), "anchor": T.BooleanType()}
    placed = T.StructType([*[T.StructField(k, v) for k, v in fields.items()], T.StructField("place", T.BinaryType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if batch.num_rows:
                cells = (_matrix(batch.column("vector"), size) - ends[0]) // step
                at = hilbert_places(cells, BITS)[:, :PLACE]
                yield {**{k: batch.column(k) for k in fields}, "place": [p.tobytes() for p in at]}

    curved = map_arrow(rows, place, placed)
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tie = F.xxhash64("id", "label", "vector")
    ordered = curved.repartitionByRange(parts, "place", "id", tie).sortWithinPartitions("place", "id", tie)
    numbered = ordered.withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, rows_held, done, part = [], 0, 0, 0
        for batch in batches:
            while batch.num_rows:
                part = batch.column("part")[0].as_py()
                take = min(block - rows_held, batch.num_rows)
                held.append(batch.slice(0, take))
                rows_held += take
                batch = batch.slice(take)
                if rows_held == block:
                    yield _record(held, (part << 24) + done, size, positives)
                    held, rows_held, done = [], 0, done + 1
        if held:
            yield _record(held, (part << 24) + done, size, positives)

    return map_arrow(numbered, cut, T.StructType.fromDDL(_BLOCKS))


def _record(held: list[pa.RecordBatch], number: int, size: int, positives: int) -> dict:
    table = pa.Table.from_batches(held).combine_chunks()
    ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
    cells = np.concatenate([_matrix(b.column("vector"), size) for b in held])
    # In the order of ids, so that a place in the block settles ties.
    order = np.argsort(ids, kind="stable")
    ids, labels, cells = ids[order], labels[order], cells[order]
    at = np.flatnonzero(np.concatenate([b.column("anchor").to_numpy(zero_copy_only=False) for b in held]).astype(bool)[order])
    scores = (cells[at].astype(np.float64) @ cells.T.astype(np.float64)).astype(np.int64)
    alike = labels[at][:, None] == labels[None, :]
    alike[np.arange(len(at)), at] = False
    scores[~alike] = _NONE
    fifth = np.full(len(at), _NONE)
    if len(at) and len(ids) >= positives:
        fifth = -np.partition(-scores, positives - 1, axis=1)[:, positives - 1]
    numbers = number * BLOCK + np.arange(len(ids))
    return {
        "block": [number],
        "n": [len(ids)],
        "rows": [numbers.tobytes()],
        "ids": [ids.tobytes()],
        "labels": [labels.tobytes()],
        "cells": [cells.tobytes()],
        "low": [cells.min(axis=0).tolist()],
        "high": [cells.max(axis=0).tolist()],
        "at": [at.tolist()],
        "fifth": [fifth.tolist()],
    }


def _longs(held: bytes) -> np.ndarray:
    return np.frombuffer(held, dtype=np.int64)


def _anchors(blocks: DataFrame, size: int) -> DataFrame:
    """``row, id, label, cells, fifth`` of every anchor."""
    schema = T.StructType.fromDDL("row long, id long, label long, cells binary, fifth long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for b in batch.to_pylist():
                at = np.array(b["at"], dtype=np.int64)
                cells = _longs(b["cells"]).reshape(-1, size)[at]
                yield {
                    **{k: _longs(b[c])[at] for k, c in (("row", "rows"), ("id", "ids"), ("label", "labels"))},
                    "cells": [c.tobytes() for c in cells],
                    "fifth": b["fifth"],
                }

    return map_arrow(blocks.where(F.size("at") > 0), work, schema)


def _waves(anchors: DataFrame, most: int) -> Iterator[DataFrame]:
    """Anchors along the curve in parts of about ``most`` at most."""
    count = anchors.count()
    if count <= most:
        if count:
            yield anchors
        return
    parts = -(-2 * count // most)
    shares = [i / parts for i in range(1, parts)]
    ends = anchors.agg(F.percentile_approx("row", shares, 100 * parts)).first()[0]
    bounds = [None, *sorted(set(ends)), None]
    for low, high in zip(bounds, bounds[1:]):
        part = anchors if low is None else anchors.where(F.col("row") > low)
        yield part if high is None else part.where(F.col("row") <= high)


class _Goals:
    """What the anchors of a wave look for: of every goal its anchor, the least and the greatest score of
    use, and the positive it belongs to (before there are positives, the anchor itself)."""

    def __init__(self, rows, ids, labels, cells, anchor, low, high, positive, score):
        self.rows, self.ids, self.labels, self.cells = rows, ids, labels, cells
        self.anchor, self.low, self.high, self.positive, self.score = anchor, low, high, positive, score

    @classmethod
    def of_anchors(cls, asked: list[tuple], size: int) -> "_Goals":
        rows, ids, labels = (np.array([a[i] for a in asked], dtype=np.int64) for i in range(3))
        cells = np.stack([_longs(a[3]) for a in asked]).reshape(-1, size).astype(np.float64)
        fifth = np.array([a[4] for a in asked], dtype=np.int64)
        n = len(asked)
        return cls(rows, ids, labels, cells, np.arange(n), fifth, np.full(n, _EXACT), ids, np.zeros(n, dtype=np.int64))

    def windows(self, best: list, window: tuple[int, int]) -> "_Goals":
        """One goal for each positive whose window of scores holds any."""
        anchor = np.array([b.goal for b in best], dtype=np.int64)
        positive, score = (np.array([b[c] for b in best], dtype=np.int64) for c in ("id", "score"))
        low, high = -(-(window[0] * score) // 100), window[1] * score // 100
        some = np.flatnonzero(low <= high)
        chosen = (x[some] for x in (anchor, low, high, positive, score))
        return _Goals(self.rows, self.ids, self.labels, self.cells, *chosen)

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every anchor and block the least and the greatest score that the block's zones admit."""
        up, down = np.maximum(self.cells, 0), np.minimum(self.cells, 0)
        return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _scan(blocks: DataFrame, goals: _Goals, most: int, same: bool, size: int) -> DataFrame:
    """For every goal the ``most`` first rows of each task that reads blocks: ``goal, anchor_id, positive_id,
    positive_score, id, row, score``. ``same`` asks for rows of the anchor's label, else of the others."""
    held = blocks.sparkSession.sparkContext.broadcast(goals)
    needed = stage(_needed(blocks, held), "negatives-needed")
    count = needed.count()
    if count <= NAMED:
        read = blocks.where(F.col("block").isin([r.block for r in needed.collect()]))
    else:
        read = blocks.join(needed, "block", "left_semi")
    schema = T.StructType.fromDDL(
        "goal long, anchor_id long, positive_id long, positive_score long, id long, row long, score long"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        goals = held.value
        tops = _Tops(len(goals.anchor), most)
        for batch in batches:
            for i in range(batch.num_rows):
                _read(batch.slice(i, 1).to_pylist()[0], goals, tops, same, size)
        at, place = np.nonzero(tops.scores > _NONE)
        who = goals.anchor[at]
        yield {
            "goal": at,
            "anchor_id": goals.ids[who],
            "positive_id": goals.positive[at],
            "positive_score": goals.score[at],
            "id": tops.ids[at, place],
            "row": tops.rows[at, place],
            "score": tops.scores[at, place],
        }

    columns = ("block", "rows", "ids", "labels", "cells", "low", "high")
    return map_arrow(read.select(*columns), work, schema)


def _needed(blocks: DataFrame, held) -> DataFrame:
    """The blocks whose zones reach a score that some goal can use; only zones are read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        goals = held.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                low, high = (np.array(part.column(c).to_pylist(), dtype=np.float64) for c in ("low", "high"))
                least, greatest = (x[goals.anchor] for x in goals.bounds(low, high))
                use = ((greatest >= goals.low[:, None]) & (least <= goals.high[:, None])).any(axis=0)
                yield {"block": part.column("block").filter(pa.array(use))}

    return map_arrow(blocks.select("block", "low", "high"), work, T.StructType.fromDDL("block long"))


class _Tops:
    """The first rows of every goal so far, best first."""

    def __init__(self, goals: int, most: int):
        self.scores = np.full((goals, most), _NONE, dtype=np.int64)
        self.ids = np.zeros((goals, most), dtype=np.int64)
        self.rows = np.zeros((goals, most), dtype=np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """``scores`` has a row for each goal of ``at`` and a column for each row of a block in the order of ids."""
        better = scores.max(axis=1) > _NONE
        at, scores = at[better], scores[better]
        if not len(at):
            return
        most, n = self.scores.shape[1], scores.shape[1]
        placed = scores * n + (n - 1 - np.arange(n))
        first = np.argpartition(-placed, min(most, n) - 1, axis=1)[:, :most]
        names = ("scores", "ids", "rows")
        new = (np.take_along_axis(scores, first, axis=1), ids[first], rows[first])
        all_ = [np.concatenate([getattr(self, k)[at], x], axis=1) for k, x in zip(names, new)]
        order = np.lexsort((all_[2], all_[1], -all_[0]), axis=1)[:, :most]
        for k, x in zip(names, all_):
            getattr(self, k)[at] = np.take_along_axis(x, order, axis=1)


def _read(b: dict, goals: _Goals, tops: _Tops, same: bool, size: int) -> None:
    """Lets the goals have the rows of one block that they can use."""
    ids, rows, labels = (_longs(b[c]) for c in ("ids", "rows", "labels"))
    cells = _longs(b["cells"]).reshape(-1, size).astype(np.float64)
    least, greatest = goals.bounds(*(np.array([b[c]], dtype=np.float64) for c in ("low", "high")))
    floor = np.maximum(goals.low, tops.scores[:, -1])
    wanted = np.flatnonzero((greatest[goals.anchor, 0] >= floor) & (least[goals.anchor, 0] <= goals.high))
    for begin in range(0, len(wanted), 512):
        at = wanted[begin : begin + 512]
        who, where = np.unique(goals.anchor[at], return_inverse=True)
        scores = (goals.cells[who] @ cells.T).astype(np.int64)
        use = (labels[None, :] == goals.labels[who][:, None]) == same
        if same:
            use &= rows[None, :] != goals.rows[who][:, None]
        scores[~use] = _NONE
        scores = scores[where]
        scores[(scores < floor[at][:, None]) | (scores > goals.high[at][:, None])] = _NONE
        tops.add(at, scores, ids, rows)


def _ranked(found: DataFrame, most: int) -> DataFrame:
    first = Window.partitionBy("goal").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
