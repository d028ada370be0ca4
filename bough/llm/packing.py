"""Packing token sequences into as few fixed-length training sequences as possible.

Only how many pieces there are of every length matters for the plan, and there are at most
``capacity`` lengths, whatever the number of documents. The plan is therefore made on the counts:

1. From the longest length down, look for lengths that fill the rest of a sequence exactly: one
   length equal to the gap, else a pair, else a triple that sums to it. A combination is consumed
   as often as the counts of its lengths allow.
2. What has no exact complement is packed best fit, longest first, again many at a time. Where
   exact fits have used up what these residuals would need, the last ones made are undone and
   their pieces packed with the residuals, if that takes fewer sequences.

The plan is a list of runs: so many pieces of one length, from that rank on, go to these sequences
at that offset. Pieces get their rank among equal lengths by prefix sums over the tasks that wrote
them, so no length, however common, meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.llm.batches import id_and_text, id_type, map_arrow, slices
from bough.llm.encoding import encoder_of
from bough.operators.staging import stage

Pattern = tuple[tuple[int, ...], int]

#: Shares of the exact pairs and triples with which plans are tried; of equals the first is taken.
KEPT = [1, 0.75, 0.5, 0.25, 0.125, 0.0625, 0]


def token_pieces(
    df: DataFrame,
    tokenizer: str,
    capacity: int,
    end_id: int | None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The token ids of every text, cut where a document is longer than ``capacity``.

    Rows of id, ``piece`` (from 0), ``start``, ``length`` and ``ids`` (binary, little-endian
    unsigned 32-bit). Of a long document the first piece takes what full pieces leave over. A null
    text is empty; with no ``end_id`` an empty text has no piece.
    """
    source = id_and_text(df, id_col, text_col)
    schema = T.StructType(
        [
            T.StructField(id_col, id_type(source)),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def cut(batches):
        encoder = encoder_of(tokenizer)
        end = np.array([] if end_id is None else [end_id], "<u4")
        for batch in slices(batches):
            rows, piece, start, length, ids = [], [], [], [], []
            for row, own in enumerate(encoder.ids(batch.column("text"))):
                held = np.concatenate([own.astype("<u4"), end]).tobytes()
                n, at, k = len(held) // 4, 0, 0
                while at < n:
                    step = (n - at - 1) % capacity + 1
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(step)
                    ids.append(held[4 * at : 4 * (at + step)])
                    at, k = at + step, k + 1
            yield {
                id_col: batch.column("id").take(pa.array(rows, pa.int64())),
                "piece": piece, "start": start, "length": length, "ids": ids,
            }

    return map_arrow(source, cut, schema)


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every other column stays.

    Every length is from 1 to ``capacity``. Pieces of a sequence follow one another without a gap
    from offset 0. Which of several equally long pieces goes where is free. An empty table gives
    no rows.
    """
    names = pieces.columns
    held = stage(
        pieces.select(
            F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
            F.col(f"`{length_col}`").cast("long").alias("length"),
            F.spark_partition_id().alias("task"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "pieces",
    )
    counts = held.groupBy("task", "length").count()
    # At most ``capacity`` rows.
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    if total and not (1 <= min(total) and max(total) <= capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    tables = plan_runs(plan(total, capacity))

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("task", "length").orderBy("place")
    ranked = held.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["task", "length"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for x in np.unique(lengths):
            firsts, bases, offsets = tables[int(x)]
            own = np.flatnonzero(lengths == x)
            run = np.searchsorted(firsts, ranks[own], side="right") - 1
            sequence[own] = bases[run] + ranks[own] - firsts[run]
            offset[own] = offsets[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.select("row", place("length", F.col("base") + F.col("rank")).alias("at"))
    return placed.select(*[F.col(f"row.`{c}`") for c in names], "at.sequence_id", "at.offset")


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns (lengths side by side) and how many sequences follow each."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[Pattern] = []
    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1  # so that the complement counts on what is left
            rest = complement(left, capacity - length)
            left[length] += 1
            if rest is None:
                break
            lengths = (length, *rest)
            used = {x: lengths.count(x) for x in lengths}
            times = min(int(left[x]) // n for x, n in used.items())
            for x, n in used.items():
                left[x] -= times * n
            patterns.append((lengths, times))
    # Pairs and triples use up short lengths; singles cannot be bettered.
    singles = [p for p in patterns if len(p[0]) <= 2]
    several = [p for p in patterns if len(p[0]) > 2]
    plans = []
    for share in KEPT:
        kept = int(len(several) * share)
        again = left.copy()
        for lengths, times in several[kept:]:
            np.add.at(again, list(lengths), times)
        plans.append(singles + several[:kept] + best_fit(again, capacity))
    return min(plans, key=lambda patterns: sum(times for _, times in patterns))


def complement(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three of the lengths that are left and sum to ``gap``; large ones first."""
    if gap == 0:
        return ()
    if left[gap]:
        return (gap,)
    pair = _pair(left, gap)
    if pair:
        return pair
    for first in np.flatnonzero(left[:gap])[::-1]:
        if 3 * first < gap:
            break
        left[first] -= 1
        pair = _pair(left, gap - int(first), int(first))
        left[first] += 1
        if pair:
            return (int(first), *pair)
    return None


def _pair(left: np.ndarray, total: int, most: int | None = None) -> tuple[int, int] | None:
    """Two lengths that sum to ``total``, the larger as large as it can be, up to ``most``."""
    low, high = (total + 1) // 2, min(total - 1, most or total)
    if high < low:
        return None
    larger = left[low : high + 1] > 0
    smaller = left[total - high : total - low + 1][::-1] > 0
    both = larger & smaller
    if total % 2 == 0 and both[0] and left[low] < 2:
        both[0] = False
    found = np.flatnonzero(both)
    return (low + int(found[-1]), total - low - int(found[-1])) if len(found) else None


def best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit, longest first, where all sequences of a pattern are filled together."""
    open_: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = next((g for g in range(length, capacity) if open_.get(g)), None)
            if gap is None:
                each = capacity // length
                for k, times in ((each, n // each), (n % each, 1)):
                    if k and times:
                        open_.setdefault(capacity - k * length, []).append([(length,) * k, times])
                break
            lengths, times = open_[gap].pop()
            took = min(n, times)
            if took < times:
                open_[gap].append([lengths, times - took])
            open_.setdefault(gap - length, []).append([(*lengths, length), took])
            n -= took
    return [(lengths, times) for group in open_.values() for lengths, times in group]


def plan_runs(patterns: Iterable[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every length the first rank, first sequence and offset of its runs, ranks ascending."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rank = used.get(x, 0)
            runs.setdefault(x, []).append((rank, sequence, offset))
            used[x] = rank + times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in runs.items()}
