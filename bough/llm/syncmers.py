"""Document fingerprints from closed syncmers.

A run of K code points is a closed syncmer when the least of the hashes of its inner runs of S
code points lies at its first or last place. Whether it does depends on the run alone, so the same
passage gives the same anchors in every text. K is 16 and S 5; texts of under 64 code points, which
have hardly any such runs, use shorter ones. A fingerprint holds the ``SKETCH`` anchors
of the whole text with the least hashes and their places; it has the same size for any text. Two
fingerprints are compared on the least hashes of both together: anchors that both have count if they
can be matched in the same order in both texts. Fingerprints of different scales have no anchor in
common; texts are at hand in ``edit_trial``, which compares such two on the scale of the shorter one.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.llm.batches import id_and_text, id_type, map_arrow, slices
from bough.operators.staging import stage

#: K and S, and the code points below which a text has too few such runs for its own scale.
SCALES = [(4, 2, 16), (8, 3, 64), (16, 5, None)]
SKETCH = 32

_PRINT = np.dtype([("hash", "<u4"), ("place", "<u4")])
_EMPTY = np.zeros(0, dtype=_PRINT)


def scale(length: int) -> int:
    """Which of ``SCALES`` a text of so many code points has."""
    return next(i for i, (_, _, below) in enumerate(SCALES) if below is None or length < below)


def anchors(points: np.ndarray, at: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the closed syncmers among code points, on the text's own scale or that
    of number ``at``; a text without one is an anchor as a whole, the empty text has none."""
    k, s, _ = SCALES[scale(len(points)) if at is None else at]
    n = len(points) - k + 1
    if n > 0:
        inner = _joined([points[i : i + len(points) - s + 1] for i in range(s)])
        least = _sliding_least(inner, k - s + 1)
        closed = np.flatnonzero((inner[:n] == least) | (inner[k - s : k - s + n] == least))
        if len(closed):
            steps = [*range(0, k - s, s), k - s]
            return _joined([inner[closed + i] for i in steps]), closed
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    digest = sha256(points.astype("<u4").tobytes()).digest()[:8]
    return np.frombuffer(digest, "<u8"), np.zeros(1, np.int64)


def sketch(text: str) -> np.ndarray:
    """The fingerprint of a text as an array of (hash, place), ascending by hash."""
    return _sketch(_points(text))


def _sketch(points: np.ndarray, at: int | None = None) -> np.ndarray:
    hashes, places = anchors(points, at)
    # An anchor that comes again counts again, as its second, third and so on occurrence.
    order = np.argsort(hashes, kind="stable")
    hashes, places = hashes[order], places[order]
    new = np.diff(hashes, prepend=hashes[:1] + np.uint64(1)) != 0
    before = np.arange(len(hashes)) - np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0))
    again = np.flatnonzero(before)
    hashes[again] = _joined([hashes[again], before[again].astype(np.uint64)])
    least, first = np.unique((hashes >> np.uint64(32)).astype(np.uint32), return_index=True)
    out = np.zeros(min(SKETCH, len(least)), dtype=_PRINT)
    out["hash"] = least[:SKETCH]
    out["place"] = places[first[:SKETCH]]
    return out


def packed(print_: np.ndarray) -> str:
    return base64.b64encode(print_.tobytes()).decode()


def unpacked(print_: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(print_), dtype=_PRINT)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1 how much of two texts is the same passages in the same order."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a["hash"], b["hash"])
    if SKETCH in (len(a), len(b)):  # beyond its last hash a full sketch says nothing
        both = both[:SKETCH]
    common = np.intersect1d(a["hash"], b["hash"], assume_unique=True)
    common = common[common <= both[-1]]
    if not len(common):
        return 0.0
    there = b["place"][np.searchsorted(b["hash"], common)]
    here = a["place"][np.searchsorted(a["hash"], common)]
    chain: list[int] = []  # longest run of places that ascend in both
    for _, place in sorted(zip(here.tolist(), there.tolist())):
        at = bisect_left(chain, place)
        chain[at : at + 1] = [place]
    shared = len(chain) / len(both)
    return 2 * shared / (1 + shared)


def text_likeness(a: str, b: str, a_print: np.ndarray | None = None, b_print: np.ndarray | None = None) -> float:
    """``likeness`` of two texts on the scale of the shorter one, where their own scales differ.

    The fingerprints on the texts' own scales may be given.
    """
    x, y = scale(len(a)), scale(len(b))
    if x == y:
        return likeness(sketch(a) if a_print is None else a_print, sketch(b) if b_print is None else b_print)
    return likeness(_sketch(_points(a), min(x, y)), _sketch(_points(b), min(x, y)))


def likeness_of(a: Column | str, b: Column | str) -> Column:
    """``likeness`` of two columns of packed fingerprints; null where either is null. It is 0 where
    their texts have different scales, for which ``text_likeness`` needs the texts."""

    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(
            [None if p is None or q is None else likeness(unpacked(p), unpacked(q)) for p, q in zip(x, y)],
            dtype="float64",
        )

    return compare(a, b)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` (text) of every row; a null text is empty, whose fingerprint
    is the empty string. Repeated rows are kept; an empty table gives no rows."""
    source = id_and_text(df, id_col, text_col)
    schema = T.StructType(
        [T.StructField(id_col, id_type(source)), T.StructField("fingerprint", T.StringType())]
    )

    def work(batches):
        for piece in slices(batches):
            prints = [packed(sketch(t)) for t in piece.column("text").to_pylist()]
            yield {id_col: piece.column("id"), "fingerprint": prints}

    return map_arrow(source, work, schema)


def edited(text: str, donor: str) -> str:
    """The text with its last half replaced by as much of the donor's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + donor[:half]


def edit_trial(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint against that of an edited text and of the next document.

    The next document follows in ascending ``id_col`` (nulls first, equal ids by a hash of the
    text), the first follows the last, and ``edited`` says what becomes of the text. Returns the
    id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``
    and ``near_next``. A null text is empty; an empty table gives no rows.

    Texts are range sorted once, and every task compares neighbours. The last document of a task
    needs the first of the next task: those few are written beside the results and joined.
    """
    source = id_and_text(df, id_col, text_col)
    ordered = source.orderBy(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    # Fingerprints stay bytes while they are written, which is smaller than their text.
    result = [
        T.StructField(id_col, id_type(source)),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.BinaryType()),
        T.StructField("edited_fingerprint", T.BinaryType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
    names = [f.name for f in result]
    edges = [T.StructField(n, T.StringType()) for n in ("first:", "last:")] + [T.StructField("task:", T.IntegerType())]

    def work(batches):
        task = TaskContext.get().partitionId()
        before = None
        for piece in slices(batches):
            out = {f.name: [] for f in (*result, *edges)}

            def put(row, **edge):
                for name, value in zip(names, row):
                    out[name].append(value)
                for f in edges:
                    out[f.name].append(edge.get(f.name))

            for id_, text in zip(piece.column("id").to_pylist(), piece.column("text").to_pylist()):
                now = (id_, text, sketch(text))
                if before is None:
                    put([None] * len(names), **{"first:": text, "task:": task})
                else:
                    put(_compared(*before, *now[1:]))
                before = now
            yield out
        if before is not None:
            yield {f.name: [None] for f in result} | {
                id_col: [before[0]], "first:": [None], "last:": [before[1]], "task:": [task]
            }

    written = stage(map_arrow(ordered, work, T.StructType([*result, *edges])), "edit-trial")
    first = written.where("`first:` is not null").select(F.col("task:").alias("next:"), "first:")
    last = written.where("`last:` is not null").select("task:", F.col(id_col).alias("id"), "last:")
    # One row per task, without the texts.
    every = Window.orderBy("task:")
    follow = first.select(F.col("next:").alias("task:")).select(
        "task:",
        F.coalesce(F.lead("task:").over(every), F.min("task:").over(every)).alias("next:"),
    )
    pairs = last.join(follow, "task:").join(first, "next:").select("id", "last:", "first:")

    def finish(batches):
        for piece in batches:
            rows = [
                _compared(id_, text, sketch(text), donor, sketch(donor))
                for id_, text, donor in zip(*(piece.column(i).to_pylist() for i in range(3)))
            ]
            if rows:
                yield dict(zip(names, map(list, zip(*rows))))

    done = written.where("`task:` is null").select(*[F.col(f"`{n}`") for n in names])
    both = done.union(map_arrow(pairs, finish, T.StructType(result)))
    # As packed() gives them: in one line.
    named = {c: F.translate(F.base64(c), "\r\n", "") for c in ("fingerprint", "edited_fingerprint")}
    return both.withColumns(named)


def _compared(id_, text: str, print_: np.ndarray, donor: str, donor_print: np.ndarray) -> tuple:
    other = edited(text, donor)
    other_print = print_ if other == text else sketch(other)
    return (
        id_, len(text), sha256(other.encode()).hexdigest(), print_.tobytes(), other_print.tobytes(),
        text_likeness(text, other, print_, other_print), text_likeness(text, donor, print_, donor_print),
    )


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for the values that stand side by side in several arrays."""
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for part in parts:
        out += part
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x
