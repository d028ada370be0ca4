"""Removal of long byte strings that occur more than once in a corpus.

A suffix array of a whole corpus fits no machine, so its suffixes are first divided in such a way
that equal windows always meet. In every window of ``length`` bytes the string of half that length
with the least hash (the leftmost of equals) is its anchor; which one that is depends on the bytes
of the window alone. Consecutive windows with the same anchor make up an occurrence of it, with the
bytes they span as its context. Then:

* occurrences meet by their anchor, once, and anchors that occur once, which have no repeated window,
  go before anything is written;
* a context that occurs twice consists of repeated windows, which a count shows;
* the distinct contexts of an anchor go to one task, which sorts their suffixes in two stages and
  compares neighbours (``suffix_array``);
* the contexts of an anchor with more than ``GROUP`` of them are divided again, by longer strings of
  least hash, until few meet or the string is the window itself. Nothing is left out.

Texts are told apart by 128 bits of hash, contexts within an anchor by another 64.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.llm.batches import id_and_text, id_type, map_arrow, slices, text_key
from bough.llm.suffix_array import repeated_windows
from bough.names import col
from bough.operators.staging import stage

#: Distinct contexts of an anchor that one task sorts together.
GROUP = 512
#: Bytes of contexts in one suffix array.
ARRAY_BYTES = 256 << 10
#: Window starts that are hashed at a time; with ``length`` they must fit PLACE_BITS.
STRETCH = 1 << 19
PLACE_BITS = 20

_BASE = 0x9E3779B97F4A7C15 | 1
_CONTEXT = ["gram", "context", "windows"]
#: Contexts that may show a repeated window that no count shows.
_COMPARED = "variants > 1 and single > 0"


class WindowHashes:
    """Hashes of byte windows: a polynomial over 64 bits, summed up once per stretch."""

    def __init__(self):
        powers = np.ones(STRETCH + (1 << 16), dtype=np.uint64)
        powers[1:] = _BASE
        self._powers = np.cumprod(powers, dtype=np.uint64)
        powers[1:] = pow(_BASE, -1, 1 << 64)
        self._inverse = np.cumprod(powers, dtype=np.uint64)

    def sums(self, a: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self._powers[: len(a)], out=out[1:])
        return out

    def all(self, sums: np.ndarray, length: int) -> np.ndarray:
        """The hash of every window of ``length`` bytes."""
        n = len(sums) - length
        return _mixed((sums[length:] - sums[:n]) * self._inverse[:n])

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((sums[ends] - sums[starts]) * self._inverse[starts])


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    table = padded.reshape(blocks, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def occurrences(text: bytes, length: int, hashes: WindowHashes, size: int | None = None):
    """Anchors of a text: (gram, context, start, windows) as arrays, one entry an occurrence. They have
    ``size`` bytes, half a window's if it is not given."""
    a = np.frombuffer(text, dtype=np.uint8)
    size = size or length // 2
    low = np.uint64((1 << PLACE_BITS) - 1)
    for begin in range(0, len(a) - length + 1, STRETCH):
        part = a[begin : begin + STRETCH + length - 1]
        sums = hashes.sums(part)
        grams = hashes.all(sums, size)
        placed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        anchors = (sliding_least(placed, length - size + 1) & low).astype(np.int64)
        firsts = np.flatnonzero(np.diff(anchors, prepend=-1))
        windows = np.diff(firsts, append=len(anchors))
        contexts = hashes.of(sums, firsts, firsts + windows + length - 1)
        yield grams[anchors[firsts]], contexts, firsts + begin, windows


def repeats(
    df: DataFrame,
    length: int = 400,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    as_text: bool = False,
) -> DataFrame:
    """What remains of every text when each byte goes that a repeated string covers.

    A string of ``length`` UTF-8 bytes is repeated if it starts anywhere else in the corpus too,
    the same text included; all its occurrences go. Returns ``id_col``, ``n_bytes``, ``removed``
    (the maximal removed runs as an array of (begin, end) in bytes) and ``kept`` (binary, or with
    ``as_text`` text, in which characters stay whole that a run cuts), after the columns in ``keep``.
    Null is the empty text. Rows that are repeated, with or without the same id, are documents of their
    own, so their texts repeat. An empty table gives no rows; other columns are left out.
    """
    source = id_and_text(df, id_col, text_col)
    keyed = source.select("id", *text_key("text"), "text")
    carried = df.select(
        col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"),
        *[col(c).alias(f"keep{i}") for i, c in enumerate(keep)],
    )
    carried = carried.select("*", *text_key("text"))
    return _kept(carried.join(repeated_spans(keyed, length), ["k1", "k2"], "left"), id_col, keep, as_text)


def repeated_spans(keyed: DataFrame, length: int, coded: Callable[[str], bytes] = str.encode) -> DataFrame:
    """``k1``, ``k2`` and ``spans``, in any order and overlapping: where repeated strings of ``length`` bytes lie.

    ``keyed`` has ``id``, ``text`` and its ``text_key``. Strings are looked for in what ``coded`` makes of a text,
    which is coded anew wherever its bytes are read, so codes are never moved.
    """
    found = _occurrences(keyed, length, coded)
    again = F.count(F.lit(1)).over(Window.partitionBy("gram")) > 1
    found = stage(found.withColumn("again", again).where("again").drop("again"), "repeat-anchors")
    contexts = found.groupBy(*_CONTEXT).agg(
        F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in ("id", "k1", "k2", "start")]
    )
    contexts = stage(_with_variants(contexts), "repeat-contexts")
    cut = stage(_context_bytes(keyed, contexts.where(_COMPARED), length, coded), "repeat-bytes")
    spans = _whole_spans(contexts, length).unionByName(_compared_spans(cut, length, length // 2))

    return (
        found.join(spans, _CONTEXT)
        .select("k1", "k2", "start", F.explode("spans").alias("span"))
        .select("k1", "k2", _span(F.col("start") + F.col("span.begin"), F.col("start") + F.col("span.end")).alias("span"))
        .distinct()
        .groupBy("k1", "k2")
        .agg(F.collect_list("span").alias("spans"))
    )


def _with_variants(contexts: DataFrame) -> DataFrame:
    """How many distinct contexts an anchor has, ``variants``, and how many of them occur once, ``single``."""
    grams = contexts.groupBy("gram").agg(
        F.count(F.lit(1)).alias("variants"), F.count_if(F.col("times") == 1).alias("single")
    )
    return contexts.join(grams, "gram")


def _whole_spans(contexts: DataFrame, length: int) -> DataFrame:
    """All of the contexts that occur twice."""
    whole = F.array(_span(F.lit(0), F.col("windows") + length - 1))
    return contexts.where("times > 1").select(*_CONTEXT, whole.alias("spans"))


def _span(begin, end):
    return F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"))


_SPANS = T.ArrayType(
    T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
)


def _occurrences(keyed: DataFrame, length: int, coded: Callable[[str], bytes]) -> DataFrame:
    schema = T.StructType(
        [T.StructField("id", id_type(keyed))]
        + [T.StructField(c, T.LongType()) for c in ("k1", "k2", "gram", "context", "start")]
        + [T.StructField("windows", T.IntegerType())]
    )

    def work(batches):
        hashes = WindowHashes()
        for piece in slices(batches):
            rows, columns = [], []
            for i, text in enumerate(piece.column("text").to_pylist()):
                for found in occurrences(coded(text), length, hashes):
                    rows.append(np.full(len(found[0]), i))
                    columns.append(found)
            if not rows:
                continue
            at = pa.array(np.concatenate(rows))
            gram, context, start, windows = (np.concatenate(c) for c in zip(*columns))
            yield {
                **{c: piece.column(c).take(at) for c in ("id", "k1", "k2")},
                "gram": gram.view(np.int64), "context": context.view(np.int64),
                "start": start, "windows": windows.astype(np.int32),
            }

    return map_arrow(keyed, work, schema)


def _context_bytes(
    keyed: DataFrame, contexts: DataFrame, length: int, coded: Callable[[str], bytes]
) -> DataFrame:
    """The bytes of contexts, and whether they are of a ``large`` group, whose bytes would not fit a task."""
    wanted = contexts.groupBy("id", "k1", "k2").agg(
        F.collect_list(F.struct(*_CONTEXT, "times", "start", (F.col("variants") > GROUP).alias("large"))).alias("wanted")
    )
    same = (
        keyed.id.eqNullSafe(wanted.id) & (keyed.k1 == wanted.k1) & (keyed.k2 == wanted.k2)
    )
    joined = keyed.join(wanted, same).select(keyed.text, "wanted")
    schema = T.StructType(
        [
            T.StructField("gram", T.LongType()),
            T.StructField("context", T.LongType()),
            T.StructField("windows", T.IntegerType()),
            T.StructField("times", T.LongType()),
            T.StructField("large", T.BooleanType()),
            T.StructField("bytes", T.BinaryType()),
        ]
    )

    def work(batches):
        for piece in slices(batches):
            out = {f.name: [] for f in schema}
            for text, wanted in zip(piece.column("text").to_pylist(), piece.column("wanted").to_pylist()):
                held = coded(text)
                for w in wanted:
                    for c in (*_CONTEXT, "times", "large"):
                        out[c].append(w[c])
                    out["bytes"].append(held[w["start"] : w["start"] + w["windows"] + length - 1])
            yield out

    return map_arrow(joined, work, schema)


def _spans_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("gram", T.LongType()),
            T.StructField("context", T.LongType()),
            T.StructField("windows", T.IntegerType()),
            T.StructField("spans", _SPANS),
        ]
    )


def _sorted_spans(cut: DataFrame, length: int) -> DataFrame:
    """Repeated windows of contexts that occur once, by suffix arrays over whole anchors."""
    dealt = cut.where("not large").repartition("gram").sortWithinPartitions(*_CONTEXT)

    def work(batches):
        texts: dict[tuple, tuple[bytes, int]] = {}
        size, gram = 0, None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in (*_CONTEXT, "times", "bytes")))
            for g, context, windows, times, held in rows:
                if g != gram and size > ARRAY_BYTES:
                    yield _spans_of(texts, length)
                    texts, size = {}, 0
                gram = g
                texts[g, context, windows] = (held, times)  # a repeated row cuts its contexts again
                size += len(held)
        if texts:
            yield _spans_of(texts, length)

    return map_arrow(dealt, work, _spans_schema())


def _spans_of(texts: dict[tuple, tuple[bytes, int]], length: int) -> dict:
    keys = list(texts)
    repeated = repeated_windows([t for t, _ in texts.values()], [k[2] for k in keys], length)
    out = {c: [] for c in (*_CONTEXT, "spans")}
    for key, starts, (_, times) in zip(keys, repeated, texts.values()):
        if times == 1 and len(starts):
            for c, value in zip(_CONTEXT, key):
                out[c].append(value)
            out["spans"].append([{"begin": a, "end": b} for a, b in merged(starts, starts + length)])
    return out


def merged(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of ranges as maximal ranges."""
    if not len(begins):
        return []
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(begins[1:] > ends[:-1]) + 1
    return list(zip(begins[np.r_[0, new]].tolist(), ends[np.r_[new - 1, len(ends) - 1]].tolist()))


def _compared_spans(cut: DataFrame, length: int, size: int) -> DataFrame:
    """Repeated windows of contexts that occur once, where anchors have ``size`` bytes."""
    spans = _sorted_spans(cut, length)
    many = cut.where("large")
    return spans if many.isEmpty() else spans.unionByName(_finer_spans(many, length, length - (length - size) // 4))


def _finer_spans(many: DataFrame, length: int, size: int) -> DataFrame:
    """The same in large groups. Anchors of ``size`` bytes, more than before, divide their contexts into parts, and
    equal windows are in parts of one anchor again. Where an anchor is a window, its parts are equal."""
    parts = stage(_parts(many.dropDuplicates(_CONTEXT), length, size), "repeat-parts")
    contexts = parts.groupBy(*_CONTEXT).agg(F.sum("times").alias("times"), F.first("bytes").alias("bytes"))
    contexts = stage(_with_variants(contexts), "repeat-part-contexts")
    spans = _whole_spans(contexts, length)
    if size < length:
        compared = contexts.where(_COMPARED).withColumn("large", F.col("variants") > GROUP)
        spans = spans.unionByName(_compared_spans(compared, length, size))
    hits = parts.where("times = 1").join(spans, _CONTEXT).select("outer.*", "place", F.explode("spans").alias("span"))
    place = F.col("place")
    moved = _span(place + F.col("span.begin"), place + F.col("span.end"))
    return hits.groupBy(*_CONTEXT).agg(F.collect_list(moved).alias("spans"))


def _parts(many: DataFrame, length: int, size: int) -> DataFrame:
    """The occurrences of anchors of ``size`` bytes in contexts (``outer``), with their ``place`` there."""
    schema = T.StructType(
        [T.StructField("outer", T.StructType([many.schema[c] for c in _CONTEXT])), T.StructField("place", T.IntegerType())]
        + [T.StructField(f.name, f.dataType) for f in many.schema if f.name in (*_CONTEXT, "times", "bytes")]
    )

    def work(batches):
        hashes = WindowHashes()
        for piece in slices(batches, "bytes"):
            out = {f.name: [] for f in schema}
            for row in piece.to_pylist():
                for found in occurrences(row["bytes"], length, hashes, size):
                    for gram, context, place, windows in zip(*(x.astype(np.int64).tolist() for x in found)):
                        out["outer"].append({c: row[c] for c in _CONTEXT})
                        out["bytes"].append(row["bytes"][place : place + windows + length - 1])
                        for c, value in zip((*_CONTEXT, "place", "times"), (gram, context, windows, place, row["times"])):
                            out[c].append(value)
            yield out

    return map_arrow(many, work, schema)


def without(held: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of UTF-8 text without the runs, where characters that a run cuts stay whole."""
    parts, at = [], 0
    for begin, end in runs:
        while begin < end and held[begin] & 0xC0 == 0x80:
            begin += 1
        while end > begin and end < len(held) and held[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(held[at:begin])
        at = end
    return b"".join([*parts, held[at:]])


def _kept(joined: DataFrame, id_col: str, keep: tuple[str, ...], as_text: bool) -> DataFrame:
    schema = T.StructType(
        [T.StructField(id_col, id_type(joined))]
        + [T.StructField(c, joined.schema[f"keep{i}"].dataType) for i, c in enumerate(keep)]
        + [
            T.StructField("n_bytes", T.LongType()),
            T.StructField("removed", _SPANS),
            T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
        ]
    )

    def work(batches):
        for piece in slices(batches):
            sizes, removed, kept = [], [], []
            for text, spans in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist()):
                held = text.encode()
                sizes.append(len(held))
                runs = []
                if spans:
                    ends = np.array([(s["begin"], s["end"]) for s in spans], dtype=np.int64)
                    runs = merged(ends[:, 0], ends[:, 1])
                if as_text:
                    kept.append(without(held, runs).decode())
                else:
                    at = [0, *(x for run in runs for x in run), len(held)]
                    kept.append(b"".join(held[a:b] for a, b in zip(at[::2], at[1::2])))
                removed.append([{"begin": a, "end": b} for a, b in runs])
            own = {c: piece.column(f"keep{i}") for i, c in enumerate(keep)}
            yield {id_col: piece.column("id"), **own, "n_bytes": sizes, "removed": removed, "kept": kept}

    return map_arrow(joined.select("id", "text", "spans", *[f"keep{i}" for i in range(len(keep))]), work, schema)
