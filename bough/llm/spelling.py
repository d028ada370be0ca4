"""Spelling variants: which words of a corpus are one edit away from each other.

A word's near words differ from it by exactly one inserted, deleted or replaced code point. For two
different words that is so exactly if the common prefix and the common suffix together reach the
longer length minus one. Comparing all words with all is not needed: cut in two, near words agree on one
half at least, so words meet only in blocks that share a first or a last half. A block that many words
share is taken apart in the same way, by the halves of what lies between the ends its words have in
common, until few share one or nothing is left to cut; then the alphabet bounds it. Inside a block the
words are rows of padded code-point matrices, aligned left for prefixes and right for suffixes, and
tiles of rows are compared with tiles of rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.llm.batches import id_and_text, map_arrow, slices
from bough.operators.staging import stage

#: Words that share a block and are compared without cutting it further.
BLOCK = 256
#: Cells of a tile: rows of one side times rows of the other.
TILE = 1 << 20
#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 17
#: Latin letters without and with diacritics (and the two signs between them), as UTF-8.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")

Change = Callable[[bytes, bytes], bytes]


def word_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Change | None = None
) -> DataFrame:
    """``word`` and ``n``, how often it occurs in all texts.

    Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, with only A-Z in lower case.
    ``change`` may turn a document's id (as text) and a run, both UTF-8, into another run; what
    comes out empty is not counted. A null text has no words, a null id is the empty text; rows that repeat count
    each time. Counts are combined in the tasks before they are shuffled. An empty table gives no rows.
    """
    source = id_and_text(df, id_col, text_col)
    source = source.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text")
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: Counter[bytes] = Counter()
        for piece in slices(batches):
            for name, text in zip(piece.column("id").to_pylist(), piece.column("text").to_pylist()):
                runs = Counter(RUN.findall(text.encode().lower()))
                if change is None:
                    counts.update(runs)
                else:
                    own = name.encode()
                    for run, n in runs.items():
                        counts[change(own, run)] += n
                if len(counts) >= COUNTED:
                    yield _columns(counts)
                    counts.clear()
        yield _columns(counts)

    partial = map_arrow(source, work, schema)
    return partial.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _columns(counts: Counter[bytes]) -> dict:
    return {"word": pa.array(list(counts), pa.binary()).cast(pa.string()), "n": list(counts.values())}


def slip(own: bytes, run: bytes) -> bytes:
    """One run in 31 loses a code point; which ones and where follows from a checksum of the document's
    id and the run."""
    h = zlib.crc32(run, zlib.crc32(own + b":"))
    if h % 31:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def spelling_variants(counts: DataFrame, ratio: int = 10, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``counts`` (``word``, ``n``).

    ``n_near`` counts the near words. ``form`` is the near word of the largest n, of equals the first in code
    point order, if that n is at least ``ratio`` times the word's own; ``form_n`` is its n. ``root`` is
    where following the forms ends, the word itself if it has none. Words have to be distinct; null and empty
    ones are left out. Words of any length and any code points may come. An empty table gives no rows.
    """
    words = stage(counts.where("word <> ''").select("word", "n"), "spelling-words")
    found = stage(near_words(words, block), "spelling-near")
    per_word = found.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    judged = words.join(per_word, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.near")).alias("form"),
        (-F.col("best.less")).alias("best_n"),
    )
    judged = stage(judged, "spelling-forms")
    roots = _roots(judged.where("form is not null").select("word", "form"))
    return judged.join(roots, "word", "left").select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        "n",
        "n_near",
        F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"),
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: forms followed to the end, twice as far each time.

    Along forms n grows by the ratio at least, so there are no circles and few steps.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("after"))
        step = now.join(after, "root", "left").select(
            "word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")
        )
        step = stage(step, "spelling-roots")
        now = step.select("word", "root")
        if not step.agg(F.bool_or("moved")).first()[0]:
            return now


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, near, near_n`` for every ordered pair of near words, once each."""
    held = stage(_keyed(words, F.lit(0), F.lit(0), [F.length("word"), F.length("word") - 1]), "spelling-blocks")
    found = []
    while True:
        sizes = held.groupBy("m", "g").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        met = stage(held.join(sizes, ["m", "g"]), "spelling-met")
        # Between the ends that a block's words share there is a middle; of one code point, nothing can be cut.
        crowded = (F.col("size") > block) & (F.col("m") - F.col("head") - F.col("tail") > 1)
        found.append(_compared(met.where(~crowded)))
        rest = met.where(crowded)
        if rest.isEmpty():
            break
        held = stage(_keyed(rest, F.col("head"), F.col("tail"), [F.col("m")]), "spelling-blocks")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    # A pair can meet in several blocks; words have few near ones, so rows of a word stay together.
    return pairs.repartition("word").dropDuplicates(["word", "near"])


def _keyed(rows: DataFrame, head: Column, tail: Column, shorter: list[Column]) -> DataFrame:
    """Rows under the blocks they belong to: ``head`` first and ``tail`` last code points shared by words
    of length ``m`` and ``m`` + 1. Of the middle of the shorter word the first or the last half is added."""
    each = rows.select(
        "word", "n", head.alias("head"), tail.alias("tail"), F.explode(F.array(*shorter)).alias("m")
    ).where("m > 0")
    half = F.expr("cast((m - head - tail) div 2 as int)")
    one = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"))
    two = F.struct(F.col("head").alias("head"), (F.col("tail") + half).alias("tail"))
    cut = F.explode(F.when(half > 0, F.array(one, two)).otherwise(F.array(one)))
    ends = each.withColumn("ends", cut).select("word", "n", "m", "ends.head", "ends.tail")
    first, last = F.expr("left(word, head)"), F.expr("right(word, tail)")
    return ends.withColumn("g", F.xxhash64("head", "tail", first, last))


def _compared(met: DataFrame) -> DataFrame:
    """Near pairs, in both directions, of words that meet in a block."""
    schema = T.StructType(
        [
            T.StructField("word", T.StringType()),
            T.StructField("near", T.StringType()),
            T.StructField("near_n", T.LongType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for m, names, counts in _groups(batches):
            # Short words can come into one block in two ways.
            counts = list(dict(zip(names, counts)).values())
            names = list(dict.fromkeys(names))
            for i, j in near_pairs(names, m):
                yield {
                    "word": [names[x] for x in (*i, *j)],
                    "near": [names[x] for x in (*j, *i)],
                    "near_n": [counts[x] for x in (*j, *i)],
                }

    together = met.select("m", "g", "word", "n").repartition("m", "g").sortWithinPartitions("m", "g", "word")
    return map_arrow(together, _joined(work), schema)


def _joined(work):
    """Gathers what ``work`` yields for small blocks into larger batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, list] = {}
        for columns in work(batches):
            for name, values in columns.items():
                held.setdefault(name, []).extend(values)
            if len(held["word"]) >= 1 << 14:
                yield held
                held = {}
        if held:
            yield held

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], list[int]]]:
    """``m``, words and counts of each block; blocks lie together but may span batches."""
    now, names, counts = None, [], []
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "g")]
        words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
        new = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
        edges = [0, *new.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            key = (columns[0][a], columns[1][a])
            if key != now and names:
                yield int(now[0]), names, counts
                names, counts = [], []
            now = key
            names += words[a:b]
            counts += n[a:b]
    if names:
        yield int(now[0]), names, counts


def near_pairs(names: list[str], m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of near words among words of ``m`` or ``m`` + 1 code points, the shorter one of length ``m``."""
    lengths = np.array([len(x) for x in names])
    order = np.argsort(lengths, kind="stable")
    short = int((lengths == m).sum())
    if not short:
        return
    names = [names[x] for x in order]
    width = m + 1
    left, right = _matrix(names, width, False), _matrix(names, width, True)
    tile = max(1, min(len(names), int(TILE**0.5)))
    for a in range(0, short, tile):
        rows = slice(a, min(a + tile, short))
        for b in range(a, len(names), tile):
            cols = slice(b, min(b + tile, len(names)))
            shared = _run(left, rows, cols) + _run(right, rows, cols)
            longest = np.where(np.arange(cols.start, cols.stop) < short, m, m + 1)
            i, j = np.nonzero(shared >= (longest - 1)[None, :])
            i, j = i + a, j + b
            # Of two words as long as each other, the first in order meets the second.
            once = i < j
            if once.any():
                yield order[i[once]], order[j[once]]


def _matrix(names: list[str], width: int, right: bool) -> np.ndarray:
    """A row of code points for each word; padding differs from any letter."""
    try:
        cells, kind, pad = [x.encode("latin-1") for x in names], np.uint8, b"\0"
    except UnicodeEncodeError:
        cells, kind, pad = [x.encode("utf-32-le", "surrogatepass") for x in names], np.uint32, b"\0\0\0\0"
    size = width * len(pad)
    padded = b"".join(x.rjust(size, b"\0") if right else x.ljust(size, b"\0") for x in cells)
    found = np.frombuffer(padded, dtype=kind).reshape(len(names), width)
    return found[:, ::-1] if right else found


def _run(cells: np.ndarray, rows: slice, cols: slice) -> np.ndarray:
    """How many leading cells each row of one tile shares with each row of another."""
    one, two = cells[rows], cells[cols]
    alike = np.ones((len(one), len(two)), dtype=bool)
    shared = np.zeros(alike.shape, dtype=np.int32)
    for c in range(cells.shape[1]):
        alike &= one[:, c, None] == two[None, :, c]
        if not alike.any():
            break
        shared += alike
    return shared
