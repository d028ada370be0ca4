"""Removal of passages of many words that occur more than once in a corpus.

Every word, between white space, is written as ``CODE`` characters of its hash, so a passage of n
words is a string of n times as many bytes whatever the length of its words, and ``repeated_spans``
finds it. Runs that it finds are narrowed to whole words.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.llm.batches import map_arrow, slices, text_key
from bough.llm.repeats import merged, repeated_spans, without
from bough.names import col
from bough.operators.staging import staged_here, staging_path

#: Characters a word, of six bits each.
CODE = 6

_WORD = re.compile(rb"\S+")
_KEYS = ["k1", "k2"]
_SPANS = "array<struct<begin: bigint, end: bigint>>"


def coded(text: str) -> str:
    """The codes of the words of a text, side by side."""
    hashes = [xxhash.xxh64_intdigest(w) for w in text.encode().split()]
    bits = np.array(hashes, dtype=np.uint64)[:, None] >> (6 * np.arange(CODE, dtype=np.uint64))
    return ((bits & np.uint64(63)) + np.uint64(48)).astype(np.uint8).tobytes().decode()


def whole_words(runs: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Runs of codes as ranges of words, those of at least so many words."""
    found = [(-(-begin // CODE), end // CODE) for begin, end in runs]
    return [(begin, end) for begin, end in found if end - begin >= words]


def byte_runs(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of bytes."""
    places = [m.span() for m in _WORD.finditer(text)] if ranges else []
    return [(places[begin][0], places[end - 1][1]) for begin, end in ranges]


def without_repeats(
    df: DataFrame, words: int, length: int, text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """The columns in ``keep`` and ``kept``: what remains of a text when every passage of ``words``
    words and every string of ``length`` bytes goes that starts anywhere else too, null where nothing goes.

    Passages are equal if their words are, whatever white space is between them. Null is the empty
    text, repeated rows are documents of their own, and an empty table gives no rows.
    """
    spark = df.sparkSession
    text = F.coalesce(col(text_col), F.lit(""))
    texts = df.select(F.lit(0).alias("id"), text.alias("text")).select("*", *text_key("text"))
    parts = []
    for label, as_bytes, long in (("passages", _codes, words * CODE), ("strings", str.encode, length)):
        path = staging_path(spark, label)
        with staged_here(spark):  # one search's tables go before the next one's come
            repeated_spans(texts, long, as_bytes).write.parquet(path)
        parts.append(spark.read.schema(f"k1 bigint, k2 bigint, spans {_SPANS}").parquet(path))
    passages, strings = (p.withColumnRenamed("spans", n) for p, n in zip(parts, ("passages", "strings")))
    spans = passages.join(strings, _KEYS, "full")
    carried = df.select(*[col(c).alias(f"keep{i}") for i, c in enumerate(keep)], text.alias("text"))
    joined = carried.select("*", *text_key("text")).join(spans, _KEYS, "left").drop(*_KEYS)
    schema = T.StructType(
        [T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField("kept", T.StringType())]
    )

    def work(batches):
        for piece in slices(batches):
            kept = []
            for held, *found in zip(*(piece.column(c).to_pylist() for c in ("text", "passages", "strings"))):
                coded_runs, runs = (_merged([(s["begin"], s["end"]) for s in spans or ()]) for spans in found)
                runs = _merged(runs + byte_runs(held.encode(), whole_words(coded_runs, words)))
                kept.append(without(held.encode(), runs).decode() if runs else None)
            yield {c: piece.column(f"keep{i}") for i, c in enumerate(keep)} | {"kept": kept}

    return map_arrow(joined, work, schema)


def _codes(text: str) -> bytes:
    return coded(text).encode()


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    ends = np.array(runs, dtype=np.int64).reshape(-1, 2)
    return merged(ends[:, 0], ends[:, 1])
