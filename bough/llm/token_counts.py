"""Token counts of whole texts."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bough.llm.batches import id_and_text, id_type, map_arrow, slices
from bough.llm.encoding import encoder_of


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` and ``n_tokens`` of every row of ``df``; other columns are left out.

    Only lengths leave the tasks. Each task encodes slices of about equal bytes, and the encoder
    splits long texts where that cannot change a token. A null text counts as empty (0 tokens),
    repeated rows are counted each, a null id stays null, an empty table gives no rows.
    """
    source = id_and_text(df, id_col, text_col)
    schema = T.StructType(
        [
            T.StructField(id_col, id_type(source)),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def count(batches):
        encoder = encoder_of(tokenizer)
        for piece in slices(batches):
            texts = piece.column("text")
            yield {
                id_col: piece.column("id"),
                "n_bytes": pc.binary_length(texts),
                "n_tokens": encoder.counts(texts),
            }

    return map_arrow(source, count, schema)
