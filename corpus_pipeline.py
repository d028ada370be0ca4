"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. The folder is the one
that spark.checkpoint.dir names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bough.llm.batches import little_at_a_time
from bough.llm.decontamination import without_leaks
from bough.llm.near_copies import groups
from bough.llm.packing import pack, token_pieces
from bough.llm.passages import without_repeats
from bough.llm.toxicity import fit_toxicity, score_of
from bough.operators.staging import shuffles_end_with_jobs, stage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 1024
END_ID = 2
TOXIC_FROM = 0.5
#: Passages of over 50 words, however short the words are; the bytes catch long strings of few words.
REPEATED_WORDS, REPEATED_BYTES = 51, 400

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _in_little_room(spark: SparkSession) -> None:
    """Memory outside the heap and disk that later jobs and the writing of a result take."""
    little_at_a_time(spark)
    shuffles_end_with_jobs(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the classifier learns from labelled documents."""
    _in_little_room(spark)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(score_of("text", model) < TOXIC_FROM).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity from 0.8): that with the
    least id, of equals one chosen by a hash of what it holds.

    Groups are of rows, not of ids, so ids that repeat or are null neither join groups nor part them. A row
    with an id goes before one without.
    """
    _in_little_room(spark)
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "rows")
    slim = rows.select("row", "doc_id", F.xxhash64(*COLUMNS).alias("held"))
    grouped = slim.join(groups(rows), "row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "held", "row")
    firsts = grouped.groupBy("group").agg(F.min(order).alias("first"))
    return rows.join(firsts.select("first.row"), "row", "left_semi").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ``REPEATED_WORDS`` words, and the strings of ``REPEATED_BYTES``
    bytes, that occur elsewhere too.

    A document of which nothing is left goes; one that was empty or null before stays.
    """
    _in_little_room(spark)
    found = without_repeats(docs, REPEATED_WORDS, REPEATED_BYTES, keep=tuple(COLUMNS))
    cut = F.col("kept").isNotNull()
    return found.where(~cut | (F.col("kept") != "")).select(
        "doc_id",
        F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(cut, F.length("kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"),
    )


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    _in_little_room(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of documents with their tokens and their place."""
    _in_little_room(spark)
    return pack(token_pieces(docs, TOKENIZER, CAPACITY, END_ID), CAPACITY)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Models, fingerprints and suffix arrays are not SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a folder; the result is the last one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
