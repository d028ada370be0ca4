"""The operators of this folder as queries over whole test tables."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.llm.decontamination import leaks
from bough.llm.hard_negatives import hard_negatives
from bough.llm.language import fit_language, languages
from bough.llm.main_text import fit_labeller, main_text
from bough.llm.minhash import near_duplicates as minhash_duplicates
from bough.llm.packing import pack, token_pieces
from bough.llm.repeats import repeats
from bough.llm.simhash import as_hex, near_duplicates
from bough.llm.spelling import slip, spelling_variants, word_counts
from bough.llm.syncmers import edit_trial
from bough.llm.token_counts import token_counts
from bough.llm.token_files import read_token_files, write_token_files
from bough.llm.toxicity import fit_toxicity, held_out, toxicity
from bough.operators.staging import staging_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark, folder):
    counts = token_counts(table(spark, folder, "documents"), BYTE_BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_syncmer_fingerprints(spark, folder):
    return edit_trial(table(spark, folder, "documents"))


def op3_benchmark_decontamination(spark, folder):
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_html_main_text(spark, folder):
    pages = table(spark, folder, "pages")
    texts = main_text(pages, fit_labeller(pages), keep=("url",))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op5_token_files(spark, folder):
    documents = table(spark, folder, "documents")
    shards = write_token_files(documents, BYTE_BPE, staging_path(spark, "token-files"), end_id=0)

    def crc(ids: np.ndarray) -> int:
        return zlib.crc32(ids.astype("<u4").tobytes())

    return read_token_files(spark, shards, crc, T.LongType()).withColumnRenamed("ids", "ids_crc32")


def op6_simhash_near_dedup(spark, folder):
    found = near_duplicates(table(spark, folder, "documents"))
    return found.withColumn("fingerprint", as_hex("fingerprint"))


def op7_language_id(spark, folder):
    documents = table(spark, folder, "documents")
    found = languages(documents, fit_language(documents))
    return found.withColumn("held_out", held_out(F.col("doc_id")))


def op8_best_fit_packing(spark, folder):
    pieces = token_pieces(table(spark, folder, "documents"), BYTE_BPE, capacity=1024, end_id=2)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=1024)


def op9_suffix_array_dedup(spark, folder):
    return repeats(table(spark, folder, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_toxicity(spark, folder):
    documents = table(spark, folder, "documents")
    model = fit_toxicity(documents, table(spark, folder, "labels"))
    return toxicity(documents, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op11_spelling_variants(spark, folder):
    counts = word_counts(table(spark, folder, "documents"), change=slip)
    return spelling_variants(counts.where((F.length("word") >= 7) & (F.col("n") >= 2)), ratio=10)


def op12_hard_negatives(spark, folder):
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_minhash_near_dedup(spark, folder):
    return minhash_duplicates(table(spark, folder, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_syncmer_fingerprints": op2_syncmer_fingerprints,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_html_main_text": op4_html_main_text,
    "op5_token_files": op5_token_files,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}
#: The others are encoders, models, or would take SQL an edit distance between all words.
ORACLES: dict[str, str] = {
    "op12_hard_negatives": """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label,
    list_inner_product(a.v, r.v)::BIGINT AS score
  FROM usable a JOIN usable r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.own
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
""",
    "op13_minhash_near_dedup": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[]
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS held
  FROM split
), shingles AS (
  SELECT doc_id, len(held) AS n, unnest(held) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (shingle)
  WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, len(held)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)
""",
}
