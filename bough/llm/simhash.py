"""Near-duplicate documents by SimHash.

A fingerprint has 64 bits; bit i is set where over half of the document's shingle hashes have it
set. Documents link when their fingerprints differ in at most ``RADIUS`` bits, and a component is
what links connect.

Links are found among the distinct fingerprints: cut into four blocks, two fingerprints that
differ in two bits agree on two blocks at least, so they share one of the six pairs of blocks. A
pair of blocks that few fingerprints share is joined with itself and the distances are verified.
Where many share one, as the variants of a large group of near copies do, joining would give all
pairs; there each fingerprint is put instead beside the 65 that differ from it in one bit at most.
Fingerprints differ in two bits at most exactly if they meet at such a neighbour, at most 65 meet at
any, and all that meet there link, so tying them to the least of them keeps every component.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.llm.batches import id_and_text, id_type, map_arrow, slices
from bough.llm.components import components
from bough.operators.staging import stage

RADIUS = 2
SEED = 42
BLOCKS = 4
#: Fingerprints that share two blocks and are still compared pair by pair.
PAIRWISE = 64


def fingerprint(text: str, words: int = 3) -> int:
    """The SimHash of a text: ASCII letters in lower case, words between ASCII white space."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], dtype=np.uint64)
    else:
        held = b" ".join(parts)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        n = len(parts) - words + 1
        spans = map(slice, starts[:n].tolist(), ends[words - 1 :].tolist())
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, map(held.__getitem__, spans), repeat(SEED)), dtype=np.uint64, count=n
        )
    ones = np.zeros(64, dtype=np.int64)
    for begin in range(0, len(hashes), 1 << 14):
        part = hashes[begin : begin + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id_col`` and ``fingerprint``, the 64 bits as a long, of every row."""
    source = id_and_text(df, id_col, text_col)
    schema = T.StructType(
        [T.StructField(id_col, id_type(source)), T.StructField("fingerprint", T.LongType())]
    )

    def work(batches):
        for piece in slices(batches):
            prints = [fingerprint(t, words) for t in piece.column("text").to_pylist()]
            yield {id_col: piece.column("id"), "fingerprint": np.array(prints, dtype=np.uint64).view(np.int64)}

    return map_arrow(source, work, schema)


def links(prints: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges between the distinct longs in ``fingerprint`` that connect all that link.

    Every pair that shares a sparse pair of blocks is an edge; of the others a star each.
    """
    nodes = prints.select("fingerprint").where("fingerprint is not null").distinct()
    keyed = nodes.select("fingerprint", F.explode(F.array(*_keys())).alias("key"))
    sizes = keyed.groupBy("key").count().where("count > 1")
    shared = stage(keyed.join(sizes, "key"), "simhash-blocks")

    few = shared.where(F.col("count") <= pairwise).select("key", "fingerprint")
    other = few.withColumnRenamed("fingerprint", "other")
    close = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= RADIUS
    pairs = few.join(other, "key").where((F.col("fingerprint") < F.col("other")) & close)

    many = shared.where(F.col("count") > pairwise).select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    around = many.select("fingerprint", F.explode(flips).alias("flip")).select(
        "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("near")
    )
    met = around.groupBy("near").agg(F.array_distinct(F.collect_list("fingerprint")).alias("met"))
    stars = met.where(F.size("met") > 1).select(
        F.explode("met").alias("fingerprint"), F.array_min("met").alias("other")
    )
    found = pairs.select("fingerprint", "other").union(stars.where("fingerprint <> other"))
    return found.distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id_col``, ``fingerprint`` (long) and ``component_id``, the least id of the component.

    A null or empty text has fingerprint zero and links like any other. Rows that share an id stay
    apart. A row without an id takes part, but names no component unless all are null there, which
    gives null. An empty table gives no rows.
    """
    prints = stage(fingerprints(df, id_col, text_col, words), "simhash")
    groups = prints.groupBy("fingerprint").agg(F.min(id_col).alias("first"))
    roots = components(links(groups)).withColumnRenamed("node", "fingerprint")
    rooted = groups.join(roots, "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = stage(rooted, "simhash-groups")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(id_col, "fingerprint", "component_id")


def as_hex(print_: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def _keys() -> list[Column]:
    """For every pair of blocks its bits, and which pair it is."""
    width = 64 // BLOCKS
    blocks = [((1 << width) - 1) << (width * i) for i in range(BLOCKS)]
    chosen = [reduce(int.__or__, pair) for pair in combinations(blocks, BLOCKS - RADIUS)]
    return [
        F.struct(F.lit(i).alias("pair"), F.col("fingerprint").bitwiseAND(F.lit(_signed(mask))).alias("bits"))
        for i, mask in enumerate(chosen)
    ]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits
