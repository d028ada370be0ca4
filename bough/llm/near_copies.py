"""Groups of texts whose shingles are similar, by SimHash first and by shared shingles for the rest.

Texts are sets of shingles of ``WORDS`` words (ASCII letters in lower case, words between ASCII white
space; a shorter text is one shingle). Two link when what both have is at least four fifths of what
either has, and a group is what links connect. Equal sets are one node, and every link is verified on
full sets.

Most links show in the fingerprints: nodes whose SimHashes share pigeonhole blocks and lie close
(``simhash.links``) are verified and connected. Fingerprints of linked sets may lie further apart, so
shingles find the others. Under any one order of all shingles, two linked sets of n and m shingles have
at least c = 4(n + m)/9 in common, so one of the first n - c + 1 and m - c + 1 is common to both.
Shingles come in the order of their hashes, those that many sets hold last. Nodes under a shingle that are
not connected yet are held against one of them, ``ROUNDS`` times, and connected by what links. What is left
are pairs of nodes that nothing connects: every one of them that shares a shingle at places that allow a
link is compared. By the places one of the two has it among its first ninth, and one is not of the group
that most holders of the shingle belong to, so only such rows are joined with others.

Before texts meet, bitmaps are compared: each shingle turns one of ``BITS`` bits, so two bitmaps differ in no
more bits than the sets do in shingles, and linked sets differ in (n + m)/9 at most.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.llm import minhash, simhash
from bough.llm.batches import id_and_text, map_arrow, rows_at_a_time, slices
from bough.llm.components import components
from bough.operators.staging import stage, staged_here, staging_path

WORDS = 5
#: How often the holders of a shingle are held against one of them.
ROUNDS = 2
#: Shingles that may be put last, and of how many nodes one is asked which shingles many hold. Any order
#: of the shingles gives the same groups, so neither bound costs a link.
LAST_KEYS, ASKED = 1 << 16, 16
#: Nodes asked that hold a shingle which goes last.
COMMON = 4
#: Bits of a bitmap.
BITS = 1024
#: Longs of the bitmaps that rows of shingles carry when all their pairs meet.
FOLDED = 4
#: Nodes whose ids are broadcast, by actual count, to choose texts without moving the others.
LISTED = 2_000_000
#: A shingle that the smaller of two sets that link has in common with the other.
EARLY = "9L * place <= n"
#: Rows that go to Python at once; a row of pairs holds two texts.
BATCH_ROWS = 500


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return minhash.shingles(text, WORDS)


def needed(n):
    """Shingles that a set of n shares with any set that links to it."""
    return (4 * n + 4) // 5


def prefix(own: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The shingles of a set of which every set that links to it has one; those of ``last`` come last."""
    n = len(own) - needed(len(own)) + 1 if len(own) else 0
    if len(last) and n:
        at = np.minimum(np.searchsorted(last, own), len(last) - 1)
        common = last[at] == own
        own = np.concatenate([own[~common], own[common]])
    return own[:n]


def groups(df: DataFrame, id_col: str = "row", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``group``, the least id of the group, of every row; ids are unique longs.

    A null text is empty, and empty texts are one group. An empty table gives no rows.
    """
    source = id_and_text(df, id_col, text_col)
    path = staging_path(df.sparkSession, "near-groups")
    with staged_here(df.sparkSession), rows_at_a_time(df.sparkSession, BATCH_ROWS):
        prints = stage(_prints(source), "near-prints")
        nodes = prints.groupBy("p1", "p2").agg(F.min("id").alias("node"))
        named = stage(prints.select("id", "p1", "p2").join(nodes, ["p1", "p2"]).select("id", "node"), "near-nodes")
        firsts = named.where("id = node").select("id")
        sketches = prints.join(firsts, "id", "left_semi").select(F.col("id").alias("node"), "n", "bits", "fingerprint")
        texts = source.join(firsts, "id", "left_semi").select(F.col("id").alias("node"), "text")
        roots = components(_links(stage(sketches, "near-sketches"), stage(texts, "near-texts")))
        rooted = named.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("group"))
        rooted.write.parquet(path)
    found = df.sparkSession.read.schema("id bigint, group bigint").parquet(path)
    return found.withColumnRenamed("id", id_col)


def bitmap(own: np.ndarray) -> np.ndarray:
    """Which of ``BITS`` bits an odd number of a set's shingles turn, as longs."""
    turned = np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(turned.astype(bool)).view(np.int64)


def _prints(source: DataFrame) -> DataFrame:
    """128 bits that stand for the set of a text, its size ``n``, its bitmap and the SimHash of the text."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "p1", "p2", "n", "fingerprint")])
    schema.add("bits", T.ArrayType(T.LongType()))

    def work(batches):
        for piece in slices(batches):
            texts = piece.column("text").to_pylist()
            sets = [shingles(t) for t in texts]
            found = [
                np.array([xxhash.xxh64_intdigest(h.tobytes(), s) for h in sets], np.uint64).view(np.int64) for s in (0, 1)
            ]
            prints = np.array([simhash.fingerprint(t, WORDS) for t in texts], np.uint64).view(np.int64)
            bits = pa.array(np.concatenate([bitmap(h) for h in sets]))
            yield {
                "id": piece.column("id"), "p1": found[0], "p2": found[1], "fingerprint": prints,
                "n": [len(h) for h in sets],
                "bits": pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64)), bits),
            }

    return map_arrow(source, work, schema)


def _close(nodes: DataFrame) -> DataFrame:
    """``node`` and ``other``: pairs whose fingerprints are equal or close, enough to connect all that are."""
    firsts = stage(nodes.groupBy("fingerprint").agg(F.min("node").alias("first")), "near-firsts")
    same = nodes.join(firsts, "fingerprint").where("node <> first")
    same = same.select(F.col("first").alias("node"), F.col("node").alias("other"))
    theirs = firsts.select(F.col("fingerprint").alias("other"), F.col("first").alias("second"))
    close = simhash.links(firsts).join(firsts, "fingerprint").join(theirs, "other")
    return same.union(close.select(F.least("first", "second"), F.greatest("first", "second"))).distinct()


def _common(texts: DataFrame) -> np.ndarray:
    """Shingles that many nodes hold, ascending, as far as one of ``ASKED`` nodes tells."""
    asked = texts.where(F.xxhash64("node").bitwiseAND(ASKED - 1) == 0)

    def work(batches):
        for piece in slices(batches):
            yield {"key": np.concatenate([shingles(t) for t in piece.column("text").to_pylist()]).view(np.int64)}

    held = map_arrow(asked, work, T.StructType([T.StructField("key", T.LongType())]))
    sizes = held.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") >= COMMON)
    rows = sizes.orderBy(F.desc("holders"), "key").limit(LAST_KEYS).select("key").collect()
    return np.sort(np.array([r.key for r in rows], dtype=np.int64).view(np.uint64))


def _prefixes(texts: DataFrame, last: np.ndarray) -> DataFrame:
    """``node``, ``n`` (shingles of the set), ``key`` and its ``place``, a row for each shingle of the prefix."""
    kinds = {"node": T.LongType(), "n": T.IntegerType(), "place": T.IntegerType(), "key": T.LongType()}
    schema = T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])
    # At most ``LAST_KEYS`` keys.
    held = texts.sparkSession.sparkContext.broadcast(last)

    def work(batches):
        for piece in slices(batches):
            sets = [shingles(t) for t in piece.column("text").to_pylist()]
            firsts = [prefix(s, held.value) for s in sets]
            many = [len(f) for f in firsts]
            yield {
                "node": np.repeat(np.array(piece.column("node").to_pylist(), dtype=np.int64), many),
                "n": np.repeat(np.array([len(s) for s in sets], dtype=np.int32), many),
                "place": np.concatenate([np.arange(m, dtype=np.int32) for m in many]),
                "key": np.concatenate(firsts).view(np.int64),
            }

    return map_arrow(texts, work, schema)


def _links(sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """``node`` and ``other``: links that connect all that links connect."""
    found = stage(_linked(_close(sketches), sketches, texts), "near-links")
    rest = _shared(texts)
    for i in range(ROUNDS + 1):
        rest = stage(_open(rest, components(found)), "near-open")
        if rest.isEmpty():
            break
        pairs = _stars(rest, i) if i < ROUNDS else _left(rest, sketches)
        found = stage(found.union(_linked(pairs, sketches, texts)), "near-links")
    return found


def _shared(texts: DataFrame) -> DataFrame:
    """Rows of prefixes that may show a link: of two sets that link, the smaller has a common shingle among
    its first ninth, so a later place counts only where a smaller set has the shingle that early."""
    path = staging_path(texts.sparkSession, "near-shared")
    early = F.expr(EARLY)
    with staged_here(texts.sparkSession):
        held = stage(_prefixes(texts, _common(texts)), "near-prefixes")
        sizes = held.groupBy("key").agg(
            F.count(F.lit(1)).alias("holders"), F.min(F.when(early, F.col("n"))).alias("least")
        )
        sizes = sizes.where("holders > 1 and least is not null").select("key", "least")
        shared = held.join(sizes, "key").where(early | F.expr("n > least"))
        shared.select("key", "node", "n", "place").write.parquet(path)
    return texts.sparkSession.read.schema("key bigint, node bigint, n int, place int").parquet(path)


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The holders of shingles whose holders are not all connected, with the ``root`` of each."""
    rows = rows.select("key", "node", "n", "place").join(roots, "node", "left")
    rows = rows.withColumn("root", F.coalesce("root", "node"))
    ends = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return rows.join(ends.select("key"), "key", "left_semi")


def _stars(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of the holders of a shingle with one of them, another at each turn and for each shingle.

    It is one that has the shingle early, as one of two that link has it.
    """
    by = F.struct(F.xxhash64("key", "node", F.lit(turn)).alias("turn"), "node", "n", "place", "root")
    one = rows.where(EARLY).groupBy("key").agg(F.min(by).alias("one")).select("key", "one.*").drop("turn")
    return _met(rows, one)


def _left(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """All pairs that share a shingle, that its places and folded bitmaps let link and that nothing connects."""
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("most"))
    rows = rows.join(most.select("key", F.col("most.root").alias("most")), "key")
    rows = rows.withColumn("minor", F.expr("root <> most")).drop("most")
    rows = stage(rows.join(sketches.select("node", *_folded()), "node"), "near-left")
    early = rows.where(EARLY)
    minor = _met(early.where("minor").drop("minor"), rows.drop("minor"), FOLDED)
    others = _met(early.where("not minor").drop("minor"), rows.where("minor").drop("minor"), FOLDED)
    return minor.union(others).distinct()


def _folded() -> list[Column]:
    """A bitmap as ``FOLDED`` longs: which bits an odd number of shingles turn if there are no more than these hold."""
    longs = range(BITS // 64)
    return [reduce(Column.bitwiseXOR, [F.col("bits")[i] for i in longs[k::FOLDED]]).alias(f"fold{k}") for k in range(FOLDED)]


def _met(rows: DataFrame, others: DataFrame, folded: int = 0) -> DataFrame:
    """Pairs of rows with others under a shingle that are not connected and whose sizes, places and first ``folded``
    longs of folded bitmaps let them link."""
    names = {"node": "other", "n": "m", "place": "place2", "root": "root2"} | {f"fold{k}": f"fold{k}b" for k in range(folded)}
    others = others.select("key", *[F.col(a).alias(b) for a, b in names.items()])
    common = F.expr("cast((4 * (cast(n as long) + m) + 8) div 9 as int)")
    early = (F.col("place") <= F.col("n") - common) & (F.col("place2") <= F.col("m") - common)
    if folded:
        turned = [F.bit_count(F.col(f"fold{k}").bitwiseXOR(F.col(f"fold{k}b"))) for k in range(folded)]
        early &= 9 * reduce(Column.__add__, turned) <= F.col("n") + F.col("m")
    met = rows.join(others, "key").where(F.expr("root <> root2 and 5L * n >= 4L * m and 5L * m >= 4L * n") & early)
    return met.select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other")).distinct()


def _linked(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``node``, ``other``) that link."""
    schema = pairs.schema
    theirs = sketches.select(F.col("node").alias("other"), F.col("n").alias("m"), F.col("bits").alias("bits2"))
    turned = F.zip_with("bits", "bits2", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(turned, F.lit(0), lambda total, x: total + x)
    pairs = pairs.join(sketches.select("node", "n", "bits"), "node").join(theirs, "other")
    pairs = stage(pairs.where(9 * differ <= F.col("n") + F.col("m")).select("node", "other"), "near-pairs")
    wanted = stage(pairs.select("node").union(pairs.select("other")).distinct(), "near-wanted")
    listed = F.broadcast(wanted) if wanted.count() <= LISTED else wanted
    texts = stage(texts.join(listed, "node", "left_semi"), "near-chosen")
    one = texts.withColumnRenamed("text", "text1")
    two = texts.select(F.col("node").alias("other"), F.col("text").alias("text2"))
    joined = pairs.join(two, "other").join(one, "node").select("node", "other", "text1", "text2")

    def work(batches):
        before, known = None, None
        for piece in slices(batches, "text1"):
            likes = []
            for node, a, b in zip(*(piece.column(c).to_pylist() for c in ("node", "text1", "text2"))):
                if node != before:  # sorted by the join, mostly
                    before, known = node, shingles(a)
                other = shingles(b)
                shared = len(np.intersect1d(known, other, assume_unique=True))
                likes.append(5 * shared >= 4 * max(1, len(known) + len(other) - shared))
            chosen = piece.filter(pa.array(likes, pa.bool_()))
            yield {c: chosen.column(c) for c in ("node", "other")}

    return map_arrow(joined, work, schema)
