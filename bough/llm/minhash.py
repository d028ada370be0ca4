"""Near-duplicate documents by MinHash.

A document is the set of its word shingles, and two link from a Jaccard similarity of ``LINKED``.
One permutation hashing: every shingle is hashed once, the hash says which of ``BANDS * ROWS`` bins it
falls into, and a bin keeps its least. A bin that stays empty takes the value of another, found
along an order of all bins that is the bin's own (optimal densification), so that every bin of two
sets agrees with the probability of their similarity, whatever their size. ``ROWS`` bins make a band and
sets that agree in a band share its bucket. A pair at the least similarity shares none of the buckets
with a probability of (1 - 0.8 ** 6) ** 64 = 4e-9.

Buckets do not give all their pairs but stars: each member is held against a centre, and what reaches
the similarity on the full sets is an edge. What edges connect needs no more comparing. A bucket
whose members are not connected yet is given more centres in a second round. What then is left in
crowded buckets is settled by the sets themselves: of two sets that link, under one order of all shingles,
one of the first n - 0.8 n + 1 of either is common to both. The order goes by how many of the sets left hold a
shingle, rare ones first, so a set with shingles of its own meets few others or none, and none is
left out. Equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.llm.batches import id_and_text, id_type, map_arrow, slices, text_key
from bough.llm.components import components
from bough.operators.staging import stage

WORDS = 4
#: Shared shingles in percent of those that either set has.
LINKED = 80
BANDS, ROWS = 64, 6
#: Members of a bucket up to which each is a centre at once.
FEW = 8
#: Centres of a larger bucket by round, about.
CENTRES = (1, 4)

_BINS = BANDS * ROWS
_BOUNDS = np.array([-(-(i << 64) // _BINS) for i in range(_BINS)], dtype=np.uint64)
#: In which order a bin asks the others for a value: the same for every set.
_ASKED = np.argsort(np.random.default_rng(7).random((_BINS, _BINS)), axis=1)
_MIX = np.random.default_rng(11).integers(1, 1 << 62, size=ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending: words between ASCII white space, ASCII letters
    in lower case; fewer words are one shingle, none are the empty set."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(parts) - words + 1)
    joined = map(b" ".join, zip(*(parts[i : i + n] for i in range(words)))) if n > 1 else [b" ".join(parts)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined), dtype=np.uint64, count=n))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified bins of a set that is not empty."""
    at = np.searchsorted(hashes, _BOUNDS)
    full = np.diff(at, append=len(hashes)) > 0
    bins = hashes[np.minimum(at, len(hashes) - 1)]
    empty = np.flatnonzero(~full)
    for step in range(8):
        if not len(empty):
            return bins
        asked = _ASKED[empty, step]
        have = full[asked]
        bins[empty[have]] = bins[asked[have]]
        empty = empty[~have]
    if len(empty):
        asked = _ASKED[empty]
        bins[empty] = bins[asked[np.arange(len(empty)), full[asked].argmax(axis=1)]]
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, the band's number mixed in."""
    rows = bins.reshape(-1, BANDS, ROWS)
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(rows), axis=0) * _MIX[0]
    for i in range(ROWS):
        keys = (keys ^ rows[:, :, i]) * _MIX[i]
        keys ^= keys >> np.uint64(29)
    return keys


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", linked: int = LINKED) -> DataFrame:
    """``id_col``, ``n_shingles`` (long), ``component_id`` (the least id that links reach) and ``kept`` (the
    row's id is its component's) of every row.

    A null text is empty. A document without words links with nothing, not with another one without words.
    Rows that share an id stay apart and link by what they hold. A row without an id takes part but names
    no component unless all are without one there, which gives null and is kept. An empty table gives
    no rows. ``linked`` is a percentage; the bands are laid out for 80 and more.
    """
    source = id_and_text(df, id_col, text_col).select("id", "text", *text_key("text"))
    rows = _prints(source).select(F.monotonically_increasing_id().alias("row"), "*")
    rows = stage(rows, "minhash-rows")
    sets = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("node"), F.min("id").alias("first"))
    nodes = stage(sets, "minhash-nodes")
    firsts = rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    held = stage(_buckets(firsts.select("node", F.col("n").cast("int").alias("n"), "keys")), "minhash-buckets")
    met = firsts.select("node", "id", "k1", "k2").join(held.select("node").distinct(), "node", "left_semi")
    roots = _connected(held, stage(_sets(source, met), "minhash-sets"), linked)
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("s1", "s2", "component_id")
    filled = rows.where("n > 0").join(named, ["s1", "s2"]).select("id", "n", "component_id")
    blank = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return filled.union(blank).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _prints(source: DataFrame) -> DataFrame:
    """Of every row the size of its set, 128 bits that stand for the set, and its band keys."""
    schema = T.StructType(
        [
            T.StructField("id", id_type(source)),
            T.StructField("k1", T.LongType()),
            T.StructField("k2", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("s1", T.LongType()),
            T.StructField("s2", T.LongType()),
            T.StructField("keys", T.ArrayType(T.LongType())),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for piece in slices(batches):
            sizes, ones, twos, bins = [], [], [], []
            for text in piece.column("text").to_pylist():
                held = shingles(text)
                sizes.append(len(held))
                one, two = set_print(held)
                ones.append(one)
                twos.append(two)
                if len(held):
                    bins.append(signature(held))
            keys = band_keys(np.stack(bins)).view(np.int64).ravel() if bins else np.zeros(0, np.int64)
            ends = np.cumsum([0] + [BANDS if n else 0 for n in sizes]).astype(np.int32)
            yield {
                **{c: piece.column(c) for c in ("id", "k1", "k2")},
                "n": sizes,
                "s1": np.array(ones, dtype=np.int64),
                "s2": np.array(twos, dtype=np.int64),
                "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)),
            }

    return map_arrow(source, work, schema)


def set_print(hashes: np.ndarray) -> tuple[int, int]:
    held = hashes.tobytes()
    return tuple(np.array([xxhash.xxh64_intdigest(held, s) for s in (0, 1)], np.uint64).view(np.int64).tolist())


def _buckets(nodes: DataFrame) -> DataFrame:
    """``key, node, n, u, members``: nodes under the keys that others have too. ``u`` is a number from 0 to 1
    that goes with the node."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "n")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    u = F.xxhash64("node").bitwiseAND((1 << 31) - 1) / float(1 << 31)
    return keyed.join(sizes, "key").select("key", "node", "n", u.alias("u"), "members")


def _sets(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node`` and ``held``, the set of its text, of every row of ``wanted`` (``node, id, k1, k2``).

    Only documents that share a bucket need their sets, so their texts are read again rather than all sets
    written. Id and text together find the row, so copies of a text spread over the tasks.
    """
    named = wanted.select("node", F.col("id").alias("own"), F.col("k1").alias("own1"), F.col("k2").alias("own2"))
    same = (
        (F.col("k1") == F.col("own1")) & (F.col("k2") == F.col("own2")) & F.col("id").eqNullSafe(F.col("own"))
    )
    texts = source.join(named, same).select("node", "text").dropDuplicates(["node"])
    schema = T.StructType(
        [T.StructField("node", T.LongType()), T.StructField("held", T.ArrayType(T.LongType()))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for piece in slices(batches):
            held = [shingles(t) for t in piece.column("text").to_pylist()]
            ends = np.cumsum([0] + [len(h) for h in held]).astype(np.int32)
            flat = np.concatenate(held).view(np.int64)
            yield {"node": piece.column("node"), "held": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}

    return map_arrow(texts, work, schema)


def _connected(held: DataFrame, sets: DataFrame, linked: int) -> DataFrame:
    """``node`` and ``root`` of all nodes that have a link."""
    held = held.withColumn("root", F.col("node"))
    links = None
    for i, centres in enumerate(CENTRES):
        pairs = stage(_star_pairs(held, i, centres, linked), "minhash-pairs")
        links, roots = _with_links(links, verified(pairs, sets, linked))
        now = held.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        held = stage(_open(now, max(centres, FEW)), "minhash-buckets")
        if held.isEmpty():
            return roots
    left = held.select("node", "root").distinct()
    pairs = stage(_prefix_pairs(left.join(sets, "node"), linked), "minhash-pairs")
    return _with_links(links, verified(pairs, sets, linked))[1]


def _with_links(links: DataFrame | None, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links so far and the components they make."""
    found = stage(more if links is None else links.union(more), "minhash-links")
    return found, stage(components(found), "minhash-roots")


def _open(held: DataFrame, seen: int) -> DataFrame:
    """Members of the buckets that may show a link yet: some are not connected, and not all were centres."""
    ends = held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("members").alias("most"))
    return held.join(ends.where((F.col("lo") < F.col("hi")) & (F.col("most") > seen)).select("key"), "key", "left_semi")


def _prefix_pairs(left: DataFrame, linked: int) -> DataFrame:
    """Pairs of ``left`` (``node, root, held``) that nothing connects yet and that can link: they share a
    shingle of both prefixes. Shingles that only one of the sets has take up room in its prefix, no more.

    How much two sets must have in common follows from both sizes, so where both places of a shared shingle
    are known, a prefix ends as early as the other set allows.
    """
    left = stage(left.select("node", "root", F.size("held").alias("n"), "held"), "minhash-left")
    each = left.select("node", F.explode("held").alias("shingle"))
    holders = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    shared = each.join(holders, "shingle").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("holders", "shingle"))).alias("shared")
    )
    # ceil(linked * n / 100) are common to all that link, so all but one fewer of these may come last.
    room = F.expr(f"n - cast(({linked} * cast(n as long) + 99) div 100 as int) + 1 - (n - size(shared))")
    first = left.drop("held").join(shared, "node").withColumn("room", room).where("room > 0")
    placed = F.posexplode(F.expr("slice(shared, 1, room)")).alias("at", "one")
    rows = first.select("node", "root", "n", (F.col("n") - F.size("shared")).alias("own"), placed)
    place = (F.col("own") + F.col("at")).alias("place")
    rows = stage(rows.select("node", "root", "n", place, "one.shingle"), "minhash-prefixes")
    ends = rows.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    rows = rows.join(ends.select("shingle"), "shingle", "left_semi")
    other = rows.select("shingle", *[F.col(a).alias(b) for a, b in _HUB.items()])
    common = F.expr(f"cast(({linked} * cast(n + hub_n as long) + {99 + linked}) div {100 + linked} as int)")
    early = (F.col("place") <= F.col("n") - common) & (F.col("hub_place") <= F.col("hub_n") - common)
    met = rows.join(other, "shingle").where(_fit(linked) & (F.col("node") < F.col("hub")) & early)
    return met.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


_HUB = {"node": "hub", "n": "hub_n", "root": "hub_root", "place": "hub_place"}


def _fit(linked: int) -> Column:
    return (100 * F.least("n", "hub_n") >= linked * F.greatest("n", "hub_n")) & (F.col("root") != F.col("hub_root"))


def _star_pairs(held: DataFrame, round_: int, centres: int, linked: int) -> DataFrame:
    """Pairs of a member and a centre of one bucket that nothing connects yet and whose sizes fit."""
    if round_:
        hubs = held.where(F.col("u") * F.col("members") < centres)
    else:
        least = held.groupBy("key").agg(F.min(F.struct("u", "node")).alias("least"))
        hubs = held.join(least, "key").where((F.col("members") <= FEW) | (F.col("node") == F.col("least.node")))
    hubs = hubs.select("key", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("root").alias("hub_root"))
    met = held.join(hubs, "key").where(_fit(linked))
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, linked: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets reach the similarity. A set moves once for each of its pairs."""
    one = sets.select(F.col("node").alias("a"), F.col("held").alias("held_a"))
    two = sets.select(F.col("node").alias("b"), F.col("held").alias("held_b"))
    both = pairs.join(two, "b").join(one, "a")
    shared = F.size(F.array_intersect("held_a", "held_b"))
    either = F.size("held_a") + F.size("held_b") - shared
    return both.where(_reaches(shared, either, linked)).select("a", "b")


def _reaches(shared: Column, either: Column, linked: int) -> Column:
    return 100 * shared.cast("long") >= linked * either.cast("long")
