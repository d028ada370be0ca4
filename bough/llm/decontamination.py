"""Benchmark items that leaked into documents.

A window of as many words as an item has is a leak of the item when their SimHashes differ in at
most ``RADIUS`` bits and their weighted shingles are similar enough. Shingles are five words (an
item of fewer words is one shingle), their weight is their letters, and similarity is the weight of
what both have over the weight of what either has, repeats counted.

Similar windows share most shingles with their item, so only stretches of a document are
fingerprinted whose shared shingles weigh enough; this loses nothing. Their window fingerprints are
looked up among those of all items by blocks: of eight blocks of eight bits one must differ in at
most RADIUS // 8 bits if the whole differs in RADIUS at most, so lists of the items near every
value of every block give all that are within the radius. The exact similarity decides.

The benchmark is the query set: it is taken in blocks of bounded bytes, each of which is held
against all documents in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.llm.batches import id_and_text, id_type, map_arrow, slices
from bough.names import col

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
#: Bytes of benchmark texts that are held against the documents at a time.
BLOCK_BYTES = 8 << 20

_WORD = re.compile(r"\w+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every ``size`` consecutive words."""
    n = len(word_hashes) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(size):
        out = (out ^ word_hashes[i : i + n]) * _PRIME
        out ^= out >> np.uint64(29)
    return out


def simhashes(hashes: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The weighted SimHash of every ``size`` consecutive shingles."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    signed = np.where(bits, weights[:, None], -weights[:, None]).astype(np.int64)
    sums = np.vstack([np.zeros((1, 64), np.int64), np.cumsum(signed, axis=0)])
    ones = (sums[size:] - sums[:-size]) > 0
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()


class ItemIndex:
    """A block of benchmark items, ready to be held against documents."""

    def __init__(self, items: list[tuple[object, str]], similarity: float):
        self.similarity = similarity
        self.vocabulary: dict[str, int] = {}
        self.ids, self.sizes, self.spans, self.counts, self.totals = [], [], [], [], []
        prints, known = [], defaultdict(lambda: defaultdict(list))
        for item, text in items:
            own = words(text or "")
            if not own:
                continue
            size = min(SHINGLE, len(own))
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own], dtype=np.uint64)
            hashes, weights = _shingles(own, size)
            at = len(self.ids)
            self.ids.append(item)
            self.sizes.append(size)
            self.spans.append(len(own))
            weight = dict(zip(hashes.tolist(), weights.tolist()))
            count = Counter(hashes.tolist())
            self.counts.append({h: (n, weight[h]) for h, n in count.items()})
            self.totals.append(int(weights.sum()))
            prints.append(simhashes(hashes, weights, len(hashes))[0])
            for h, w in zip(shingle_hashes(numbers, size).tolist(), weights.tolist()):
                known[size][h].append((at, w))
        self.prints = np.array(prints, dtype=np.uint64)
        # By shingle size: sorted hashes, and for each the items that hold it with its weight.
        self.known = {}
        for size, table in known.items():
            hashes = sorted(table)
            self.known[size] = (
                np.array(hashes, dtype=np.uint64),
                [dict(table[h]) for h in hashes],
            )
        self.near = self._blocks()

    def _blocks(self) -> list[list[np.ndarray]]:
        """For every block and value of it the items that differ there in few enough bits."""
        values = np.arange(256, dtype=np.uint8)
        close = np.bitwise_count(values[:, None] ^ values[None, :]) <= RADIUS // 8
        own = self.prints.astype("<u8").view(np.uint8).reshape(-1, 8)
        return [[np.flatnonzero(close[v][own[:, b]]) for v in range(256)] for b in range(8)]

    def within(self, print_: np.uint64) -> np.ndarray:
        """All items whose fingerprint differs in at most RADIUS bits."""
        bytes_ = np.array([print_], dtype="<u8").view(np.uint8)
        found = np.unique(np.concatenate([self.near[b][v] for b, v in enumerate(bytes_)]))
        return found[np.bitwise_count(self.prints[found] ^ print_) <= RADIUS]

    def leaks(self, texts: list[str]) -> list[list[tuple]]:
        """Of every text its leaks: (item, similarity, distance, first word), the best of each."""
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.ids:
            return out
        parted = [words(t) for t in texts]
        bases = np.cumsum([0, *(len(p) + SHINGLE for p in parted)])
        numbers = np.full(bases[-1], -1, dtype=np.int64)
        for base, part in zip(bases, parted):
            numbers[base : base + len(part)] = np.fromiter(
                map(self.vocabulary.get, part, repeat(-1)), dtype=np.int64, count=len(part)
            )
        for size, (hashes, holders) in self.known.items():
            inside = numbers >= 0
            all_known = inside[: len(inside) - size + 1].copy()
            for i in range(1, size):
                all_known &= inside[i : len(inside) - size + 1 + i]
            at = np.flatnonzero(all_known)
            if not len(at):
                continue
            found = np.zeros(len(at), dtype=np.uint64)
            for i in range(size):
                found = (found ^ numbers[at + i].astype(np.uint64)) * _PRIME
                found ^= found >> np.uint64(29)
            place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            hit = hashes[place] == found
            at, place = at[hit], place[hit]
            docs = np.searchsorted(bases, at, side="right") - 1
            hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for d, p, x in zip(docs.tolist(), at.tolist(), place.tolist()):
                for item, weight in holders[x].items():
                    hits[d, item].append((p - int(bases[d]), weight))
            regions: dict[tuple[int, int, int], set] = {}
            for (d, item), own in hits.items():
                for low, high in self._stretches(item, own):
                    regions.setdefault((d, low, high), set()).add(self.spans[item])
            best: dict[tuple[int, int], tuple] = {}
            for (d, low, high), spans in regions.items():
                for span in spans:
                    for item, *rest in self._windows(parted[d], low, high, size, span):
                        key = (d, item)
                        if key not in best or rest[0] > best[key][0]:
                            best[key] = tuple(rest)
            for (d, item), rest in sorted(best.items()):
                out[d].append((self.ids[item], *rest))
        return out

    def _stretches(self, item: int, hits: list[tuple[int, int]]):
        """Where windows of the item can lie that share enough: runs of hits without a gap that
        no window spans, if what they share weighs enough."""
        span, need = self.spans[item], self.similarity * self.totals[item]
        begin = 0
        for i in range(1, len(hits) + 1):
            if i == len(hits) or hits[i][0] - hits[i - 1][0] > span:
                if sum(w for _, w in hits[begin:i]) >= need:
                    yield max(0, hits[begin][0] - span), hits[i - 1][0] + span + self.sizes[item]
                begin = i

    def _windows(self, parts: list[str], low: int, high: int, size: int, span: int):
        """Leaks of items of ``span`` words among the windows between two words."""
        own = parts[low:high]
        if len(own) < size:
            return
        hashes, weights = _shingles(own, size)
        many = min(span - size + 1, len(hashes))
        prints = simhashes(hashes, weights, many)
        listed, weighed = hashes.tolist(), weights.tolist()
        for start, print_ in enumerate(prints):
            for item in self.within(print_).tolist():
                if self.spans[item] != span or self.sizes[item] != size:
                    continue
                similarity = self._similarity(item, listed[start : start + many], weighed[start : start + many])
                if similarity >= self.similarity:
                    distance = int(np.bitwise_count(self.prints[item] ^ print_))
                    yield item, similarity, distance, low + start

    def _similarity(self, item: int, hashes: list[int], weights: list[int]) -> float:
        theirs = self.counts[item]
        shared = sum(
            min(n, theirs[h][0]) * theirs[h][1] for h, n in Counter(hashes).items() if h in theirs
        )
        return shared / (self.totals[item] + sum(weights) - shared)


def _shingles(parts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    word_hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in parts), dtype=np.uint64, count=len(parts))
    letters = np.cumsum([0, *map(len, parts)])
    return shingle_hashes(word_hashes, size), letters[size:] - letters[:-size]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, similarity: float, block_bytes: int = BLOCK_BYTES):
    """Indexes over parts of the benchmark of about ``block_bytes`` each, sent to the executors."""
    spark = benchmark.sparkSession
    items = benchmark.select(col(id_col).alias("id"), col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = size // block_bytes + 1
    of = F.pmod(F.xxhash64("text"), F.lit(blocks))
    for block in range(blocks):
        # Sorted, so that the index does not depend on the order of arrival.
        rows = sorted((r["text"], repr(r["id"]), r["id"]) for r in items.where(of == block).collect())
        index = ItemIndex([(i, text) for text, _, i in rows], similarity)
        yield spark.sparkContext.broadcast(index)


def leaks(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``id_col``, ``item_col``, ``similarity``, ``distance`` and ``first_word`` of every leak.

    There is a row for each row of ``df`` and each item that it holds, with the most similar window
    (of equals the first). Null and empty texts and items have no leaks, repeated rows and items
    are reported each, an empty table gives no rows; other columns are left out.
    """
    source = id_and_text(df, id_col, text_col)
    schema = T.StructType(
        [
            T.StructField(id_col, id_type(source)),
            T.StructField(item_col, benchmark.schema[item_col].dataType),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("distance", T.IntegerType()),
            T.StructField("first_word", T.LongType()),
        ]
    )

    def scan(index):
        def work(batches):
            for piece in slices(batches):
                found = index.value.leaks(piece.column("text").to_pylist())
                at = [i for i, own in enumerate(found) for _ in own]
                if at:
                    rest = zip(*(leak for own in found for leak in own))
                    yield dict(zip(schema.names, (piece.column("id").take(at), *map(list, rest))))

        return work

    parts = [
        map_arrow(source, scan(index), schema)
        for index in item_blocks(benchmark, item_col, item_text_col, similarity)
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def without_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The rows of ``df``, with all columns, whose text holds no item; null texts stay."""
    import pyarrow as pa

    names = df.columns
    # Under numbers, since the names of columns may clash with one another's case.
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_col)}"

    def keep(index):
        def task(batches):
            for piece in slices(batches, text):
                texts = [t or "" for t in piece.column(text).to_pylist()]
                yield piece.filter(pa.array([not own for own in index.value.leaks(texts)]))

        return task

    for index in item_blocks(benchmark, item_col, item_text_col, similarity):
        numbered = numbered.mapInArrow(keep(index), numbered.schema)
    return numbered.toDF(*names)
