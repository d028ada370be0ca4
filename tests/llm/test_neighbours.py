"""Spelling variants, hard negatives and MinHash groups against brute force and SQL."""

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bough.llm import hard_negatives as negatives_module
from bough.llm import minhash
from bough.llm.hard_negatives import hard_negatives, hilbert_places
from bough.llm.queries import ORACLES, op11_spelling_variants
from bough.llm.spelling import near_pairs, slip, spelling_variants, word_counts

FOLDER = "/root/testdata/sf0.001"


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n int, word string, row int"
    )


# ---- spelling -----------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(counts, ratio):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            forms[w] = best

    def root(w):
        return root(forms[w]) if w in forms else w

    return {
        (w, forms.get(w), root(w), counts[w], len(near[w]), counts[forms[w]] if w in forms else None) for w in counts
    }


def variants(spark, counts, **more):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = spelling_variants(df, **more)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_variants_by_brute_force(spark, block):
    rng = random.Random(block)
    counts = {}
    while len(counts) < 300:
        word = "".join(rng.choice("abé") for _ in range(rng.randint(1, 7)))
        counts[word] = rng.choice([1, 2, 3, 30, 31, 400, 5000])
    assert variants(spark, counts, block=block) == plain_variants(counts, 10)


def test_variants_of_odd_words(spark):
    long = "ab" * 3000
    counts = {"a": 1, "b": 10, "": 5, "Ω": 1, "Ωa": 2, "😀x": 3, "x": 30, "xx": 300, long: 4, long[1:]: 50, "zq": 7}
    want = plain_variants({w: n for w, n in counts.items() if w}, 10)
    assert variants(spark, counts) == want
    # Equal counts: the first in code point order is the form, and forms are followed to the end.
    tied = variants(spark, {"cat": 1, "cab": 10, "car": 10, "card": 100}, ratio=10)
    assert {r[0]: r[1:3] for r in tied} == {
        "cat": ("cab", "cab"), "cab": (None, "cab"), "car": ("card", "card"), "card": (None, "card")
    }
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling_variants(empty).collect() == []


def test_tiles_agree_with_one_edit():
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([5, 6]))) for _ in range(90)})
    found = set()
    for i, j in near_pairs(names, 5):
        found |= {frozenset((names[a], names[b])) for a, b in zip(i, j)}
    want = {frozenset((a, b)) for a in names for b in names if one_edit(a, b) and min(len(a), len(b)) == 5}
    assert found == want


def plain_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts.pop("", None)
    return counts


def test_word_counts(spark):
    rng = random.Random(2)
    letters = "abcXYZÀÿ×ßé-'1 \nĀ"
    rows = [(i, "".join(rng.choice(letters) for _ in range(200))) for i in range(60)]
    rows += [(None, "Null id null"), (7, None), (7, ""), (8, "Ärger " * 4000), (8, "Ärger"), (9, "x" * 100000)]
    found = word_counts(documents(spark, rows), change=slip)
    assert {r.word: r.n for r in found.collect()} == plain_counts(rows)
    assert word_counts(documents(spark, [])).collect() == []


def test_spelling_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    counts = {w: n for w, n in plain_counts(rows).items() if n >= 2 and len(w) >= 7}
    got = {tuple(r) for r in op11_spelling_variants(spark, FOLDER).collect()}
    assert got == plain_variants(counts, 10)


# ---- hard negatives -----------------------------------------------------------------------------


def plain_negatives(rows, positives=5, negatives=10):
    """Rows are (place, id, whole vector, label); ties of ids go by place."""
    found = Counter()
    for p, anchor, v, label in rows:
        if anchor % 10:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), i, q, other == label) for q, i, w, other in rows if q != p
        )
        for s, positive, _, _ in [x for x in scored if x[3]][:positives]:
            rest = [x for x in scored if not x[3] and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            for rank, x in enumerate(rest, 1):
                found[anchor, positive, rank, x[1], -s, -x[0]] += 1
    return found


@pytest.mark.parametrize("seed,block,wave", [(1, 1024, 4096), (2, 7, 4096), (3, 16, 3)])
def test_negatives_by_brute_force(spark, seed, block, wave):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(150, 5)).round(1)
    rows = [(i, v.tolist(), int(rng.integers(3))) for i, v in enumerate(vectors)]
    rows += [(200 + i, rows[10][1], 1) for i in range(12)]  # the same vector again and again
    rows += [(300, None, 1), (301, [1.0] * 5, None), (None, [1.0] * 5, 1), (303, [1.0, None, 0.0, 0.0, 0.0], 1)]
    rows += [(310, [math.nan] * 5, 1), (320, [math.inf] + [0.0] * 4, 2), (330, [1.5, 2.0], 1), (340, [], 0)]
    df = spark.createDataFrame(
        [(i, v, label, "c", 1) for i, v, label in rows],
        "vec_id long, embedding array<float>, label int, cells string, row int",
    )
    plain = []
    for q, (i, v, label) in enumerate(rows):
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        plain.append((q, i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    found = hard_negatives(df, F.col("vec_id") % 10 == 0, block=block, wave=wave)
    assert Counter(tuple(r) for r in found.collect()) == plain_negatives(plain)


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(df, F.col("vec_id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(11, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(one, F.col("vec_id") % 10 == 0).collect() == []
    huge = spark.createDataFrame([(10, [1e9], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(negatives_module.SetupError, match="2 \\*\\* 52"):
        hard_negatives(huge, F.col("vec_id") % 10 == 0)


@pytest.mark.parametrize("size,bits", [(2, 3), (3, 2), (5, 2)])
def test_the_curve_visits_neighbours(size, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * size), axis=-1).reshape(-1, size)
    places = [p.tobytes() for p in hilbert_places(cells, bits)]
    assert len(set(places)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=places.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_zones_leave_blocks_out(spark):
    """Far clusters: bounds name only the blocks that can hold what an anchor looks for."""
    rng = np.random.default_rng(5)
    centres = np.array([[9.0, 0, 0], [0, 9.0, 0], [0, 0, 9.0]])
    rows = [(i, (centres[i % 3] + rng.normal(size=3) * 0.1).tolist(), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = negatives_module._whole(df, F.col("vec_id") == 300, "vec_id", "embedding", "label", 256)
    ends = (min(min(r[1]) for r in rows) * 256 // 1, max(max(r[1]) for r in rows) * 256 // 1)
    blocks = negatives_module._blocks(whole, 3, tuple(map(int, ends)), 16, 5)
    asked = [(r.row, r.id, r.label, r.cells, r.fifth) for r in negatives_module._anchors(blocks, 3).collect()]
    held = spark.sparkContext.broadcast(negatives_module._Goals.of_anchors(asked, 3))
    needed = negatives_module._needed(blocks, held).count()
    assert 0 < needed <= blocks.count() // 2


# ---- MinHash ------------------------------------------------------------------------------------


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall("[^\x20\x09-\x0d]+", low)
    if not parts:
        return frozenset()
    return frozenset(" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3)))


def plain_groups(rows):
    """Components over places in ``rows``; each row's least id."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    found = Counter()
    for k, (i, _) in enumerate(rows):
        alike = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        least = min(alike, default=None)
        found[i, len(sets[k]), least, i == least] += 1
    return found


def minhash_rows(spark, rows):
    found = minhash.near_duplicates(documents(spark, rows))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return Counter(tuple(r) for r in found.collect())


def changed(rng, words, share):
    return [rng.choice(["uno", "due", "tre"]) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("few,centres", [(8, (1, 4)), (2, (1, 3)), (1, (1,))])
def test_groups_by_brute_force(spark, monkeypatch, few, centres):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "CENTRES", centres)
    rng = random.Random(few)
    rows = []
    for base in range(6):
        words = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.choice([5, 9, 40, 120]))]
        for _ in range(25):
            # Chains too: a copy of a copy.
            words = changed(rng, words, rng.choice([0, 0.01, 0.03]))
            rows.append((len(rows), " ".join(words)))
    assert minhash_rows(spark, rows) == plain_groups(rows)


def test_groups_of_odd_rows(spark):
    long = " ".join(str(i) for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (5, "ONE"), (6, "a b c"), (None, "a b c")]
    rows += [(None, "lone words here"), (7, long), (8, long + " more"), (9, "a b c d"), (9, "a b c d e"), (3, "x")]
    rows += [(10, "Ä b c d e f g h i j k"), (11, "ä b c d e f g h i j k")]
    want = plain_groups(rows)
    # A row without an id that none with an id is grouped with is kept.
    want = Counter({(*k[:3], k[0] == k[2]): n for k, n in want.items()})
    assert minhash_rows(spark, rows) == want
    assert minhash_rows(spark, []) == Counter()


@pytest.mark.parametrize("n", [1, 2, 30, 5000])
def test_bins_agree_with_the_probability_of_the_similarity(n):
    rng = np.random.default_rng(n)
    agreed = []
    for _ in range(30):
        both = rng.integers(0, 1 << 63, size=4 * n, dtype=np.uint64) * np.uint64(2)
        more = rng.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2)
        one, two = np.unique(both), np.unique(np.concatenate([both, more]))
        agreed.append((minhash.signature(one) == minhash.signature(two)).mean())
    assert abs(np.mean(agreed) - 0.8) < 0.05


# ---- SQL ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    from bough.llm.queries import QUERIES

    duck = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, FOLDER).select(*names)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
