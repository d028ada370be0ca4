"""SimHash groups, repeated strings, fingerprints and benchmark leaks against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from bough.llm import repeats as repeats_module
from bough.llm import simhash, syncmers
from bough.llm.components import components
from bough.llm.decontamination import leaks, without_leaks, words
from bough.llm.repeats import merged, repeats, without
from bough.llm.suffix_array import repeated_windows, suffix_array


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, 1, "y") for i, t in rows], "doc_id long, text string, fingerprint int, id string"
    )


# ---- SimHash ------------------------------------------------------------------------------------


def plain_fingerprint(text):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    parts = [p for p in "".join(" " if c in "\t\n\v\f\r " else c for c in parts).split(" ") if p]
    shingles = [" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))] if parts else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))


@pytest.mark.parametrize("text", ["", "  \n", "One", "A b", "ÄÖ ß É x y z", "a b c d", "w " * 500 + "END"])
def test_fingerprints_by_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def groups_by_brute_force(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("pairwise", [1, 4, 64])
def test_links_connect_what_brute_force_connects(spark, pairwise):
    rng = random.Random(pairwise)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):  # chains and dense clouds
            prints.add(p)
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(x,) for x in signed.values()], "fingerprint long")
    roots = {r.node: r.root for r in components(simhash.links(df, pairwise)).collect()}
    brute = groups_by_brute_force(prints)
    mine, theirs = {}, {}
    for p in prints:
        mine.setdefault(roots.get(signed[p], signed[p]), set()).add(p)
        theirs.setdefault(brute[p], set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_near_duplicates_of_odd_rows(spark):
    rows = [(7, "a b c d"), (3, "A B C D"), (9, None), (8, ""), (None, "a b c d"), (None, "alone in the world"), (3, "A B C D")]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert Counter(r.component_id for r in got) == {3: 4, 8: 2, None: 1}
    assert {r.fingerprint for r in got if r.component_id == 8} == {0}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, None)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(41)}


# ---- repeated strings ---------------------------------------------------------------------------


def test_suffix_arrays():
    rng = random.Random(2)
    for _ in range(200):
        letters = rng.choice([b"a", b"ab", b"abcdef"])
        text = bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) * rng.choice([1, 3])
        for depth in (1000, 5):
            order = suffix_array(text, depth).tolist()
            assert sorted(order) == list(range(len(text)))
            heads = [text[i : i + depth] for i in order]
            assert heads == sorted(heads)


def test_repeated_windows():
    found = repeated_windows([b"abcabcx", b"zzabc"], [5, 3], 3)
    assert [x.tolist() for x in found] == [[0, 3], [2]]


def removed_by_brute_force(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(c for c, g in zip(t, gone) if not g))
    return out


@pytest.mark.parametrize("group", [0, 2, 512])
@pytest.mark.parametrize("length", [12, 40])
def test_repeats_by_brute_force(spark, monkeypatch, group, length):
    monkeypatch.setattr(repeats_module, "GROUP", group)
    monkeypatch.setattr(repeats_module, "STRETCH", 64)
    rng = random.Random(length + group)
    passages = ["".join(rng.choice("ab ") for _ in range(rng.randint(10, 90))) for _ in range(6)]
    texts = ["".join(rng.choice([*passages, "é", "Q" * 30, "xyzé" * 9]) for _ in range(rng.randint(0, 6))) for _ in range(40)]
    texts += [None, "", "a" * 300, passages[0], passages[0]]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    got = repeats(documents(spark, rows).repartition(3), length).collect()
    kept = removed_by_brute_force([(t or "").encode() for t in texts], length)
    assert Counter((r.doc_id, bytes(r.kept)) for r in got) == Counter(zip([i for i, _ in rows], kept))
    for r in got:
        runs = [(x.begin, x.end) for x in r.removed]
        assert sum(b - a for a, b in runs) == r.n_bytes - len(r.kept)
        assert all(b < c for (_, b), (c, _) in zip(runs, runs[1:]))


def test_repeats_edges(spark):
    assert repeats(documents(spark, []), 10).count() == 0
    assert merged(np.array([5, 0, 2]), np.array([7, 2, 4])) == [(0, 4), (5, 7)]
    assert without("aéb".encode(), [(0, 2)]) == "éb".encode()
    assert without("aéb".encode(), [(2, 4)]) == "aé".encode()
    twice = documents(spark, [(1, "the same text twice"), (1, "the same text twice")])
    assert [r.kept for r in repeats(twice, 10, keep=("id",), as_text=True).collect()] == ["", ""]


# ---- fingerprints -------------------------------------------------------------------------------


def test_edit_trial(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("etaoinsr") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 300))) for _ in range(20)]
    texts += ["", None, "é", "ab", texts[0], texts[0], "😀" * 50, "Orre " * 900]
    rows = list(enumerate(texts, 10))
    got = {r.doc_id: r for r in syncmers.edit_trial(documents(spark, rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, donor = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        other = t[: len(t) - half] + donor[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert r.fingerprint == syncmers.packed(syncmers.sketch(t))
        assert r.edited_fingerprint == syncmers.packed(syncmers.sketch(other))
        assert 0 <= r.near_edited <= 1 and (t != donor or r.near_next == 1.0)
        if len(t) > 300 and k < 19:
            assert r.near_edited > r.near_next + 0.1
    assert syncmers.edit_trial(documents(spark, [])).count() == 0
    alone = syncmers.edit_trial(documents(spark, [(None, "one text only"), ])).first()
    assert alone.near_next == 1.0
    same = syncmers.edit_trial(documents(spark, [(1, "x y"), (1, "x y"), (None, "z")]))
    assert same.count() == 3


def test_anchors_do_not_depend_on_context():
    core = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of doubt"
    points = syncmers._points
    own = {h for h in syncmers.anchors(points(core))[0].tolist()}
    inside = {h for h in syncmers.anchors(points("#" * 77 + core + "!" * 33))[0].tolist()}
    assert own <= inside and len(own) > 5


# ---- leaks --------------------------------------------------------------------------------------


def similarity(a, b):
    a, b = Counter(a), Counter(b)
    weight = lambda s: sum(map(len, s))
    shared = sum(min(n, b[s]) * weight(s) for s, n in a.items())
    return shared / (sum(n * weight(s) for s, n in (a + b).items()) - shared)


def shingles(parts):
    n = min(5, len(parts))
    return [tuple(parts[i : i + n]) for i in range(len(parts) - n + 1)]


def test_leaks_by_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [prose(rng.randint(3, 40)) for _ in range(12)] + [["only"], []]
    texts = []
    for _ in range(60):
        text = prose(rng.randint(0, 60))
        if rng.random() < 0.6:
            item = list(rng.choice(items))
            for _ in range(rng.randint(0, 2)):
                if item:
                    item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = item
        texts.append(" ".join(text).upper() if rng.random() < 0.3 else ", ".join(text))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, " ".join(items[0])), (900, None), (901, "")]
    benchmark = spark.createDataFrame(
        [(i, " ".join(t), "z") for i, t in enumerate(items)] + [(99, None, "z")], "item_id long, text string, doc_id string"
    )
    docs = documents(spark, rows)
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(docs, benchmark).collect()}
    want = {}
    for i, t in rows:
        parts = words(t or "")
        for j, item in enumerate(items):
            if not item:
                continue
            n = len(item)
            # A window of a shorter text has shingles of the item's size or none.
            spans = [parts[s : s + n] for s in range(max(1, len(parts) - n + 1))]
            size = min(5, n)
            tuples = [[tuple(x[k : k + size]) for k in range(len(x) - size + 1)] for x in spans if len(x) >= size]
            best = max((similarity(x, shingles(item)) for x in tuples), default=0)
            if best >= 0.8:
                want[i, j] = best
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = without_leaks(docs, benchmark).collect()
    assert sorted(repr(r.doc_id) for r in kept) == sorted(repr(i) for i, _ in rows if not any(k[0] == i for k in want))
    assert kept[0].__fields__ == docs.columns
    empty = benchmark.limit(0)
    assert leaks(docs, empty).count() == 0 and without_leaks(docs, empty).count() == len(rows)
    assert leaks(docs.limit(0), benchmark).count() == 0
