"""Rows that large groups of near copies and lines that many texts hold cost."""

import random
from collections import Counter

import pytest

from bough.llm import near_copies
from bough.llm import repeats as repeats_module
from bough.llm.near_copies import groups, shingles
from bough.llm.repeats import repeats
from bough.operators.staging import stage


@pytest.fixture
def written(monkeypatch):
    """Rows of what is staged, by label."""
    rows = Counter()

    def counted(df, label):
        out = stage(df, label)
        rows[label] += out.count()
        return out

    for module in (near_copies, repeats_module):
        monkeypatch.setattr(module, "stage", counted)
    return rows


def test_links_of_a_group_of_near_copies_are_no_square_of_it(spark, written):
    rng = random.Random(3)
    base = [f"w{i}x{rng.randrange(99)}" for i in range(150)]
    texts = []
    for i in range(400):  # no edit to five; some of them link to nothing
        text = list(base)
        for k in range(rng.choice([1, 2, 2, 3, 3, 4, 5])):
            text[rng.randrange(150)] = f"new{i}y{k}"
        texts.append(" ".join(text))
    texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(4)
    got = {r.row: r.group for r in groups(df).collect()}
    sets = [set(shingles(t).tolist()) for t in texts]
    root, squares = list(range(len(texts))), 0
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if 5 * shared >= 4 * (len(a) + len(sets[j]) - shared):
                squares += 1
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    assert got == dict(enumerate(root)) and len(set(root)) > 5
    assert squares > 10_000 > written["near-links"]


def test_shingles_with_the_same_holders_have_several_centres(spark):
    rows = [(key, node, 100, key, node) for key in range(10) for node in range(40)]
    rows += [(key, 40, 100, 12, 40) for key in range(10)]  # has them too late to be a centre
    df = spark.createDataFrame(rows, "key long, node long, n int, place int, root long")
    pairs = near_copies._stars(df, 0).collect()
    assert 3 * 39 < len(pairs) <= 10 * 39
    assert not any(40 in p for p in pairs)


def test_a_line_that_many_texts_hold_costs_a_few_rows_each(spark, written, monkeypatch):
    monkeypatch.setattr(repeats_module, "GROUP", 8)
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefgh ") for _ in range(70))

    def alone():
        return "".join(rng.choice("ijklmnop ") for _ in range(90))

    texts = [alone() + line + alone() for _ in range(120)]
    common = alone()  # 30 bytes more in two of them
    texts += [alone() + line + common[:30] + alone() for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length in (60, 90):
        written.clear()
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        got = {r.doc_id: bytes(r.kept).decode() for r in repeats(df, length).collect()}
        for i, text in enumerate(texts):
            places = [at for at in range(len(text) - length + 1) if seen[text[at : at + length]] > 1]
            gone = {k for at in places for k in range(at, at + length)}
            assert got[i] == "".join(c for k, c in enumerate(text) if k not in gone)
        assert 0 < written["repeat-parts"] <= 15 * len(texts)
