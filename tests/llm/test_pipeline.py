"""The pipeline's stages against what each operator says of the stage's own input."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from bough.llm.decontamination import leaks
from bough.operators.staging import stage

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for name, work in corpus_pipeline.STAGES:
        found.append(stage(work(spark, found[-1], FOLDER), f"test-{name}"))
    return found


def test_columns_and_order(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing",
    ]
    for df in outputs[1:-1]:
        assert df.schema == outputs[0].schema


def five_word_sets(rows):
    """The shingles of every row; texts of fewer words are one, texts without words none."""
    found = []
    for r in rows:
        parts = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        parts = re.findall("[^\x20\x09-\x0d]+", parts)
        count = max(1, len(parts) - 4) if parts else 0
        found.append(frozenset(" ".join(parts[i : i + 5]) for i in range(count)))
    return found


def test_near_duplicates_leave_one_of_each_group(outputs):
    """Groups by comparing all with all; of each the row of the least id stays."""
    rows = outputs[1].collect()
    sets = five_word_sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r.doc_id)
    assert len(groups) < len(rows)
    assert sorted(r.doc_id for r in outputs[2].collect()) == sorted(map(min, groups.values()))


def without_repeated(texts, words, length):
    """What remains of texts when each passage of so many words and each string of so many bytes goes that
    starts twice, by counting all of them."""
    spans = [[m.span() for m in re.finditer(rb"\S+", t)] for t in texts]
    passages, strings = Counter(), Counter()
    for t, own in zip(texts, spans):
        parts = t.split()
        passages.update(tuple(parts[i : i + words]) for i in range(len(own) - words + 1))
        strings.update(t[i : i + length] for i in range(len(t) - length + 1))
    kept = []
    for t, own in zip(texts, spans):
        gone, parts, out = bytearray(len(t)), t.split(), [False] * len(own)
        for i in range(len(own) - words + 1):
            if passages[tuple(parts[i : i + words])] > 1:
                out[i : i + words] = [True] * words
        for i, (begin, end) in enumerate(own):
            if out[i]:  # white space between two words that go goes too
                begin = own[i - 1][1] if i and out[i - 1] else begin
                gone[begin:end] = b"\1" * (end - begin)
        for i in range(len(t) - length + 1):
            if strings[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept.append((bytes(b for b, g in zip(t, gone) if not g), any(gone)))
    return kept


def test_repeats_go_and_the_rest_stays(outputs):
    before, got = outputs[2].collect(), {r.doc_id: r for r in outputs[3].collect()}
    found = without_repeated([(r.text or "").encode() for r in before], 51, 400)
    assert any(cut for _, cut in found)
    for r, (kept, cut) in zip(before, found):
        if not cut:
            assert got[r.doc_id] == r
        elif not kept:
            assert r.doc_id not in got
        elif kept.decode(errors="ignore").encode() == kept:  # no run cuts a character
            assert got[r.doc_id].text == kept.decode() and got[r.doc_id].n_chars == len(kept.decode())


def test_repeats_of_random_texts(spark, outputs):
    """Few words and long stretches in common, passages of many lengths about the limit."""
    rng = random.Random(8)
    rows = []
    for i in range(40):
        words = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randint(1, 150))]
        if rows:
            other = rng.choice(rows)[1].split()
            at = rng.randrange(len(other))
            words[len(words) // 2 : len(words) // 2] = other[at : at + rng.randint(45, 60)]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], outputs[0].schema)
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, FOLDER).collect()}
    found = without_repeated([t.encode() for _, t in rows], 51, 400)
    assert sum(cut for _, cut in found) > 5
    assert got == {i: kept.decode() for (i, _), (kept, _) in zip(rows, found) if kept}


def test_leaks_go(spark, outputs):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    gone = {r.doc_id for r in leaks(outputs[3], benchmark).collect()}
    assert {r.doc_id for r in outputs[4].collect()} == {r.doc_id for r in outputs[3].collect()} - gone


def test_packing_holds_every_document(outputs):
    assert {r.doc_id for r in outputs[5].collect()} == {r.doc_id for r in outputs[4].collect()}


def test_run_gives_the_last_stage(spark, outputs):
    columns = ["doc_id", "piece", "start", "length", "ids"]
    mine = Counter(tuple(map(str, r)) for r in corpus_pipeline.run(spark, FOLDER).select(columns).collect())
    assert mine == Counter(tuple(map(str, r)) for r in outputs[5].select(columns).collect())


def test_odd_documents(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x y z", "en", "s", 5), (3, "a b", "en", "s", 3),
            (3, "a b", "en", "s", 3), (3, "another text", "en", "s", 12), (None, None, None, None, 7)]
    docs = spark.createDataFrame(rows, schema)
    for name, work in corpus_pipeline.STAGES:
        docs = stage(work(spark, docs, FOLDER), "odd")
        empty = work(spark, spark.createDataFrame([], schema), FOLDER)
        assert empty.count() == 0
        if name == "simhash_near_dedup":
            # Rows 1, 2 and the last have no words and are one group; the two equal rows of id 3 are another.
            assert Counter(r.doc_id for r in docs.collect()) == {1: 1, 3: 2, None: 1}
