"""The pipeline's stages on rows whose ids repeat or are null, near copies and short passages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bough.llm import near_copies
from bough.llm.batches import little_at_a_time
from bough.llm.near_copies import bitmap, groups, shingles
from bough.llm.passages import coded
from bough.operators.staging import stage

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)


def left(work, spark, docs):
    return sorted(((r.doc_id, r.text) for r in stage(work(spark, docs, FOLDER), "left").collect()), key=str)


def test_near_dedup_keeps_one_row_of_each_group_whatever_the_ids(spark, table):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (7, b), (None, c), (None, c), (None, a), (5, a)]
    got = left(corpus_pipeline.simhash_near_dedup, spark, table(rows))
    assert got == sorted([(5, a), (5, b), (None, c)], key=str)


def test_passages_of_51_short_words_go(spark, table):
    passage = " ".join("abcdefghijklmnopqrstuvwxyz"[i * i % 26] + str(i % 7) for i in range(51))
    shorter, blob = " ".join(f"w{i}" for i in range(50)), "q0é" * 130
    rows = [
        (1, f"first {passage} end"), (2, f"second  one {passage}"), (3, f"third {shorter} here"),
        (4, f"fourth {shorter} there"), (5, f"five {blob} x"), (6, f"six {blob} y"), (7, passage), (8, ""),
    ]
    assert len(passage) < 400 <= len(blob.encode())
    got = dict(left(corpus_pipeline.suffix_array_dedup, spark, table(rows)))
    assert got[1] == "first  end" and got[2] == "second  one "
    assert got[3] == rows[2][1] and got[4] == rows[3][1]
    assert got[5] == "fivex" and got[6] == "sixy"  # the spaces beside the blob repeat too
    assert 7 not in got and got[8] == ""


def test_codes_are_one_a_word():
    assert len(coded(" a  bc\nd ")) == 18 and coded("") == "" and coded("a b") == coded("a\t b")


def planted():
    """Texts, families of near copies at all likenesses, and a common line in many."""
    rng = random.Random(4)
    texts = [None, "", "One two", "one TWO", "a b c d e"]
    for _ in range(8):
        words = [f"w{rng.randrange(9999)}" for _ in range(rng.randint(20, 120))]
        line = "a line that a great many of the documents have in common" if rng.random() < 0.5 else ""
        for _ in range(rng.randint(2, 14)):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
            texts.append(f"{line} {' '.join(own)}")
    # Copies of copies, which only chains connect, and what lies between two families.
    family = [[f"w{i}" for i in range(60)]]
    for _ in range(50):
        own = list(rng.choice(family))
        for _ in range(rng.randint(1, 2)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
        family.append(own)
    return texts + [" ".join(own) for own in family]


@pytest.mark.parametrize("prints, rounds, last_keys", [(True, 3, 1 << 16), (True, 0, 3), (False, 1, 0), (False, 0, 1 << 16)])
def test_groups_are_those_of_brute_force(spark, monkeypatch, prints, rounds, last_keys):
    """Whatever the fingerprints show, the rounds connect and the shingles put last."""
    for name, value in (("ROUNDS", rounds), ("LAST_KEYS", last_keys), ("ASKED", 1)):
        monkeypatch.setattr(near_copies, name, value)
    if not prints:
        nothing = lambda nodes: nodes.select("node", nodes.node.alias("other")).limit(0)
        monkeypatch.setattr(near_copies, "_close", nothing)
    texts = planted()
    sets = [set(shingles(t or "").tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    assert [r.group for r in groups(docs).orderBy("row").collect()] == root
    assert 12 < len(set(root)) < len(root) - 12


def test_bitmaps_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(2)
    for size, changed in ((5, 1), (400, 60), (9000, 900)):
        one = rng.integers(0, 1 << 63, size=size, dtype=np.uint64)
        two = np.concatenate([one[changed:], rng.integers(0, 1 << 63, size=changed // 2, dtype=np.uint64)])
        differ = sum(int(x).bit_count() for x in (bitmap(one) ^ bitmap(two)).view(np.uint64))
        assert 0 < differ <= changed + changed // 2
    assert not bitmap(np.zeros(0, dtype=np.uint64)).any()


def test_near_dedup_leaves_no_near_copies(spark, table):
    words = [f"w{i}" for i in range(100)]
    other = words[:50] + ["changed"] + words[51:]
    got = left(corpus_pipeline.simhash_near_dedup, spark, table([(1, " ".join(words)), (2, " ".join(other))]))
    assert got == [(1, " ".join(words))]


def test_near_dedup_hands_python_few_rows_at_once(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, staged = spark.conf.get(name), near_copies.stage

    def stage(df, label):
        seen.append(int(spark.conf.get(name)))
        return staged(df, label)

    monkeypatch.setattr(near_copies, "stage", stage)
    rows = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "row long, text string")
    assert sorted(map(tuple, groups(rows).collect())) == [(1, 1), (2, 1), (3, 3)]
    assert seen and max(seen) <= 500
    assert spark.conf.get(name) == before


BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def batch_bytes(spark):
    before = spark.conf.get(BYTES)
    yield before
    spark.conf.set(BYTES, before)


@pytest.mark.parametrize("work", [w for _, w in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_hand_python_little_at_once(spark, batch_bytes, work):
    spark.conf.set(BYTES, "64m")
    work(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    texts = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    held = [r.size for r in texts.mapInArrow(sizes, "size long").collect()]
    assert sum(held) > 10_000_000 and max(held) < 2 << 20


@pytest.mark.parametrize("before, after", [("64m", "1048576"), ("2KB", "2KB"), ("4096b", "4096b")])
def test_a_lower_bound_of_the_session_stays(spark, batch_bytes, before, after):
    spark.conf.set(BYTES, before)
    little_at_a_time(spark)
    assert spark.conf.get(BYTES) == after


SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.mark.parametrize("work", [w for _, w in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_what_stages_shuffle_goes_when_a_job_has_ended(spark, batch_bytes, work):
    spark.conf.unset(SHUFFLES)
    try:
        work(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        before = files.getAllBlocks().size()
        stage(spark.range(1000).repartition(5, "id"), "shuffled")
        assert files.getAllBlocks().size() <= before
        assert spark.conf.get(SHUFFLES) == "true"
    finally:
        spark.conf.unset(SHUFFLES)


def test_repeats_stage_writes_only_places_that_may_repeat(spark, table, monkeypatch):
    alone = [(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(20)]
    passage = " ".join(f"p{j}" for j in range(60))
    written = {}

    def counted(df, label):
        out = stage(df, label)
        written.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr("bough.llm.repeats.stage", counted)
    docs = table([*alone, (20, f"a b {passage}"), (21, f"{passage} c d")])
    got = left(corpus_pipeline.suffix_array_dedup, spark, docs)
    assert got == sorted([*alone, (20, "a b "), (21, " c d")], key=str)
    passages, strings = written["repeat-anchors"]
    assert 0 < passages <= 8 and strings == 0
