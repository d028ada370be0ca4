"""Token counts, token files and packing against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bough.llm import encoding
from bough.llm.encoding import TextEncoder, split
from bough.llm.packing import best_fit, complement, pack, plan, token_pieces
from bough.llm.token_counts import token_counts
from bough.llm.token_files import read_token_files, write_token_files
from bough.operators.staging import staging_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "\n\n", "a", " a", "a ", "a  b   c", "it's we're  'll", "tab\t x\n y", "a\x1c b \x85 c",
    "<|endoftext|> and <|endoftext|>x", "日本語 テスト 123", "é" * 500, "word " * 3000, "x" * 4000, "    y",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def table(spark, rows):
    """Documents with a null id and text, repeated rows, and columns whose names operators use."""
    return spark.createDataFrame(
        [(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, id string, n_tokens int, length int"
    )


@pytest.fixture(scope="module")
def rows():
    return [(3 * i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (5, None), (1000, "same"), (1000, "same")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .'\n\t é1<|>日"), max_size=30), max_size=6))
def test_parts_encode_as_the_whole(texts):
    encoder, library = TextEncoder(BPE), Tokenizer.from_file(BPE)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in encoder.ids(texts)] == want
    assert encoder.counts(texts).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("piece, remembered", [(1, 1), (64, 2000), (1 << 20, 0)])
def test_forgotten_parts_are_encoded_again(monkeypatch, library, piece, remembered):
    """However little is numbered together or remembered, texts encode as the library encodes them."""
    monkeypatch.setattr(encoding, "PIECE_BYTES", piece)
    monkeypatch.setattr(encoding, "REMEMBERED_BYTES", remembered)
    rng, encoder = random.Random(7), TextEncoder(BPE)
    for _ in range(6):
        texts = rng.sample(TEXTS, len(TEXTS)) + [" ".join(rng.choices(TEXTS, k=5)) for _ in range(10)]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        column = pa.chunked_array([pa.array(["cut off", *texts])]).chunk(0).slice(1)  # a slice of a batch
        assert [x.tolist() for x in encoder.ids(column)] == want
        assert encoder.counts(column).tolist() == [len(x) for x in want]
    assert encoder.ids([]) == [] and encoder.counts([]).tolist() == []


def test_split_loses_nothing():
    for text in TEXTS:
        first, rest = split(text)
        assert first + "".join(" " + x for x in rest) == text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_files_that_work_differently_get_whole_texts(name):
    path = public_tokenizers.path(name)
    encoder = TextEncoder(path)
    assert not encoder.splits
    if name.endswith(".json"):
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(TEXTS, add_special_tokens=False)]
    else:
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(TEXTS)
    assert [list(x) for x in encoder.ids(TEXTS)] == want


def test_counts(spark, rows, library):
    got = sorted(map(tuple, token_counts(table(spark, rows), BPE).collect()), key=repr)
    want = [(i, len((t or "").encode()), len(library.encode(t or "").ids)) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert token_counts(table(spark, []), BPE).count() == 0


def test_files_round_trip(spark, rows, library):
    shards = write_token_files(table(spark, rows).repartition(3), BPE, staging_path(spark, "files"), end_id=0)
    got = read_token_files(spark, shards).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(rows)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        at += r.n_tokens
    want = sorted((repr(i), [*library.encode(t or "").ids, 0]) for i, t in rows)
    assert sorted((repr(r.doc_id), r.ids) for r in got) == want
    none = write_token_files(table(spark, []), BPE, staging_path(spark, "files"))
    assert read_token_files(spark, none).count() == 0


def check_plan(counts, capacity, patterns):
    used = {}
    for lengths, times in patterns:
        assert sum(lengths) <= capacity and times > 0
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == {x: n for x, n in counts.items() if n}


def test_plans_use_every_piece_once():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([1, 7, 16, 64])
        counts = {x: rng.randint(0, 9) for x in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 12)))}
        patterns = plan(counts, capacity)
        check_plan(counts, capacity, patterns)
        total = sum(x * n for x, n in counts.items())
        left = np.zeros(capacity + 1, dtype=np.int64)
        for x, n in counts.items():
            left[x] = n
        sequences = sum(t for _, t in patterns)
        assert -(-total // capacity) <= sequences <= sum(t for _, t in best_fit(left, capacity)) + 1


def test_exact_complements():
    left = np.zeros(20, dtype=np.int64)
    left[[3, 5, 9]] = [1, 2, 1]
    assert complement(left, 9) == (9,)
    assert complement(left, 10) == (5, 5)
    assert complement(left, 17) == (9, 5, 3)
    assert complement(left, 6) is None  # one three is not two
    assert sum(t for _, t in plan({10: 5, 6: 5, 4: 5}, 10)) == 10


def test_packed_documents(spark, rows, library):
    pieces = token_pieces(table(spark, rows).repartition(4), BPE, capacity=32, end_id=2)
    got = pack(pieces, 32).collect()
    sequences, documents = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents.setdefault((r.doc_id, r.piece), []).append(r)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 32
    for i, t in rows:
        if i == 1000:
            continue
        ids = [*library.encode(t or "").ids, 2]
        held, k = b"", 0
        while (i, k) in documents:
            (piece,) = documents[i, k]
            assert piece.start == len(held) // 4 and (k == 0 or piece.length == 32)
            held, k = held + bytes(piece.ids), k + 1
        assert zlib.crc32(held) == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert len(documents[1000, 0]) == 2
    assert pack(token_pieces(table(spark, []), BPE, 32, 2), 32).count() == 0


def test_new_parts_go_to_the_library_by_the_thousand():
    encoder, library = TextEncoder(BPE), Tokenizer.from_file(BPE)
    calls, call = [], encoder._call
    encoder._call = lambda texts: calls.append(len(texts)) or call(texts)
    text = " ".join(f"w{i:x}é{i}" for i in range(2001))
    assert encoder.ids([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert calls == [1, 1]  # the first part, and all that follow a space
