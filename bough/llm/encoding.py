"""Token ids of whole texts as a public tokenizer file gives them, in batches.

A byte-level BPE file cuts a text into words before it merges, and no word runs from a character
that is not white space into a space that follows it. Such places are safe to split at: the parts
encode on their own to the ids the whole text would have. A batch of texts is therefore split there
by Arrow and its distinct parts are numbered; those that were met before are looked up, only new ones
are encoded, and the ids of the texts are gathered from the ids of their parts. Files that work
differently get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in one call of the library.
CALL_BYTES = 1 << 20
#: Bytes that one generation of remembered parts may take. A worker keeps two and, when the younger
#: is full, forgets the elder: parts that come again stay. A cache, not a limit.
REMEMBERED_BYTES = 80_000_000
#: What a remembered part takes besides its characters and ids: two objects and a place in a table.
PART_BYTES = 180
#: Bytes of texts whose parts are numbered together; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20
#: New parts that go to the library as one text.
JOINED_PARTS = 2000

# Spelt out, because the search through a set of characters is several times faster than through \s.
_WHITE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_SPACES = f"^ |[{_WHITE}] "
_SAFE = re.compile(r"(?<=\S)(?= )")


@lru_cache(maxsize=2)
def encoder_of(path: str) -> TextEncoder:
    """The encoder of a file, kept in a Python worker from task to task with all it has learnt."""
    return TextEncoder(path)


class TextEncoder:
    """Encodes texts without begin, end or other added tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as file:
                described = json.load(file)
            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.vocabulary = library.get_vocab_size(with_added_tokens=True)
            self.splits = splits_at_spaces(described)
            self._call = lambda texts: [
                e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)
            ]
        elif path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.vocabulary = library.get_piece_size()
            self.splits = False
            self._call = lambda texts: library.encode(texts, num_threads=1)
        else:
            raise ValueError(f"no tokenizer file: {path}")
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        if self.splits:
            self._widths = _token_bytes(library, self.vocabulary)
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._held = 0

    def counts(self, texts: pa.Array | list[str]) -> np.ndarray:
        """The number of tokens of every text."""
        if not self.splits:
            return np.fromiter((len(x) for x in self._encoded(_listed(texts))), dtype=np.int64, count=len(texts))
        counts = np.zeros(len(texts), dtype=np.int64)
        for rows, begins, units, _, lengths in self._units(texts):
            counts[rows] = np.add.reduceat(lengths[units], begins[:-1])
        return counts

    def ids(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """The token ids of every text as unsigned little-endian integers of ``dtype``."""
        if not self.splits:
            return [np.array(x, self.dtype) for x in self._encoded(_listed(texts))]
        found: list[np.ndarray] = [None] * len(texts)
        for rows, begins, units, held, lengths in self._units(texts):
            taken = lengths[units]
            ends = np.cumsum(taken, dtype=np.int32)
            # Where the ids of every part begin in ``held``, less where they begin in the result.
            shift = (np.cumsum(lengths, dtype=np.int32) - lengths)[units] - (ends - taken)
            places = np.repeat(shift, taken)
            places += np.arange(len(places), dtype=np.int32)
            flat = held[places]
            cuts = np.concatenate([[0], ends])[begins].tolist()
            for row, begin, end in zip(rows.tolist(), cuts, cuts[1:]):
                found[row] = flat[begin:end]
        return found

    def _encoded(self, texts: list[str]) -> Iterable[list[int]]:
        call, size = [], 0
        for text in texts:
            if size and size + len(text) > CALL_BYTES:
                yield from self._call(call)
                call, size = [], 0
            call.append(text)
            size += len(text)
        if call:
            yield from self._call(call)

    def _joined(self, parts: list[str]) -> Iterable[bytes]:
        """Ids of parts that each follow a space, and may follow one another, as bytes of ``dtype``.

        One long text costs the library far less than many short ones, until it outgrows the
        processor's cache; the bytes that every token stands for tell where a part ends.
        """
        for begin in range(0, len(parts), JOINED_PARTS):
            own = parts[begin : begin + JOINED_PARTS]
            whole = " " + " ".join(own)
            ids = np.array(self._call([whole])[0], dtype=self.dtype)
            widths = np.cumsum(self._widths[ids])
            ends = np.cumsum(pc.binary_length(pa.array(own, pa.string())).to_numpy() + 1, dtype=np.int64)
            places = np.searchsorted(widths, ends, side="left") + 1
            if len(ids) and places[-1] <= len(ids) and (widths[places - 1] == ends).all():
                held, at = ids.tobytes(), (places * self.dtype.itemsize).tolist()
                yield from map(held.__getitem__, map(slice, [0, *at], at))
            else:  # a vocabulary without some bytes
                yield from self._alone([" " + x for x in own])

    def _alone(self, parts: list[str]) -> Iterable[bytes]:
        return (np.array(x, self.dtype).tobytes() for x in self._encoded(parts))

    def _units(self, texts: pa.Array | list[str]) -> Iterable[tuple[np.ndarray, ...]]:
        """A piece at a time: rows of ``texts``, where the parts of each begin, the unit of every
        part, and the ids and the lengths of all units, one after another."""
        array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        sizes = np.cumsum(pc.binary_length(array).to_numpy(zero_copy_only=False), dtype=np.int64)
        odd = pc.match_substring_regex(array, _ODD_SPACES).to_numpy(zero_copy_only=False).astype(bool)
        begin = 0
        while begin < len(array):
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + PIECE_BYTES, "right")))
            rows = np.arange(begin, end)
            for own, cut in ((rows[~odd[begin:end]], None), (rows[odd[begin:end]], split)):
                if len(own):
                    yield own, *self._numbered(array.take(pa.array(own)), cut)
            begin = end

    def _numbered(self, array: pa.Array, cut) -> tuple[np.ndarray, ...]:
        if cut is None:
            parts = pc.split_pattern(array, " ")
        else:
            parts = pa.array([[first, *rest] for first, rest in map(cut, array.to_pylist())], pa.list_(pa.string()))
        begins = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        units = coded.indices.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        # A first part is encoded as it stands; every other follows a space, which it leaves out.
        heads, of = np.unique(units[begins[:-1]], return_inverse=True)
        firsts = list(self._alone(words[heads].tolist()))
        follows = np.ones(len(units), dtype=bool)
        follows[begins[:-1]] = False
        used = np.flatnonzero(np.bincount(units[follows], minlength=len(words)))
        place = np.empty(len(words), dtype=np.int32)
        place[used] = np.arange(len(used))
        units = place[units]
        units[begins[:-1]] = len(used) + of
        held = self._remembered(words[used].tolist()) + firsts
        lengths = np.fromiter(map(len, held), dtype=np.int32, count=len(held)) // self.dtype.itemsize
        return begins, units, np.frombuffer(b"".join(held), self.dtype), lengths

    def _remembered(self, words: list[str]) -> list[bytes]:
        """The ids of distinct parts, each behind a space."""
        if self._held > REMEMBERED_BYTES:
            self._old, self._young, self._held = self._young, {}, 0
        held = list(map(self._young.get, words))
        gaps = [i for i, ids in enumerate(held) if ids is None]
        absent = [words[i] for i in gaps]
        found = list(map(self._old.get, absent))
        new = [w for w, ids in zip(absent, found) if ids is None]
        # Only a part that ends without white space can have another one put behind it.
        odd = [w for w in new if not w or w[-1].isspace()]
        plain = new if not odd else [w for w in new if w and not w[-1].isspace()]
        learnt = dict(zip(plain, self._joined(plain)))
        learnt.update(zip(odd, self._alone([" " + w for w in odd])))
        for i, word, ids in zip(gaps, absent, found):
            held[i] = ids if ids is not None else learnt[word]
        self._young.update(zip(absent, map(held.__getitem__, gaps)))
        self._held += PART_BYTES * len(absent) + sum(map(len, absent))
        return held


def _listed(texts: pa.Array | list[str]) -> list[str]:
    return texts.to_pylist() if isinstance(texts, pa.Array) else texts


def split(text: str) -> tuple[str, list[str]]:
    """Parts of a text that encode on their own: the first, and those after a space."""
    first, *rest = _SAFE.split(text)
    return first, [x[1:] for x in rest]


def splits_at_spaces(described: dict) -> bool:
    """Whether a tokenizer file encodes the parts of ``split`` as it encodes the whole."""
    words = described.get("pre_tokenizer") or {}
    after = (described.get("post_processor") or {}).get("type", "ByteLevel")
    plain = all(
        not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and not re.search(r"\s", t["content"])
        for t in described.get("added_tokens", [])
    )
    return (
        plain
        and after == "ByteLevel"
        and described.get("normalizer") is None
        and words.get("type") == "ByteLevel"
        and bool(words.get("use_regex", True))
        and not words.get("add_prefix_space")
        and not (described.get("model") or {}).get("dropout")
    )


def _token_bytes(library, vocabulary: int) -> np.ndarray:
    """How many bytes of text every id stands for: byte-level tokens have a character a byte."""
    widths = np.ones(vocabulary, dtype=np.int64)
    for token, i in library.get_vocab(with_added_tokens=False).items():
        widths[i] = len(token)
    for i, token in library.get_added_tokens_decoder().items():
        widths[i] = len(token.content.encode())
    return widths
